import zlib

import numpy as np
import pytest
from llm.cases import awkward, clashing, prose

from barquet.llm import packing, queries


def brute_cost(at, penalty, window):
    cost = {0: 0}
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window and i in cost:
                options.append(cost[i] + (0 if n & (n - 1) == 0 else window - n))
        if options:
            cost[j] = min(options) + penalty[j] + packing.WINDOW_COST
    return cost[len(at) - 1]


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 20, 60))]))
    penalty = rng.choice([0, 4, 24], len(at))
    cuts = packing.best_cuts(at, penalty, window=64)
    edges = [0, *cuts]
    place = {p: i for i, p in enumerate(at.tolist())}
    mine = sum(
        (0 if (b - a) & (b - a - 1) == 0 else 64 - (b - a)) + int(penalty[place[b]]) + packing.WINDOW_COST
        for a, b in zip(edges, edges[1:], strict=False)
    )
    assert edges[-1] == at[-1] and max(np.diff(edges)) <= 64
    assert mine == brute_cost(at.tolist(), penalty.tolist(), 64)


def check(pieces, texts):
    """Every id in one piece, checksums, gapless sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for key, found in by_doc.items():
        ids = [*plain.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        copies = sum(p["start"] == 0 for p in found)
        assert sum(p["length"] for p in found) == copies * len(ids)
        for p in found:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["doc_tokens"] == len(ids) and len(part) == p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
    assert set(by_doc) == set(texts)
    used = [sum(p["length"] for p in s) for s in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in used) / sum(used)


def test_awkward_rows_and_query(spark, tmp_path):
    docs = awkward(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clashing(docs).write.parquet(str(tmp_path / "documents.parquet"))
    check(queries.QUERIES["op6_packing"](spark, str(tmp_path)).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0


def test_little_padding_and_large_ids(spark):
    rows = [(2**60 + i, prose(i, 20 + 37 * i % 700)) for i in range(150)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert check(packing.pack(docs).collect(), dict(rows)) < 0.02


@pytest.mark.parametrize("block", [1, 700, 5000])
def test_blocks_make_no_difference_to_completeness(block):
    encode, ends, starts = packing.load_encoder()
    packer = packing.Packer(ends, starts, 5 << 40, block)
    texts = {i: prose(i, 10 + 97 * i % 900) for i in range(30)}
    frames = [packer.add(i, encode(t)) for i, t in texts.items()] + [packer.finish()]
    pieces = [r for f in frames if f is not None for r in f.to_dict("records")]
    check(pieces, texts)
    assert min(p["sequence_id"] for p in pieces) == 5 << 40


@pytest.mark.parametrize("text", ["plain", "a <|endoftext|> b", "œuvre — 日本語 ✓", "tab\t\t  two\n\n\nlines  ", "\x00\x7f", "½ ª²³ ß"])
def test_ids_are_the_tokenizer_files(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, _, _ = packing.load_encoder()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(encode(text)) == plain.encode(text, add_special_tokens=False).ids
