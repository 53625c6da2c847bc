import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.cases import awkward, clashing, prose, rows_of

from barquet.llm import queries, runindex, suffixdedup


def expected(rows, length):
    raws = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for key, raw in raws:
        gone = [False] * (len(raw) + 1)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append(tuple(map(str, (key, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_run_index_against_counts(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([b"ab", b"abc\0", b"abcdefgh", b"a"])
    base = bytes(rng.choice(alphabet) for _ in range(90))
    strings = []
    for _ in range(rng.randint(0, 9)):
        b = bytearray(base[rng.randint(0, 20) :][: rng.randint(0, 70)])
        for _ in range(rng.randint(0, 3)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(alphabet)
        strings.append(bytes(b))
    n = rng.choice([3, 8, 13, 20])
    count = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
    want = [[i for i in range(len(s) - n + 1) if count[s[i : i + n]] > 1] for s in strings]
    assert [g.tolist() for g in runindex.repeated_starts(strings, n)] == want


def test_runs_spell_the_transform():
    strings = [b"banana bandana", b"banana"]
    text, starts, lengths = runindex.joined(strings)
    left = np.zeros(len(text), np.int64)
    for s, n in zip(starts, lengths, strict=True):
        left[s : s + n] = np.arange(n, 0, -1)
    index = runindex.RunIndex.build(text, runindex.packed(text), left)
    suffixes = sorted((strings[d][i:], int(starts[d]) + i) for d in range(2) for i in range(len(strings[d])))
    transform = [int(text[p - 1]) if p else 0 for _, p in suffixes]
    assert np.repeat(index.heads, index.lengths).tolist() == transform
    assert index.lengths.sum() == 20 and len(index.heads) < 20


def fragments(seed, n=40):
    """Texts that share passages, lines and near copies of each other, with periodic stretches."""
    rng = random.Random(seed)
    shared = [prose(100 + i, 12) for i in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(1000 * seed + 10 * i + k, rng.randint(2, 25)) for k in range(3)]
        for s in shared:
            if rng.random() < 0.4:
                parts.insert(rng.randint(0, len(parts)), s)
        if rng.random() < 0.15:
            parts.append("ab" * rng.randint(5, 60))
        rows.append((i, "\n".join(parts)))
    for i in range(n // 3):
        words = rows[rng.randrange(n)][1].split(" ")
        words[rng.randrange(len(words))] = "é"
        rows.append((n + i, " ".join(words)))
    rows.append((900, rows[0][1]))
    return rows


@pytest.mark.parametrize("seed, hot, contexts", [(1, 1024, 8192), (2, 2, 8192), (3, 0, 3), (4, 3, 5)])
def test_removed_bytes(spark, monkeypatch, seed, hot, contexts):
    monkeypatch.setattr(suffixdedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffixdedup, "BLOCK_CONTEXTS", contexts)
    rows = fragments(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.remove_repeats(df, length=40, seed=12)
    assert rows_of(got, "removed") == expected(rows, 40)


def test_long_texts_are_cut_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 5000, dtype=np.uint8)
    want = suffixdedup.contexts(raw, suffixdedup.Hasher())
    monkeypatch.setattr(suffixdedup, "PIECE", 700)
    got = suffixdedup.contexts(raw, suffixdedup.Hasher(1200))
    covered = lambda c: {s for a, w in zip(c[0].tolist(), c[1].tolist(), strict=True) for s in range(a, a + w - 199)}
    assert covered(got) == covered(want) == set(range(5000 - 199))


def test_awkward_rows_and_query(spark, tmp_path):
    docs = awkward(spark)
    clashing(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op5_repeated_passages"](spark, str(tmp_path))
    assert rows_of(got) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], 200)
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0
