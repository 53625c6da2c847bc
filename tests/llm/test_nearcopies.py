import random

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from llm.cases import DOCS, awkward, prose
from pyspark.sql import functions as F

from barquet.llm import nearcopies, simhash


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(text, seed, edits):
    words, rng = text.split(), random.Random(seed)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_alike_is_the_exact_jaccard():
    base = prose(1, 300)
    texts = [base, *(edited(base, i, i % 12) for i in range(60)), "", "a b", "A  b", prose(1, 4)]
    for a in texts:
        assert nearcopies.alike(base, a) == (jaccard(base, a) >= 0.8)
    assert nearcopies.alike("a b", "A  b") and nearcopies.alike("", " \n") and not nearcopies.alike("", "a")


def test_stage_removes_near_copies_that_simhash_leaves(spark):
    rows, want = [], set()
    for i in range(30):
        base = prose(i, 300)
        copy = edited(base, i, 5)
        assert jaccard(base, copy) >= 0.8
        rows += [(i, base, "en", "s", 1), (100 + i, copy, "en", "s", 1), (200 + i, edited(base, i, 60), "en", "s", 1)]
        want |= {i, 200 + i}
    far = [simhash.fingerprint(rows[3 * i][1]) ^ simhash.fingerprint(rows[3 * i + 1][1]) for i in range(30)]
    assert max(x.bit_count() for x in far) > simhash.RADIUS
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, DOCS), "")
    assert {r["doc_id"] for r in kept.collect()} == want


def test_stage_links_by_simhash_too(spark):
    """Texts of one repeated line with tails of their own: one fingerprint, but sets of shingles far apart."""
    rows = [(i, "one two three " * 60 + prose(i, 8), "en", "s", 1) for i in range(4)] + [(9, prose(90, 100), "en", "s", 1)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.5
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, DOCS), "")
    assert {r["doc_id"] for r in kept.collect()} == {0, 9}


def test_repeated_shingles_come_packed():
    """However many parts there are, a part gives a row per bucket of texts and not one per text."""
    n, made = 500, nearcopies._repeated(64)
    keys = [k * 7919 for k in range(n)]
    place, token = np.repeat(np.arange(n, dtype=np.uint16), 2), np.arange(2 * n, dtype=np.uint32) % 100
    part = pd.DataFrame([(3, keys, [9] * n, [9] * n, token.tobytes(), place.tobytes())], columns=nearcopies.COLUMNS)
    got = made(part)
    assert len(got) <= 64 and sum(len(k) for k in got["keys"]) == 8 * n and sum(len(t) for t in got["tokens"]) == 16 * n


@pytest.mark.parametrize("bits", [0, 4, 12])
def test_packed_shingles_stay_small(bits):
    """Whatever the number of parts, what is sent of a text is less than eight bytes a shingle."""
    texts = [prose(i, 250) for i in range(200)]
    batch = pd.DataFrame({"key": [i * 7919 for i in range(200)], "text": texts})
    none = (np.zeros(0, np.uint64), np.zeros(0, int))
    sent = pd.concat(nearcopies._packer(none, bits, 80, 1 << 20)(iter([batch, batch])))
    size = sum(8 * len(r.keys) + 4 * len(r.n) + 4 * len(r.own) + len(r.tokens) + len(r.place) for r in sent.itertuples(index=False))
    total = sum(len(nearcopies.shingle_set(t)) for t in texts)
    assert size < 8 * total
    once = sent[sent["part"] < 0]
    assert sorted(k for keys in once["keys"] for k in keys) == batch["key"].tolist()
    assert sum(n for each in once["n"] for n in each) == total


def test_filter_before_the_texts_are_fetched(spark):
    texts = spark.range(4000).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("text"))
    wanted = texts.filter("text % 40 = 0").select("key")
    for bits, most in ((1 << 23, 101), (1 << 15, 150), (64, 4000)):
        found = {r["text"] for r in nearcopies.likely(texts, wanted, bits).collect()}
        assert {str(i) for i in range(0, 4000, 40)} <= found and len(found) <= most
    plan = nearcopies.likely(texts, wanted).join(wanted.distinct(), "key")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert ["strategy=broadcast" in line for line in joins[:2]] == [False, True]


def test_whole_texts_are_dealt_out_once(spark):
    docs = spark.createDataFrame([(i % 5, prose(i % 5, 40), "en", "s", 1) for i in range(10)], DOCS)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    finally:
        spark.conf.set(limit, before)
    window = plan[plan.index("Window [") :]
    assert "Exchange" not in window[: window.index("Join")]


def group_of_copies():
    """Edits of one base, light and heavy, texts that share one passage, and texts of their own."""
    base, passage = prose(5, 200), prose(77, 120)
    texts = [edited(base, i, i % 9) for i in range(50)] + [edited(base, 100 + i, 12 + i % 12) for i in range(30)]
    texts += [f"{prose(300 + i, 60 + i % 60)} {passage}" for i in range(40)] + [prose(i + 10, 200) for i in range(5)]
    texts += [base[: -len(base) // 20], base + " " + prose(9, 12), "a b c", "A b  c", "d e f"]
    return list(dict.fromkeys(texts))


def alike_pairs(texts):
    return {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if jaccard(a, b) >= 0.8}


@pytest.mark.parametrize("sample, least", [(0, 1), (10_000, 2), (10_000, 20)])
def test_prefixes_reach_every_alike_pair(spark, sample, least):
    """Whatever order the frequent shingles have, and whatever part a shingle is in."""
    texts = group_of_copies()
    docs = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(3)
    frame = docs.select(F.xxhash64("text").alias("key"), "text")
    rows = nearcopies.staged(nearcopies.entries(frame, part=500, flush=3000, sample=sample, least=least), "rows")
    names = {r["key"]: r["text"] for r in frame.distinct().collect()}
    pairs = {frozenset((names[r["a"]], names[r["b"]])) for r in nearcopies._small_pairs(rows, 80).distinct().collect()}
    want = alike_pairs(texts)
    assert want <= pairs and len(want) > 100
    assert not {p for p in pairs if any(t.endswith(prose(77, 120)) for t in p)}
    blocks = nearcopies._block_pairs(rows.join(rows.groupBy("token").count(), "token"), 4, 80)
    assert {frozenset((names[r["a"]], names[r["b"]])) for r in blocks.distinct().collect()} == pairs


@pytest.mark.parametrize("small, group", [(1000, 64), (3, 4), (1, 2)])
def test_crowded_rows_leave_no_alike_pair(spark, small, group):
    texts = group_of_copies()
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("key"), "text")
    rows = nearcopies.staged(nearcopies.entries(frame), "rows")
    sets = nearcopies.staged(frame.select("key", nearcopies.set_column("text").alias("h")), "sets")
    edges = nearcopies.links(rows, sets, small=small, group=group)
    keys = {r["key"]: r["text"] for r in frame.collect()}
    assert all(jaccard(keys[r["a"]], keys[r["b"]]) >= 0.8 for r in edges.collect())
    if small == 1000:
        assert {frozenset((keys[r["a"]], keys[r["b"]])) for r in edges.collect()} == alike_pairs(texts)
    gone = {r["node"] for r in nearcopies.components(edges).filter("node <> root").collect()}
    kept = [t for k, t in keys.items() if k not in gone]
    assert 40 < len(kept) < len(keys) - 20
    assert not alike_pairs(kept)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = {(r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(docs).collect()}
    assert {(2, 2), (3, 2), (10, 2), (4, 4), (5, 4), (6, 4), (1, 1), (None, None)} <= found
    assert nearcopies.near_copies(docs.limit(0)).count() == 0
