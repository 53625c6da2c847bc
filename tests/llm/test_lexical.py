import math
import re
from collections import Counter

import numpy as np
import pytest
from llm.cases import awkward, clashing, prose, rows_of
from pyspark.sql import functions as F

from barquet.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def found_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Plain search, one item and one document at a time."""
    held = [(i, Counter(found_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items.items():
        scored = []
        for doc, counts in held:
            m = 25 + (75 * sum(counts.values()) * total) // length
            score = 0
            for t in found_terms(text):
                if tf := counts.get(t):
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


ITEMS = {1: prose(1, 12), 2: prose(2, 30) + " ZZZ zzz naïve Naïve", 3: "", 4: "unheard-of 1234", 5: prose(5, 20, "de") * 3, 6: "!?"}


@pytest.mark.parametrize("tile_terms, group", [(1 << 20, 128), (1 << 20, 2), (30, 3)])
def test_equals_plain_search(spark, tile_terms, group):
    docs = clashing(awkward(spark))
    items = spark.createDataFrame([*ITEMS.items(), (None, "the ing"), (1, ITEMS[1] + " z"), (3, None)], "item_id long, text string")
    found = lexical.search(docs, items, k=4, tile_terms=tile_terms, group=group)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(found) == ranked(plain, ITEMS, 4)


def test_ties_at_the_cut_go_by_id(spark):
    docs = [(i, "alpha beta") for i in range(40, 0, -1)] + [(99, "alpha"), (None, "alpha beta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = rows(lexical.search(frame, spark.createDataFrame([(7, "beta Beta")], "item_id long, text string"), k=3))
    assert [r[2] for r in found] == [1, 2, 3]
    assert found == ranked(docs, {7: "beta Beta"}, 3)


def test_slices_stay_below_the_exact_bound():
    weights = np.array([[3, 5, 1, 9, 2], [4, 4, 4, 4, 4]])
    cuts = lexical.slices(weights, width=3, limit=9 * lexical.IMPACT)
    assert [(s.start, s.stop) for s in cuts] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    cuts = lexical.slices(weights, width=3)
    assert [(s.start, s.stop) for s in cuts] == [(0, 3), (3, 5)]


def test_heavy_terms_are_exact():
    weight = np.array([30_000, 7])
    group = lexical._Group([Counter({0: 400_000, 1: 3})], weight)
    assert group.heavy.tolist() == [0]
    row, term, impact = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([999_999, 123_457, 5])
    assert group.scores(2, row, term, impact)[:, 0].tolist() == [30_000 * 400_000 * 999_999 + 21 * 123_457, 105]


def test_repeated_documents_and_empty_tables(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(lexical.search(frame, items)) == ranked(docs, {1: "a"}, 10)
    assert lexical.search(frame.limit(0), items).count() == 0
    assert lexical.search(frame, items.limit(0)).count() == 0
    assert rows_of(lexical.search(frame, items.withColumn("text", F.lit("zzz")))) == []
