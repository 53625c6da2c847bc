import hashlib
import math

import duckdb
import pytest
from llm.cases import DOCS, awkward, clashing, rows_of

from barquet.llm import mixing, queries


def taken(found):
    leaf = {}
    for r in found.collect():
        k = (r["domain"], r["lang"], r["source"])
        leaf[k] = leaf.get(k, 0) + r["n_tokens"] * r["full_epochs"] + r["prefix_tokens"]
    return leaf


def docs_of(spark, sizes):
    rows, n = [], 0
    for (lang, source), tokens in sizes.items():
        for t in tokens:
            rows.append((n, "x" * 4 * t, lang, source, 4 * t))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    docs = docs_of(spark, {
        ("en", "src0"): [10] * 100, ("en", "src4"): [10], ("fr", "src0"): [10] * 100,  # domain d0
        ("en", "src1"): [10] * 100,  # domain d1
    })
    plan = mixing.Plan(share_percent=26, epochs=1)  # 783 of 3010
    leaf = taken(mixing.mix(docs, plan))
    assert sum(leaf.values()) == 782
    # halves to the domains and languages; src4 has 10 only, its sibling takes what it lacks
    assert leaf[("d0", "en", "src4")] == 10
    assert leaf[("d1", "en", "src1")] == 391
    assert leaf[("d0", "fr", "src0")] + leaf[("d0", "en", "src0")] + 10 == 391
    assert abs(leaf[("d0", "fr", "src0")] - leaf[("d0", "en", "src0")] - 10) <= 1


def test_a_full_family_passes_its_shortage_up(spark):
    docs = docs_of(spark, {("en", "src0"): [5], ("fr", "src0"): [5], ("en", "src1"): [10] * 50})
    leaf = taken(mixing.mix(docs, mixing.Plan(share_percent=80, epochs=1)))
    assert leaf == {("d0", "en", "src0"): 5, ("d0", "fr", "src0"): 5, ("d1", "en", "src1"): 398}


def test_weights_and_epochs(spark):
    docs = docs_of(spark, {("en", "src0"): [7, 8], ("fr", "src0"): [100] * 3, ("de", "src0"): [50]})
    plan = mixing.Plan(weights={"lang": {"en": 1, "fr": 3, "de": 0}}, share_percent=50, epochs=4)
    got = mixing.mix(docs, plan)
    assert taken(got) == {("d0", "en", "src0"): 46, ("d0", "fr", "src0"): 136}  # 45.5 and 136.5; the odd token goes in fill order
    assert all(r["full_epochs"] == 3 for r in got.filter("lang = 'en'").collect())


def test_prefix_is_in_seeded_order(spark):
    docs = docs_of(spark, {("en", "src0"): [3] * 400})
    plan = mixing.Plan(share_percent=30, epochs=1, seed=9)
    got = {r["doc_id"]: r["prefix_tokens"] for r in mixing.mix(docs, plan).collect()}
    order = sorted(range(400), key=lambda i: hashlib.md5(f"9:0:{i}".encode()).hexdigest())
    want = {i: 3 for i in order[: 360 // 3]}
    assert got == want
    other = mixing.mix(docs, mixing.Plan(share_percent=30, epochs=1, seed=10))
    assert {r["doc_id"] for r in other.collect()} != set(got)


def test_selection_keeps_rows_whole(spark):
    docs = clashing(docs_of(spark, {("en", "src0"): [3] * 50, ("fr", "src1"): [4] * 50}))
    plan = mixing.Plan(share_percent=40, epochs=1)
    kept = mixing.select_documents(docs, plan)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in mixing.mix(docs, plan).collect()}


@pytest.mark.parametrize("percent, epochs", [(100, 4), (37, 1), (100, 1), (400, 2), (0, 1)])
def test_equals_sql_on_awkward_rows(spark, percent, epochs):
    docs = awkward(spark)
    documents = docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")  # noqa: F841  read by DuckDB
    plan = mixing.Plan(queries.MIX.weights, percent, epochs, 3)
    got = mixing.mix(docs, plan)
    con = duckdb.connect()
    con.register("documents", documents)
    theirs = con.execute(mixing.oracle(plan)).df()[got.columns]
    plain = lambda v: "None" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else str(int(v) if isinstance(v, float) else v)
    assert rows_of(got) == sorted(tuple(plain(v) for v in r) for r in theirs.itertuples(index=False))


def test_empty_table(spark):
    assert mixing.mix(awkward(spark).limit(0), queries.MIX).count() == 0
    assert mixing.select_documents(awkward(spark).limit(0), queries.MIX).count() == 0
