import corpus_pipeline
import pytest
from llm.cases import DOCS, awkward, prose

from barquet.llm import simhash


@pytest.fixture(scope="module")
def docs(spark):
    langs = ("en", "fr", "de")
    rows = [(i, prose(i, 80 + i % 40, langs[i % 3]), langs[i % 3], f"src{i % 7}", 1) for i in range(90)]
    rows += [(200, rows[0][1], "en", "src0", 1), (201, rows[0][1] + " x", "en", "src0", 1), (202, "12 34", "en", "src0", 1)]
    rows += [(203, "token=abcdefghijkl " + prose(500, 70), "en", "src1", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_stages_one_by_one(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()} == {202}
    single = stage["near_duplicates"](spark, known, "")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(known).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(found.values()))
    assert 200 not in {r["doc_id"] for r in single.collect()}
    masked = {r["doc_id"]: r["text"] for r in stage["secrets"](spark, single, "").collect()}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {k for k in masked if masked[k] != before[k]} == {203} and masked[203].startswith("[SECRET] ")
    mixed = stage["mixing"](spark, single, "")
    assert 0 < mixed.count() < single.count()
    for df in (known, single, mixed):
        assert df.columns == docs.columns
    assert {r["doc_id"] for r in stage["packing"](spark, mixed, "").collect()} == {r["doc_id"] for r in mixed.collect()}


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_awkward_and_empty_tables(spark):
    rows = awkward(spark)
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.count()


def test_repeated_rows_leave_one(spark):
    text = prose(3, 50)
    docs = spark.createDataFrame([(1, text, "en", "a", 1)] * 3 + [(None, prose(9, 50), "en", "a", 1)] * 2, DOCS)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
