import zlib

import pytest
from llm.cases import DOCS, awkward, clashing, prose, rows_of

from barquet.llm import language, queries
from barquet.llm.common import fold


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 50, lang), lang, "s", 1) for i in range(120) for lang in [("en", "fr", "de")[i % 3]]]
    return spark.createDataFrame(rows, DOCS)


def test_held_out_texts_get_their_language(docs):
    learned = language.learn_dictionaries(docs, train=fold("doc_id", 4) != 2)
    assert list(learned) == ["de", "en", "fr"]
    assert all(0 < len(d) <= language.DICT_BYTES for d in learned.values())
    found = language.identify(docs, learned).filter(fold("doc_id", 4) == 2).select("doc_id", "lang", "language.*").collect()
    right = sum(r[1] == r[2] for r in found)
    assert len(found) > 15 and right >= 0.95 * len(found)


def test_training_never_reads_held_out_labels(docs):
    from pyspark.sql import functions as F

    held = fold("doc_id", 4) == 2
    spoilt = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert language.learn_dictionaries(spoilt, train=~held) == language.learn_dictionaries(docs, train=~held)


def test_fold_is_the_checksum_of_the_id(docs):
    got = {r[0]: r[1] for r in docs.select("doc_id", fold("doc_id", 4)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in got}


def test_sizes_are_those_of_the_coder():
    import zstandard

    words = prose(3, 400).encode()
    sizes = language.size_reader({"en": words})("some " * 900)
    d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    raw = ("some " * 900).encode()
    assert sizes == [sum(len(c.compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES))]


def test_margin_and_ties():
    assert language.judge(["a", "b"], [10, 20])[0::3] == ("a", False)
    name, score, margin, rejected = language.judge(["b", "a"], [10, 10])
    assert (name, margin, rejected) == ("a", 0.0, True) and score == pytest.approx(0.5)
    assert language.judge(["a"], [10])[1] == 1.0


def test_awkward_rows(spark, docs):
    learned = language.learn_dictionaries(docs)
    got = language.identify(awkward(spark), learned).select("doc_id", "language.*").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 14
    for i in (4, 5, 6, 7):
        assert (by[i]["lang"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[8]["lang"] == "en" and by[9]["lang"] == "de" and by[None]["lang"] == "fr"
    assert all(0.0 <= r["score"] <= 1.0 for r in got)
    plain = language.identify(awkward(spark), learned).select("doc_id", "language")
    assert rows_of(plain) == rows_of(language.identify(clashing(awkward(spark)), learned).select("doc_id", "language"))


def test_nothing_to_learn_from(spark, docs):
    empty = docs.limit(0)
    assert language.learn_dictionaries(empty) == {}
    assert language.identify(empty, {}).count() == 0
    got = language.identify(docs.limit(1), {}).select("language.*").first()
    assert (got["lang"], got["rejected"]) == ("und", False)


def test_query(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_language"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(120))
    assert {r["held_out"] for r in got} == {True, False}
