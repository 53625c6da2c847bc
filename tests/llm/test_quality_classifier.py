import numpy as np
import pytest
from llm.cases import awkward, clashing, prose, rows_of
from pyspark.sql import functions as F

from barquet.llm import quality, queries
from barquet.llm.common import fold


def test_linear_form_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    docs = [(np.sort(rng.choice(50, n, replace=False)), rng.normal(size=n)) for n in (1, 7, 20)]
    at, x = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    got = m.logits(at, x, np.array([0, 1, 8]))
    for z, (a, v) in zip(got, docs, strict=True):
        pairs = sum(m.v[a[i]] @ m.v[a[j]] * v[i] * v[j] for i in range(len(a)) for j in range(i))
        assert z == pytest.approx(0.3 + m.w[a] @ v + pairs)


def test_it_learns_an_interaction():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b]), np.ones(2)))
        labels.append(float(a != b))
    m = quality.train(rows, np.array(labels), 4)
    for a in (0, 1):
        for b in (0, 1):
            assert (m.logits(np.array([a, 2 + b]), np.ones(2), np.array([0]))[0] > 0) == (a != b)


def test_word_hashes_do_not_depend_on_the_place():
    read = lambda t: quality.word_hashes(np.frombuffer(t.encode(), np.uint8))
    h, n = read("Abc  de\nabc\tABC dé")
    assert n.tolist() == [3, 2, 3, 3, 3]
    assert h[0] == h[2] == h[3] and len(set(h.tolist())) == 3
    assert len(read("   ")[0]) == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(400):
        good = i % 3 != 0
        text = prose(i, 40 + i % 50)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), int(good), len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, n_chars long")


def test_held_out_accuracy_and_no_leak(spark, labelled):
    docs, labels = labelled.drop("quality"), labelled.select("doc_id", "quality")
    held = fold("doc_id", 3) == 1
    m = quality.learn(docs, labels, metadata=("n_chars",), train_rows=~held)
    got = labelled.filter(held).select("quality", quality.score(m, "text", ("n_chars",)).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.5) == (r["quality"] == 1) for r in got]) > 0.97
    spoilt = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.learn(docs, spoilt, metadata=("n_chars",), train_rows=~held)
    assert np.array_equal(m.w, again.w) and np.array_equal(m.v, again.v)


def test_awkward_rows(spark, labelled):
    m = quality.learn(labelled.drop("quality"), labelled.select("doc_id", "quality"), metadata=("n_chars",))
    scored = lambda d: d.select("doc_id", quality.score(m, "text", ("n_chars",)).alias("s"))
    got = scored(awkward(spark)).collect()
    assert len(got) == 14 and all(0.0 <= r["s"] <= 1.0 for r in got)
    assert rows_of(scored(awkward(spark))) == rows_of(scored(clashing(awkward(spark))))
    assert scored(awkward(spark).limit(0)).count() == 0


def test_no_labels(spark, labelled):
    m = quality.learn(labelled.drop("quality"), labelled.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert {r["s"] for r in labelled.limit(3).select(quality.score(m, "text").alias("s")).collect()} <= {0.5} or abs(m.w).sum() == 0


def test_query(spark, tmp_path, labelled):
    labelled.drop("quality").write.parquet(str(tmp_path / "documents.parquet"))
    labelled.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["op8_quality"](spark, str(tmp_path)).collect()
    assert len(got) == 400 and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
