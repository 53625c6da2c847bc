import datetime as dt

import pytest
from helpers import as_dict, day
from pyspark.sql import functions as F

from barquet.operators import quality as qa
from barquet.sources import cleaning

SCHEMA = "market string, ticker string, d date, open double, high double, low double, close double, volume long, ingest_seq long"


def bars(spark, closes, days=None, **edit):
    rows = []
    for i, c in enumerate(closes):
        d = day(i, "2024-01-02") if days is None else days[i]
        row = dict(market="M", ticker="T", d=d, open=c, high=c * 1.001, low=c * 0.999, close=c, volume=1000, ingest_seq=i)
        row.update(edit.get(f"row{i}", {}))
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, *args, **kw):
    return as_dict(qa.issues(qa.issue_counts(bars(spark, *args, **kw))), "code", "count")


def test_clean_series_passes(spark):
    counts = qa.issue_counts(bars(spark, [100.0, 101.0, 102.0]))
    assert qa.issues(counts).count() == 0 and qa.report(counts).first()["passed"]


@pytest.mark.parametrize("jump,hit", [(1.40, False), (1.41, True)])
def test_extreme_return_boundary(spark, jump, hit):
    assert ("EXTREME_RETURN" in found(spark, [100.0, 100.0 * jump + (1e-9 if hit else -1e-9)])) == hit


@pytest.mark.parametrize("run,hit", [(5, False), (6, True)])
def test_stale_run_boundary(spark, run, hit):
    assert ("STALE_PRICE_RUN" in found(spark, [9.0] + [10.0] * run + [11.0])) == hit


def test_duplicates_order_and_prices(spark):
    days = [day(0), day(1), day(1), day(0)]
    got = found(spark, [10.0, 10.1, 10.2, 10.3], days, row1=dict(volume=0), row2=dict(low=-1.0), row3=dict(high=1.0))
    assert got == {"DUPLICATE_TIMESTAMPS": 2, "NOT_SORTED": 2, "NONPOSITIVE_PRICE_OR_NEG_VOLUME": 1, "OHLC_INCONSISTENT": 1, "ZERO_VOLUME": 1}


def test_too_few_bars_hides_the_rest(spark):
    names = spark.createDataFrame([("M", "T"), ("M", "EMPTY")], "market string, ticker string")
    counts = qa.issue_counts(bars(spark, [-5.0]), names)
    assert [(r["code"], r["count"]) for r in qa.issues(counts).collect()] == [("TOO_FEW_BARS", 1)] * 2


def weekday_gap(before, now):
    gap = (now - before).days
    if gap > 14:
        return gap - 2 * ((gap + before.weekday()) // 7)
    return sum((before + dt.timedelta(days=k)).weekday() < 5 for k in range(1, gap))


def test_weekday_gap_formula(spark):
    pairs = [(day(a), day(a + g)) for a in range(7) for g in range(1, 40)]
    df = spark.createDataFrame(pairs, "a date, b date").withColumn("g", qa.weekday_gap(F.col("a"), F.col("b")))
    assert all(r["g"] == weekday_gap(r["a"], r["b"]) for r in df.collect())


def test_fx_codes(spark):
    rates = [("1300", None), ("x", "FX_BAD"), (None, "FX_BAD"), ("NaN", "FX_NAN"), ("0", "FX_NONPOSITIVE"), ("1e8", "FX_OUT_OF_BAND"), ("1e-7", "FX_OUT_OF_BAND")]
    df = spark.createDataFrame(rates, "rate string, want string").withColumn("code", qa.fx_check(F.col("rate")))
    assert all(r["code"] == r["want"] for r in df.collect())


def test_stale_and_missing_symbols(spark):
    names = spark.createDataFrame([("M", "T"), ("M", "NONE")], "market string, ticker string")
    data = bars(spark, [1.0, 1.0], [dt.date(2026, 1, 1), dt.date(2026, 1, 14)])
    got = as_dict(qa.staleness(data, names, F.lit("2026-01-20").cast("date")), "ticker", "code")
    assert got == {"T": "STALE", "NONE": "NO_BARS"}
    assert qa.staleness(data, names, F.lit("2026-01-19").cast("date")).count() == 1


def test_noise_is_repaired_and_garbage_dropped(spark):
    data = bars(spark, [100.0, 100.0, 100.0], row0=dict(high=100.0 - 1e-9, low=99.0), row1=dict(high=90.0), row2=dict(close=None))
    out = cleaning.clean(data).collect()
    assert len(out) == 1 and out[0]["high"] == 100.0
    many = bars(spark, [100.0] * 20, **{f"row{i}": dict(high=50.0) for i in range(6)})
    assert cleaning.clean(many).count() == 0
