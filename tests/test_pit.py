import datetime as dt
import json

import pytest

from barquet.operators import pit
from barquet.sources import text

D = dt.date.fromisoformat
POINTS = "market string, ticker string, start date, period_end date, filed date, val double, fy int"


def points(spark, rows):
    """(ticker, start, end, filed, value, fiscal year)"""
    return spark.createDataFrame([("M", t, D(a), D(b), D(c), float(v), fy) for t, a, b, c, v, fy in rows], POINTS)


# A year from July to June, and a second company whose year ends in January.
JUNE = [
    ("june", "2020-07-01", "2020-09-30", "2020-10-20", 8, 2021),
    ("june", "2020-07-01", "2020-12-31", "2021-01-25", 21, 2021),  # six months
    ("june", "2020-10-01", "2020-12-31", "2021-01-25", 13, 2021),
    ("june", "2020-07-01", "2021-03-31", "2021-04-22", 26, 2021),  # nine months
    ("june", "2021-01-01", "2021-03-31", "2021-04-22", 5, 2021),
    ("june", "2020-07-01", "2021-06-30", "2021-09-01", 57, 2021),
    ("june", "2020-07-01", "2021-06-30", "2021-12-10", 60, 2022),  # the year, restated
]
JANUARY = [
    ("jan", "2021-02-01", "2021-04-30", "2021-05-28", 3, 2021),
    ("jan", "2021-08-01", "2021-10-31", "2021-11-30", 4, 2021),  # the second quarter is missing
    ("jan", "2021-02-01", "2022-01-31", "2022-03-15", 19, 2021),
    ("jan", "2021-02-01", "2021-04-30", "2022-06-01", 2, 2022),  # restated a year later
]


def test_quarters_by_fiscal_calendar(spark):
    rows = pit.quarterly_series(points(spark, JUNE + JANUARY)).collect()
    got = {(r["ticker"], str(r["period_end"])): (r["val"], str(r["filed"])) for r in rows}
    assert got == {
        ("june", "2020-09-30"): (8.0, "2020-10-20"), ("june", "2020-12-31"): (13.0, "2021-01-25"),
        ("june", "2021-03-31"): (5.0, "2021-04-22"), ("june", "2021-06-30"): (31.0, "2021-09-01"),
        ("jan", "2021-04-30"): (3.0, "2021-05-28"), ("jan", "2021-10-31"): (4.0, "2021-11-30"),
    }


def test_instant_keeps_the_first_filing_of_each_key(spark):
    rows = [(t, "2021-01-01", "2021-06-30", f, v, 1) for t, f, v in (("a", "2021-08-09", 41), ("a", "2021-07-30", 44), ("b", "2021-08-01", 7))]
    assert {r["ticker"]: r["val"] for r in pit.instant_series(points(spark, rows)).collect()} == {"a": 44.0, "b": 7.0}


PROBE = "market string, ticker string, d date, close double"
SERIES = "market string, ticker string, period_end date, filed date, val double"


def probes(spark, days, close=12.5, ticker="june"):
    return spark.createDataFrame([("M", ticker, D(d), close) for d in days], PROBE)


def test_latest_period_known_and_not_latest_filing(spark):
    filings = [("2021-06-30", "2021-08-02", 31.0), ("2021-03-31", "2021-08-02", 29.0), ("2020-12-31", "2021-10-04", 20.0), ("2021-09-30", "2021-11-01", 33.0)]
    series = spark.createDataFrame([("M", "june", D(e), D(f), v) for e, f, v in filings], SERIES)
    days = ["2021-08-01", "2021-08-02", "2021-10-05", "2021-11-01"]
    got = pit.known_at(probes(spark, days), series, "val", "v").orderBy("d").collect()
    assert [r["v"] for r in got] == [None, 31.0, 31.0, 33.0]


def test_trailing_sum_waits_for_four_quarters(spark):
    state = pit.trailing_sum(pit.quarterly_series(points(spark, JUNE)))
    got = pit.known_at(probes(spark, ["2021-08-31", "2021-09-01", "2022-01-01"]), state, "ttm", "ttm", rank="filed")
    assert [r["ttm"] for r in got.orderBy("d").collect()] == [None, 57.0, 57.0]


def test_surprise_by_hand(spark):
    vals = [10, 12, 11, 13, 14, 15, 13, 18, 21, 17]
    rows = []
    for i, v in enumerate(vals):
        end = dt.date(2015 + i // 4, 3 * (i % 4) + 1, 28)
        rows.append(("M", "X", end, end + dt.timedelta(days=30), float(v)))
    q = spark.createDataFrame(rows, "market string, ticker string, period_end date, filed date, val double")
    got = [r["sue"] for r in pit.standardised_surprise(q).orderBy("filed").collect()]
    yoy = [vals[i] - vals[i - 4] for i in range(4, len(vals))]
    prior = yoy[:-1]
    mean = sum(prior) / len(prior)
    sd = (sum((x - mean) ** 2 for x in prior) / (len(prior) - 1)) ** 0.5
    assert got[:7] == [None] * 7 and got[-1] == pytest.approx((yoy[-1] - mean) / sd)


def test_ratios(spark):
    one = lambda v, filed: spark.createDataFrame([("M", "june", D("2021-06-30"), D(filed), v)], SERIES)
    ends = (("2020-09-30", 6.0), ("2020-12-31", -2.0), ("2021-03-31", 9.0), ("2021-06-30", 7.0))
    quarters = spark.createDataFrame([("M", "june", D(e), D("2021-09-01"), v) for e, v in ends], SERIES)
    days = ["2021-08-15", "2021-08-20", "2021-09-02"]
    got = pit.value_ratios(probes(spark, days, 12.5), one(340.0, "2021-08-20"), one(16.0, "2021-08-18"), quarters).orderBy("d").collect()
    assert [r["book_to_market"] for r in got] == [None, pytest.approx(340 / 200), pytest.approx(340 / 200)]
    assert [r["earnings_yield"] for r in got] == [None, None, pytest.approx(20 / 200)]


def test_macro_csv_and_as_of(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("observation_date,RATE\n2019-05-06,3.25\nno date,1.0\n2019-05-07,.\n2019-05-08,\n2019-05-10,-0.75\n")
    series = text.load_macro_csv(spark, str(path))
    assert [r["val"] for r in series.orderBy("d").collect()] == [3.25, -0.75]
    asked = spark.createDataFrame([(D(d),) for d in ("2019-05-05", "2019-05-06", "2019-05-09", "2019-06-01")], "d date")
    got = pit.as_of_series(asked, series.withColumnRenamed("val", "v")).orderBy("d").collect()
    assert [r["v"] for r in got] == [None, 3.25, 3.25, -0.75]


def test_fundamentals_folder(spark, tmp_path):
    point = {"period_end": "2023-03-31", "filed": "2023-05-01", "val": 10.0}
    (tmp_path / "X.json").write_text(json.dumps({"ticker": "X", "ni_quarterly": [point, {"filed": "2023-05-01"}], "equity": [point], "shares": []}, indent=1))
    (tmp_path / "_skip.json").write_text(json.dumps({"ticker": "S", "equity": [point]}))
    (tmp_path / "bad.json").write_text("{nope")
    got = text.load_fundamentals(spark, str(tmp_path)).collect()
    assert sorted((r["ticker"], r["concept"], r["val"]) for r in got) == [("X", "equity", 10.0), ("X", "ni_quarterly", 10.0)]
