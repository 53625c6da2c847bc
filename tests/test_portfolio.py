import datetime as dt

import pytest
from helpers import as_dict, bars_frame, path_rows

from barquet.operators import portfolio as pf
from barquet.operators.returns import calendar


def drifts(spark, names=12, days=420, base=0.0):
    rows = []
    for k in range(names):
        g = base + 0.0003 * (k - names // 2)
        rows += path_rows(f"S{k:02d}", [100.0 * (1 + g) ** i for i in range(days)], start="2016-01-01", pad=1.0)
    return bars_frame(spark, rows)


def test_rebalance_dates(spark):
    bars = bars_frame(spark, path_rows("A", [1.0] * 70, start="2020-01-15"))
    got = pf.rebalance_dates(calendar(bars)).orderBy("k").collect()
    assert [str(r["exec_d"]) for r in got] == ["2020-02-01", "2020-03-01"]
    assert [str(r["signal_d"]) for r in got] == ["2020-01-31", "2020-02-29"]
    assert str(got[0]["next_signal_d"]) == "2020-02-29" and got[1]["next_signal_d"] is None


def test_top_k_beats_the_basket_and_the_basket_rises(spark):
    monthly = pf.equal_weight_backtest(drifts(spark, base=0.0005), 252, 21, 0.25, 3, 5)
    got = as_dict(pf.backtest_metrics(monthly), "strategy", "end_value")
    assert got["strategy"] > got["benchmark"] > pf.INIT


def test_momentum_backtest_by_hand(spark):
    closes = {"W": 0.001, "F": 0.0, "L": -0.001, "X": 0.0005}
    rows = []
    for t, g in closes.items():
        rows += path_rows(t, [100.0 * (1 + g) ** i for i in range(330)], start="2018-01-01", market="KOSPI")
    log, curve = pf.momentum_backtest(bars_frame(spark, rows), 252, 21, 0.5, 2, 2)
    first = log.filter("held > 0").orderBy("k").first()
    assert first["held"] == 2 and first["turnover"] == pytest.approx(0.5)
    assert first["cost"] == pytest.approx(1.40527 / 10_000)
    later = log.filter("held > 0").orderBy("k").collect()[1]
    assert later["turnover"] == 0.0 and later["cost"] == 0.0
    days = (later["signal_d"] - first["signal_d"]).days
    assert later["period_r"] == pytest.approx(0.5 * (1.001 ** days - 1) + 0.5 * (1.0005 ** days - 1))
    assert curve.count() == log.count() + 1


def test_ties_go_by_ticker_and_small_groups_stay_in_cash(spark):
    rows = [("M", t, 0, 1.0) for t in "CABD"] + [("M", "A", 1, 1.0)]
    scores = spark.createDataFrame(rows, "market string, ticker string, k long, score double")
    got = sorted((r["k"], r["ticker"]) for r in pf.top_k(scores, 0.3, 2, 3).collect())
    assert got == [(0, "A"), (0, "B")]


@pytest.mark.parametrize(
    "exposure,price,cash,shares,equity,want",
    [(1.0, 100.0, 1000.0, 0, None, ("BUY", 10)), (1.0, 0.0, 1000.0, 0, None, ("HOLD", 0)), (0.0, 100.0, 0.0, 10, None, ("SELL", 10)),
     (1.0, 100.0, 300.0, 0, 10_000.0, ("HOLD", 0)), (1.0, 100.0, 900.0, 0, 10_000.0, ("BUY", 9)), (0.5, 100.0, 480.0, 5, None, ("SELL", 1)), (0.5, 100.0, 520.0, 5, None, ("HOLD", 0))],
)
def test_rebalance_decision(spark, exposure, price, cash, shares, equity, want):
    df = spark.createDataFrame([(exposure, price, cash, shares, equity)], "exposure double, price double, cash double, shares long, equity_krw double")
    got = pf.rebalance_decisions(df).first()
    assert (got["side"], got["qty"]) == want


def test_funding_basket_by_hand(spark):
    d = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("A", d(i), 0.01) for i in range(20)] + [("B", d(i), -0.02) for i in range(20)]
    daily = spark.createDataFrame(rows, "coin string, d date, rate double")
    periods = spark.createDataFrame([("p", d(0), d(30))], "period string, start date, end date")
    got = [r["r"] for r in pf.funding_basket(daily, periods).orderBy("d").collect()]
    # no trailing mean on the first date, so nothing is held until the second rebalance
    assert got[:7] == [0.0] * 7 and got[7] == pytest.approx(0.01 - 0.002) and got[8:14] == [0.01] * 6 and got[14] == 0.01


def test_trailing_funding_needs_three_days_and_spans_blocks(spark):
    d = lambda i: dt.date(2023, 12, 20) + dt.timedelta(days=i)
    daily = spark.createDataFrame([("A", d(i), float(i)) for i in range(0, 40)], "coin string, d date, rate double")
    got = [r["trail"] for r in pf.trailing_funding(daily).orderBy("d").collect()]
    assert got[:2] == [None, None] and got[2] == 1.0 and got[10:] == [i - 3.0 for i in range(10, 40)]
