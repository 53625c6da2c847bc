import math

import pytest
from helpers import as_dict, bars_frame, day, path_rows

from barquet.operators import indexing as ix
from barquet.operators import returns as rt


def series(spark, values):
    return spark.createDataFrame([("M", day(i), float(v)) for i, v in enumerate(values)], "market string, d date, r double")


def test_two_name_day(spark):
    bars = bars_frame(spark, path_rows("A", [100.0, 110.0]) + path_rows("B", [100.0, 90.0]))
    assert rt.equal_weight_returns(bars).first()["r"] == pytest.approx(0.0)


def test_a_hole_drops_the_return_and_is_not_bridged(spark):
    a = path_rows("A", [100.0, 110.0, 121.0])
    b = path_rows("B", [100.0, 50.0, 400.0])
    bars = bars_frame(spark, a + [b[0], b[2]])
    got = as_dict(rt.equal_weight_returns(bars), "d", "r")
    assert got == {day(1): pytest.approx(0.1), day(2): pytest.approx(0.1)}


def test_robust_index_skips_the_ragged_tail(spark):
    rows = []
    for t in "ABCD":
        rows += path_rows(t, [100.0, 101.0])
    rows += [("NASDAQ", "A", day(2), 101.0, 300.0, 101.0, 300.0, 1)]
    assert as_dict(rt.robust_index_returns(bars_frame(spark, rows)), "d", "r") == {day(1): pytest.approx(0.01)}


def test_partial_today_is_left_out(spark):
    rows = []
    for t in "ABCD":
        rows += path_rows(t, [100.0, 101.0, 50.0])
    got = rt.robust_index_returns(bars_frame(spark, rows), exclude_from=day(2))
    assert as_dict(got, "d", "r") == {day(1): pytest.approx(0.01)}


def test_ewma_by_hand(spark):
    rs = [0.02, -0.03, 0.01, 0.04]
    var, want = None, []
    for r in rs:
        var = r * r if var is None else 0.94 * var + 0.06 * r * r
        want.append(var)
    got = [r["var"] for r in ix.ewma_variance(series(spark, rs)).orderBy("d").collect()]
    assert got == [pytest.approx(v, rel=1e-12) for v in want]


def test_scalar_waits_for_twenty_returns_and_excludes_its_own_day(spark):
    rs = [0.05 if i % 2 else -0.05 for i in range(30)]
    rows = ix.vol_scalar(series(spark, rs), 0.12).orderBy("d").collect()
    assert [r["scalar"] for r in rows[:20]] == [1.0] * 20 and rows[20]["scalar"] == 0.25
    calm_then_crash = [0.001] * 25 + [0.5]
    rows = ix.vol_scalar(series(spark, calm_then_crash), 0.12).orderBy("d").collect()
    assert rows[25]["scalar"] == 1.0


def test_crash_is_shallower_with_a_target(spark):
    rs = [0.003] * 60 + [-0.07 if i % 2 == 0 else 0.04 for i in range(40)]
    daily = ix.managed_index(series(spark, rs), 0.12)
    managed = rt.daily_metrics(daily.select("market", "d", daily.r_strat.alias("r"))).first()
    naive = rt.daily_metrics(series(spark, rs)).first()
    assert managed["max_drawdown"] > naive["max_drawdown"]


def test_trend_gate_leaves_the_bear_market(spark):
    rs = [0.002] * 250 + [-0.01] * 120
    rows = ix.trend_gate(series(spark, rs), 200).orderBy("d").collect()
    level, levels, want = 1.0, [1.0], []
    for r in rs:
        want.append(True if len(levels) < 200 else levels[-1] > sum(levels[-200:]) / 200)
        level *= 1 + r
        levels.append(level)
    assert [r["in_market"] for r in rows] == want and not want[-1]


def test_latest_exposure_uses_the_last_return(spark):
    rs = [0.002] * 250 + [-0.02] * 100
    assert ix.latest_exposure(series(spark, rs), 0.15, 200).first()["exposure"] == 0.0
    assert ix.latest_exposure(series(spark, [0.001] * 30), 0.15, 200).first()["exposure"] == 1.0


def test_compounding_through_zero_and_negative_growth(spark):
    got = [r["equity"] for r in rt.compounded(series(spark, [0.1, -2.0, -0.5, -1.0, 0.3])).orderBy("d").collect()]
    assert got == [pytest.approx(x) for x in (1.1, -1.1, -0.55, 0.0, 0.0)]


def test_daily_metrics_by_hand(spark):
    rs = [0.01, -0.02, 0.03]
    got = rt.daily_metrics(series(spark, rs)).first()
    mean = sum(rs) / 3
    sd = math.sqrt(sum((r - mean) ** 2 for r in rs) / 2)
    assert got["sharpe"] == pytest.approx(mean / sd * math.sqrt(252)) and got["max_drawdown"] == pytest.approx(-0.02)
    assert got["cagr"] == pytest.approx((1.01 * 0.98 * 1.03) ** 84 - 1)


def test_period_metrics_peak_starts_at_the_capital(spark):
    curve = spark.createDataFrame([("M", day(0), 90.0), ("M", day(365), 95.0)], "market string, d date, equity double")
    got = rt.period_metrics(curve, series(spark, [-0.1, 0.05]), init=100.0).first()
    assert got["max_dd"] == pytest.approx(0.1) and got["cagr"] == pytest.approx(0.95 ** (365.25 / 365) - 1)


def test_buy_and_hold_keeps_missing_slices_at_cost(spark):
    bars = bars_frame(spark, path_rows("A", [100.0, 120.0, 150.0]) + path_rows("B", [10.0, 20.0]))
    got = [r["equity"] for r in rt.buy_and_hold_curve(bars, 100.0).orderBy("d").collect()]
    assert got == [pytest.approx(100.0), pytest.approx(160.0), pytest.approx(125.0)]
    assert rt.buy_and_hold(bars).first()["buy_and_hold"] == pytest.approx(0.75)


def test_index_report_has_both_sides_and_a_least_length(spark):
    rs = [0.01, -0.02, 0.015, 0.0] * 10
    daily = ix.managed_index(series(spark, rs), 0.12)
    got = ix.index_report(daily).first().asDict()
    equity = 1.0
    for r in rs:
        equity *= 1 + r
    assert got["bench_final_equity"] == pytest.approx(equity) and got["bench_n_days"] == got["n_days"] == 40
    with pytest.raises(Exception, match="5 returns; a report needs at least 30"):
        ix.index_report(ix.managed_index(series(spark, rs[:5]), 0.12)).collect()
