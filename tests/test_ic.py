import pytest
from helpers import bars_frame, day, drift_panel, path_rows
from pyspark.sql import functions as F

from barquet.functions.signals import register_signal
from barquet.operators import ic
from barquet.operators.returns import calendar


def summary(spark, bars, name, **kw):
    windows = kw.pop("windows", None)
    rows, decisions = ic.cross_sections(bars, [name], windows, **kw)
    return ic.ic_summary(ic.information_coefficients(rows), decisions, [name]).first()


def test_planted_drift_is_found(spark):
    bars = drift_panel(spark)
    good = summary(spark, bars, "reversal_21", horizon=5)
    assert good["mean_rank_ic"] < -0.95
    register_signal("drift_21", 22, lambda f: F.col("close") / f.lag("close", 21) - 1.0)
    assert summary(spark, bars, "drift_21", horizon=5)["mean_rank_ic"] > 0.95


def test_noise_scores_nothing(spark):
    register_signal("noise", 1, lambda f: F.conv(F.substring(F.md5(F.concat("ticker", F.col("d").cast("string"))), 1, 8), 16, 10).cast("double"))
    got = summary(spark, drift_panel(spark), "noise", horizon=2, spacing=1)
    assert abs(got["mean_rank_ic"]) < 0.1 and got["n_periods"] > 50


def test_average_ranks_share_ties(spark):
    rows = spark.createDataFrame([("g", v, i) for i, v in enumerate([10.0, 30.0, 30.0, 20.0])], "g string, v double, i int")
    got = ic.average_ranks(rows, ["g"], "v", "r").orderBy("i").collect()
    assert [r["r"] for r in got] == [1.0, 3.5, 3.5, 2.0]


def test_degenerate_and_small_sections_are_counted(spark):
    rows = [("NASDAQ", f"S{k}", day(i), 10.0, 10.0, 10.0, 10.0, 1) for k in range(25) for i in range(40)]
    flat = summary(spark, bars_frame(spark, rows), "reversal_5", horizon=5)
    assert flat["n_periods"] == 0 and flat["n_skipped_degenerate"] > 0 and flat["mean_ic"] is None
    few = summary(spark, drift_panel(spark, names=5, days=40), "reversal_5", horizon=5)
    assert few["n_skipped_small_xs"] > 0 and few["n_periods"] == 0


def test_strict_split_drops_exits_past_the_end(spark):
    bars = bars_frame(spark, path_rows("A", [1.0 + i for i in range(60)]))
    windows = spark.createDataFrame([("NASDAQ", "w", day(10), day(40))], "market string, split string, start date, end date")
    cal = calendar(bars)
    strict = [r["i"] for r in ic.decision_dates(cal, windows, 5, 5).orderBy("i").collect()]
    loose = [r["i"] for r in ic.decision_dates(cal, windows, 5, 5, strict=False).orderBy("i").collect()]
    assert strict == [10, 15, 20, 25, 30] and loose == [10, 15, 20, 25, 30, 35]


def test_score_comes_from_the_last_bar_on_or_before_the_decision(spark):
    full = path_rows("A", [float(i + 1) for i in range(30)])
    holey = [r for i, r in enumerate(path_rows("B", [float(i + 1) for i in range(30)])) if i != 20]
    register_signal("close_itself", 1, lambda f: F.col("close"))
    rows, _ = ic.cross_sections(bars_frame(spark, full + holey), ["close_itself"], horizon=5, spacing=10)
    got = {(r["ticker"], r["d"]): r["score"] for r in rows.collect()}
    assert got[("A", day(20))] == 21.0 and got[("B", day(20))] == 20.0


def test_chronological_split(spark):
    rows = path_rows("A", [1.0, 2.0], start="2020-01-01")
    rows[-1] = rows[-1][:2] + (day(100),) + rows[-1][3:]
    got = {r["split"]: (r["start"], r["end"]) for r in ic.chronological_split(bars_frame(spark, rows)).collect()}
    assert got == {"train": (day(0), day(50)), "validation": (day(50), day(75)), "holdout": (day(75), day(100))}
    with pytest.raises(ValueError):
        ic.chronological_split(bars_frame(spark, rows), 0.5, 0.5, 0.5)
    short = bars_frame(spark, path_rows("A", [1.0, 2.0]))
    with pytest.raises(Exception, match="too short"):
        ic.chronological_split(short).collect()


def test_winsorised_returns_tie_at_the_ends(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in range(21)], "g string, fwd double")
    got = ic.winsorised(rows, ["g"], "fwd", 0.1).orderBy("fwd").collect()
    assert [r["fwd_w"] for r in got][:4] == [2.0, 2.0, 2.0, 3.0] and [r["fwd_rank"] for r in got][:4] == [2.0, 2.0, 2.0, 4.0]
    assert got[-1]["fwd_rank"] == 20.0


def test_the_holdout_stays_locked(spark):
    bars = drift_panel(spark, names=12, days=260)
    windows = ic.chronological_split(bars)
    scan = lambda **more: {(r["signal"], r["split"]) for r in ic.signal_scan(bars, ["reversal_5", "reversal_21"], windows, 5, min_cross_section=3, **more).collect()}
    assert scan() == {(s, w) for s in ("reversal_5", "reversal_21") for w in ("train", "validation")}
    assert scan(survivor="reversal_5") == {("reversal_5", "holdout")}


def test_least_cross_section_per_market(spark):
    got = spark.createDataFrame([("NASDAQ",), ("KOSPI",), ("other",)], "market string").select(ic.least_size({"NASDAQ": 30, "KOSPI": 20}).alias("n")).collect()
    assert [r["n"] for r in got] == [30, 20, 30]
