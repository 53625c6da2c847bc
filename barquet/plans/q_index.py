"""Calendar, index, curve and risk-managed index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.operators import indexing as ix
from barquet.operators import returns as rt
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.session import staged
from barquet.sources.bridge import bars_day

define(
    "pairs",
    """SELECT a.market, a.ticker, c0.d AS d0, c1.d AS d1, a.close AS p0, b.close AS p1
FROM cal c1 JOIN cal c0 ON c0.market = c1.market AND c0.i = c1.i - 1
JOIN bars a ON a.market = c0.market AND a.d = c0.d
JOIN bars b ON b.market = c1.market AND b.d = c1.d AND b.ticker = a.ticker""",
    ("bars", "cal"),
)
define(
    "ew",
    "SELECT market, d1 AS d, avg(p1 / p0 - 1.0) AS r, count(*) AS n FROM pairs WHERE p0 > 0 GROUP BY market, d1",
    ("pairs",),
)
# The prices of the driver tables jump wildly: curves take a hundredth of the centred index return.
define("dew", """SELECT market, d, (r - m) * 0.01 + 0.0003 AS r
FROM ew JOIN (SELECT market, round(avg(r), 6) AS m FROM ew GROUP BY market) USING (market)""", ("ew",))
define(
    "eq",
    """SELECT market, d, r, equity, max(equity) OVER (PARTITION BY market ORDER BY d) AS peak
FROM (SELECT market, d, r, product(1 + r) OVER (PARTITION BY market ORDER BY d) AS equity FROM dew)""",
    ("dew",),
)
def _closes(spark, sf):
    """Daily closes, written once: calendar and both ends of a return read them."""
    return staged(bars_day(spark, sf).select("market", "ticker", "d", "close"))


def _ew(spark, sf):
    raw = staged(rt.equal_weight_returns(_closes(spark, sf)))
    mean = raw.groupBy("market").agg(F.round(F.avg("r"), 6).alias("m"))
    return staged(raw.join(mean, "market").select("market", "d", ((F.col("r") - F.col("m")) * 0.01 + 0.0003).alias("r")))


METRICS = """count(*) AS n_days, round(power(arg_max(equity, d), 252.0 / count(*)) - 1, 8) AS cagr,
round(stddev_samp(r) * sqrt(252), 8) AS ann_vol, round(avg(r) / stddev_samp(r) * sqrt(252), 8) AS sharpe,
round(min((equity - peak) / peak), 8) AS max_drawdown, round(arg_max(equity, d), 8) AS final_equity"""


@query("st1_union_calendar", sql("cal", "SELECT market, d, i FROM cal"))
def st1(spark, sf):
    return rt.calendar(bars_day(spark, sf)).select("market", "d", F.col("i").cast("long").alias("i"))


@query(
    "jn13_neighbour_pairs",
    sql("pairs", "SELECT market, ticker, d0, d1, round(p0, 8) AS p0, round(p1, 8) AS p1 FROM pairs"),
)
def jn13(spark, sf):
    bars = bars_day(spark, sf)
    return rounded(rt.neighbour_pairs(bars, rt.calendar(bars)).drop("i"))


@query("ag14_equal_weight_returns", sql("ew", "SELECT market, d, round(r, 8) AS r, n FROM ew"))
def ag14(spark, sf):
    return rounded(rt.equal_weight_returns(_closes(spark, sf)))


@query("ag5_daily_metrics", sql("eq", f"SELECT market, {METRICS} FROM eq GROUP BY market"))
def ag5(spark, sf):
    return rounded(rt.daily_metrics(_ew(spark, sf)))


@query(
    "rn6_equity_curve",
    sql("eq", """SELECT market, d, round(equity, 6) AS equity, round(peak, 6) AS peak,
round((equity - peak) / peak, 8) + 0.0 AS drawdown FROM eq"""),
)
def rn6(spark, sf):
    curve = rt.compounded(_ew(spark, sf))
    return rounded(rt.drawdowns(curve).drop("r"), equity=6, peak=6)


@query(
    "ag3_total_return",
    sql("eq", "SELECT market, round(arg_max(equity, d) / arg_min(equity, d) - 1, 8) AS total_return FROM eq GROUP BY market"),
)
def ag3(spark, sf):
    return rounded(rt.total_return(rt.compounded(_ew(spark, sf))))


@query(
    "ag4_max_drawdown",
    sql("eq", "SELECT market, round(min((equity - peak) / peak), 8) AS max_drawdown FROM eq GROUP BY market"),
)
def ag4(spark, sf):
    return rounded(rt.max_drawdown(rt.compounded(_ew(spark, sf))))


@query(
    "ag7_log_metrics",
    sql("eq", """, steps AS (SELECT *, lag(equity) OVER (PARTITION BY market ORDER BY d) AS prev FROM eq),
agg AS (SELECT market, count(*) AS n_bars, power(arg_max(equity, d) / arg_min(equity, d), 252.0 / count(*)) - 1 AS cagr,
  min((equity - peak) / peak) AS mdd, avg(ln(equity / prev)) AS m, stddev_samp(ln(equity / prev)) AS sd FROM steps GROUP BY market)
SELECT market, n_bars, round(cagr, 8) AS cagr, round(mdd, 8) AS max_drawdown, round(m / sd * sqrt(252), 8) AS sharpe,
  round(sd * sqrt(252), 8) AS vol, round(cagr / abs(mdd), 8) AS calmar FROM agg"""),
)
def ag7(spark, sf):
    return rounded(rt.log_metrics(rt.compounded(_ew(spark, sf))))


@query(
    "ag1_buy_and_hold",
    sql("bars", """SELECT round(avg(p1 / p0 - 1), 8) AS buy_and_hold, count(*) AS symbols FROM
(SELECT market, ticker, arg_min(close, d) AS p0, arg_max(close, d) AS p1 FROM bars GROUP BY ALL) WHERE p0 > 0"""),
)
def ag1(spark, sf):
    return rounded(rt.buy_and_hold(bars_day(spark, sf)))


@query(
    "ag2_buy_and_hold_curve",
    sql("bars", """, f AS (SELECT market, ticker, arg_min(close, d) AS p0 FROM bars GROUP BY ALL),
g AS (SELECT DISTINCT market, d FROM bars)
SELECT g.market, g.d, round(sum(10000000.0 / n * coalesce(b.close / f.p0, 1)), 4) AS equity
FROM g JOIN f USING (market) JOIN (SELECT market, count(*) AS n FROM f GROUP BY market) USING (market)
LEFT JOIN bars b ON b.market = g.market AND b.ticker = f.ticker AND b.d = g.d GROUP BY g.market, g.d"""),
)
def ag2(spark, sf):
    return rounded(rt.buy_and_hold_curve(bars_day(spark, sf)), 4)


ROBUST = """, names AS (SELECT market, count(DISTINCT ticker) AS names FROM bars GROUP BY market),
seen AS (SELECT * FROM bars {where}),
kept AS (SELECT market, d FROM seen JOIN names USING (market) GROUP BY market, d, names HAVING count(*) / names >= 0.5),
kc AS (SELECT market, d, lag(d) OVER (PARTITION BY market ORDER BY d) AS d0 FROM kept)
SELECT kc.market, kc.d, round(avg(b.close / a.close - 1), 8) AS r, count(*) AS n
FROM kc JOIN seen a ON a.market = kc.market AND a.d = kc.d0
JOIN seen b ON b.market = kc.market AND b.d = kc.d AND b.ticker = a.ticker
JOIN names ON names.market = kc.market WHERE a.close > 0
GROUP BY kc.market, kc.d, names HAVING count(*) >= names * 0.5"""


@query("ag15_robust_index", sql("bars", ROBUST.format(where="")))
def ag15(spark, sf):
    return rounded(rt.robust_index_returns(bars_day(spark, sf)))


@query("flt6_exclude_partial", sql("bars", ROBUST.format(where="WHERE d < DATE '1998-06-01'")))
def flt6(spark, sf):
    return rounded(rt.robust_index_returns(bars_day(spark, sf), exclude_from="1998-06-01"))


define(
    "ranked",
    "SELECT market, d, r, row_number() OVER (PARTITION BY market ORDER BY d) AS t FROM dew",
    ("dew",),
)
define(
    "ewma",
    """WITH RECURSIVE go AS (
SELECT market, t, r * r AS var FROM ranked WHERE t = 1
UNION ALL
SELECT n.market, n.t, 0.94 * go.var + (1 - 0.94) * n.r * n.r FROM go JOIN ranked n ON n.market = go.market AND n.t = go.t + 1)
SELECT ranked.market, d, r, ranked.t, var,
  CASE WHEN ranked.t < 20 THEN 1.0 ELSE greatest(0.25, least(1.0, {target} / greatest(sqrt(var) * sqrt(252), 0.02))) END AS scalar_incl
FROM go JOIN ranked USING (market, t)""".replace("{target}", "0.12"),
    ("ranked",),
)
define("ewma15", """SELECT market, d, r, t, CASE WHEN t < 20 THEN 1.0 ELSE
greatest(0.25, least(1.0, 0.15 / greatest(sqrt(var) * sqrt(252), 0.02))) END AS scalar_incl FROM ewma""", ("ewma",))
define(
    "gate",
    """SELECT market, d, t, level, sma_incl, in_incl,
  coalesce(lag(in_incl) OVER (PARTITION BY market ORDER BY t), 1 >= {w} AND false OR true) AS in_market
FROM (SELECT *, CASE WHEN t + 1 >= {w} THEN level > sma_incl ELSE true END AS in_incl FROM (
SELECT market, d, t, level, avg(level) OVER (PARTITION BY market ORDER BY t ROWS BETWEEN {w} - 1 PRECEDING AND CURRENT ROW) AS sma_incl
FROM (SELECT market, d, t, product(1 + r) OVER (PARTITION BY market ORDER BY t) AS level FROM ranked
      UNION ALL SELECT DISTINCT market, NULL, 0, 1.0 FROM ranked))) """.replace("{w}", "200"),
    ("ranked",),
)
define(
    "managed",
    """SELECT market, d, r, scalar, in_market, scalar * CASE WHEN in_market THEN 1.0 ELSE 0.0 END AS exposure,
  scalar * CASE WHEN in_market THEN 1.0 ELSE 0.0 END * r AS r_strat
FROM (SELECT market, d, r, t, coalesce(lag(scalar_incl) OVER (PARTITION BY market ORDER BY t), 1.0) AS scalar FROM ewma)
JOIN (SELECT market, t, in_market FROM gate) USING (market, t)""",
    ("ewma", "gate"),
)


@query(
    "rn1_vol_target_scalar",
    sql("ewma", """SELECT market, d, round(var, 10) AS var,
round(coalesce(lag(scalar_incl) OVER (PARTITION BY market ORDER BY t), 1.0), 8) AS scalar FROM ewma"""),
)
def rn1(spark, sf):
    out = ix.vol_scalar(_ew(spark, sf), 0.12).select("market", "d", "var", "scalar")
    return rounded(out, var=10)


@query("rn2_trend_gate", sql("gate", "SELECT market, d, in_market FROM gate WHERE d IS NOT NULL"))
def rn2(spark, sf):
    return ix.trend_gate(_ew(spark, sf), 200).select("market", "d", "in_market")


@query(
    "rn3_managed_index",
    sql("managed", f""", e AS (SELECT market, d, r_strat AS r, product(1 + r_strat) OVER (PARTITION BY market ORDER BY d) AS equity FROM managed),
p AS (SELECT *, max(equity) OVER (PARTITION BY market ORDER BY d) AS peak FROM e),
x AS (SELECT market, round(avg(exposure), 8) AS avg_exposure, round(avg(CASE WHEN in_market THEN 1.0 ELSE 0.0 END), 8) AS time_in_market,
  round(arg_max(exposure, d), 8) AS latest_exposure FROM managed GROUP BY market),
be AS (SELECT market, d, r, product(1 + r) OVER (PARTITION BY market ORDER BY d) AS equity FROM managed),
bp AS (SELECT *, max(equity) OVER (PARTITION BY market ORDER BY d) AS peak FROM be)
SELECT s.*, x.avg_exposure, x.time_in_market, x.latest_exposure, b.n_days AS bench_n_days, b.cagr AS bench_cagr, b.ann_vol AS bench_ann_vol,
b.sharpe AS bench_sharpe, b.max_drawdown AS bench_max_drawdown, b.final_equity AS bench_final_equity
FROM (SELECT market, {METRICS} FROM p GROUP BY market) s JOIN x USING (market) JOIN (SELECT market, {METRICS} FROM bp GROUP BY market) b USING (market)"""),
)
def rn3(spark, sf):
    return rounded(ix.index_report(staged(ix.managed_index(_ew(spark, sf), 0.12, window=200))))


@query(
    "rn4_latest_exposure",
    sql("ewma15 gate", """SELECT market, max(d) AS as_of, round(arg_max(scalar_incl * CASE WHEN in_incl THEN 1.0 ELSE 0.0 END, d), 8) AS exposure
FROM ewma15 JOIN (SELECT market, t, in_incl FROM gate) USING (market, t) GROUP BY market"""),
)
def rn4(spark, sf):
    return rounded(ix.latest_exposure(_ew(spark, sf), 0.15, 200))
