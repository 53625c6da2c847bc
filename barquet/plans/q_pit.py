"""Fundamentals and macro as known at a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.operators import pit
from barquet.operators.returns import calendar
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.session import staged
from barquet.sources.bridge import bars_day, duration_points, macro_long

define(
    "explicit",
    """SELECT market, ticker, period_end, min(filed) AS filed, arg_min(val, filed) AS val FROM points
WHERE period_end - start BETWEEN 80 AND 100 GROUP BY ALL""",
    ("points",),
)
define(
    "annual",
    """SELECT market, ticker, fy, arg_min(period_end, filed) AS period_end, min(filed) AS filed, arg_min(val, filed) AS val FROM points
WHERE period_end - start BETWEEN 350 AND 380 GROUP BY ALL""",
    ("points",),
)
define(
    "quarters",
    """SELECT * FROM explicit UNION ALL
SELECT market, ticker, a.period_end, a.filed, a.val - q.s FROM annual a JOIN (SELECT market, ticker, fy, sum(val) AS s, count(*) AS c FROM (
 SELECT e.market, e.ticker, t.fy, e.val, row_number() OVER (PARTITION BY e.market, e.ticker, t.fy ORDER BY e.period_end DESC) AS rn FROM explicit e
 JOIN (SELECT DISTINCT market, ticker, fy, period_end FROM points WHERE period_end - start BETWEEN 80 AND 100) t USING (market, ticker, period_end)
 JOIN annual a2 ON a2.market = e.market AND a2.ticker = e.ticker AND a2.fy = t.fy WHERE e.period_end < a2.period_end) WHERE rn <= 3 GROUP BY ALL) q USING (market, ticker, fy)
WHERE c = 3 AND NOT EXISTS (SELECT 1 FROM explicit x WHERE x.market = a.market AND x.ticker = a.ticker AND x.period_end = a.period_end)""",
    ("explicit", "annual"),
)
define(
    "qstate",
    """SELECT f.market, f.ticker, f.filed, list(q.val ORDER BY q.period_end) AS v FROM (SELECT DISTINCT market, ticker, filed FROM quarters) f
JOIN quarters q ON q.market = f.market AND q.ticker = f.ticker AND q.filed <= f.filed GROUP BY ALL""",
    ("quarters",),
)
define(
    "ttm",
    "SELECT market, ticker, filed, CASE WHEN len(v) >= 4 THEN list_sum(v[-4:]) END AS ttm FROM qstate",
    ("qstate",),
)
define(
    "sue",
    """SELECT market, ticker, filed, CASE WHEN len(v) >= 8 AND list_stddev_samp(prior) > 0 THEN (yoy[-1] - list_avg(prior)) / list_stddev_samp(prior) END AS sue
FROM (SELECT *, yoy[:-2] AS prior FROM (SELECT *, [v[i + 4] - v[i] for i in range(1, len(v) - 3)] AS yoy FROM qstate))""",
    ("qstate",),
)
define(
    "equity",
    """SELECT market, ticker, period_end, min(filed) AS filed, arg_min(val, filed) AS val FROM points WHERE form = '10-K' GROUP BY ALL""",
    ("points",),
)
define(
    "shares",
    """SELECT market, ticker, period_end, min(filed) AS filed, arg_min(val, filed) AS val FROM points WHERE form = '10-H' GROUP BY ALL""",
    ("points",),
)


def latest(series: str, bars: str = "bars") -> str:
    return f"""SELECT b.market, b.ticker, b.d, any_value(b.close) AS close, arg_max(s.val, s.period_end) AS val FROM {bars} b
LEFT JOIN {series} s ON s.market = b.market AND s.ticker = b.ticker AND s.filed <= b.d GROUP BY b.market, b.ticker, b.d"""


define("eq_at", latest("equity"), ("bars", "equity"))
define("sh_at", latest("shares"), ("bars", "shares"))
define("ttm_at", "SELECT b.market, b.ticker, b.d, t.ttm FROM bars b ASOF LEFT JOIN ttm t ON t.market = b.market AND t.ticker = b.ticker AND t.filed <= b.d", ("bars", "ttm"))
define("sue_at", "SELECT b.market, b.ticker, b.d, t.sue FROM bars b ASOF LEFT JOIN sue t ON t.market = b.market AND t.ticker = b.ticker AND t.filed <= b.d", ("bars", "sue"))


def _points(spark, sf):
    """The filed points, derived once: every branch of a query reads the written table."""
    return staged(duration_points(spark, sf), "points")


def _quarters(spark, sf):
    return staged(pit.quarterly_series(_points(spark, sf)), "quarters")


def _probes(spark, sf):
    return bars_day(spark, sf).select("market", "ticker", "d", "close")


@query("sc16_quarterly_series", sql("quarters", "SELECT market, ticker, period_end, filed, round(val, 2) + 0.0 AS val FROM quarters"))
def sc16(spark, sf):
    return rounded(pit.quarterly_series(_points(spark, sf)), 2)


@query("sc17_instant_series", sql("equity", "SELECT market, ticker, period_end, filed, round(val, 2) AS val FROM equity"))
def sc17(spark, sf):
    return rounded(pit.instant_series(duration_points(spark, sf).filter("form = '10-K'")), 2)


@query("jn2_as_of_period", sql("eq_at", "SELECT market, ticker, d, round(val, 2) AS equity FROM eq_at"))
def jn2(spark, sf):
    series = pit.instant_series(duration_points(spark, sf).filter("form = '10-K'"))
    return rounded(pit.known_at(_probes(spark, sf), series, "val", "equity").drop("close"), 2)


@query("jn3_trailing_sum", sql("ttm_at", "SELECT market, ticker, d, round(ttm, 2) + 0.0 AS ttm FROM ttm_at"))
def jn3(spark, sf):
    state = pit.trailing_sum(_quarters(spark, sf))
    return rounded(pit.known_at(_probes(spark, sf), state, "ttm", "ttm", rank="filed").drop("close"), 2)


@query("jn4_earnings_surprise", sql("sue", "SELECT market, ticker, filed, round(sue, 6) + 0.0 AS sue FROM sue"))
def jn4(spark, sf):
    return rounded(pit.standardised_surprise(_quarters(spark, sf)), 6)


@query("jn20_surprise_signal", sql("sue_at", "SELECT market, ticker, d, round(sue, 6) + 0.0 AS sue FROM sue_at"))
def jn20(spark, sf):
    state = pit.standardised_surprise(_quarters(spark, sf))
    return rounded(pit.known_at(_probes(spark, sf), state, "sue", "sue", rank="filed").drop("close"), 6)


@query(
    "jn5_macro_as_of",
    sql("cal macro_long", "SELECT c.market, c.d, m.val AS val FROM cal c ASOF LEFT JOIN macro_long m ON m.d <= c.d"),
)
def jn5(spark, sf):
    dates = calendar(bars_day(spark, sf)).select("market", "d")
    return pit.as_of_series(dates, macro_long(spark, sf).select("d", F.col("val").alias("v"))).withColumnRenamed("v", "val")


@query(
    "jn19_value_ratios",
    sql("eq_at sh_at ttm_at", """SELECT market, ticker, d, round(e.val / (close * s.val), 10) + 0.0 AS book_to_market, round(ttm / (close * s.val), 10) + 0.0 AS earnings_yield
FROM eq_at e JOIN (SELECT market, ticker, d, CASE WHEN val > 0 THEN val END AS val FROM sh_at) s USING (market, ticker, d) JOIN ttm_at USING (market, ticker, d)"""),
)
def jn19(spark, sf):
    points = _points(spark, sf)
    out = pit.value_ratios(
        bars_day(spark, sf),
        pit.instant_series(points.filter("form = '10-K'")),
        pit.instant_series(points.filter("form = '10-H'")),
        staged(pit.quarterly_series(points), "quarters"),
    )
    return rounded(out.select("market", "ticker", "d", "book_to_market", "earnings_yield"), 10)
