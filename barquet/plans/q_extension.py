"""Queries through the extension points."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import functions as F

from barquet.functions import extension as ext
from barquet.functions import indicators as ind
from barquet.functions import signals as sg
from barquet.operators import quality as qa
from barquet.operators.ic import pearson
from barquet.plans.q_ingest import _counts
from barquet.plans.q_ledger import ID, IDS, fills
from barquet.plans.q_signals import hrows
from barquet.plans.registry import query, rounded
from barquet.plans.views import with_views as sql
from barquet.sources.bridge import bars_day, bars_hour


def _last_over_mean(windows: Mapping[str, np.ndarray]) -> np.ndarray:
    close = windows["close"]
    return close[:, -1] / close.mean(axis=1) - 1.0


@query(
    "ud1_python_signal",
    sql("hist", """SELECT market, ticker, d, CASE WHEN pos >= 10 THEN round(close / avg(close) OVER (PARTITION BY market, ticker ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - 1, 6) + 0.0 END AS score FROM hist"""),
)
def ud1(spark, sf):
    return rounded(sg.python_signal(bars_day(spark, sf), _last_over_mean, 10), 6)


def _breakout(n: int) -> ind.Indicator:
    def prepare(df, f):
        return df.withColumn("_top", F.max("high").over(f.rows(-(n - 1)))).withColumn("_bot", F.min("low").over(f.rows(-(n - 1))))

    def result():
        place = F.try_divide(F.col("close") - F.col("_bot"), F.col("_top") - F.col("_bot"))
        return F.struct((place * 2.0 - 1.0).alias("score"), F.lit(0.5).alias("confidence"))

    return ind.Indicator(n, prepare, result)


BREAK = f"""SELECT 'breakout' AS source, market, ticker, ts, round((close - lo) / (hi - lo) * 2 - 1, 6) + 0.0 AS score FROM (SELECT market, ticker, ts, pos, close,
max(high) OVER {hrows(12)} AS hi, min(low) OVER {hrows(12)} AS lo FROM hh) WHERE pos >= 12"""


@query("ud2_custom_indicator", sql("hh", BREAK))
def ud2(spark, sf):
    ind.register_indicator("breakout", _breakout(12))
    try:
        out = ind.indicator_signals(bars_hour(spark, sf), ["breakout"])
        return rounded(out.select("source", "market", "ticker", "ts", "score"), 6)
    finally:
        del ind.INDICATORS["breakout"]


@query(
    "ud3_signal_source",
    sql("hh i_rsi_reversion", f"""SELECT 'rsi_reversion' AS source, market, ticker, ts, round(score, 6) + 0.0 AS score FROM i_rsi_reversion
UNION ALL SELECT 'gap', market, ticker, ts, round(greatest(-1, least(1, open / pc - 1)), 6) + 0.0 FROM hh WHERE pc IS NOT NULL"""),
)
def ud3(spark, sf):
    from barquet.operators.scan import framed

    def gap(bars):
        def build(df, f):
            return df.withColumn("_pc", f.lag("close"))

        rows = framed(bars, build, order=("ts",), back=1).filter("_pc IS NOT NULL")
        return rows.select(
            F.lit("gap").alias("source"), "market", "ticker", "ts", ind.clamp(F.col("open") / F.col("_pc") - 1.0).alias("score"),
            F.lit(0.5).alias("confidence"), F.lit("1d").alias("horizon"),
        )

    ext.register_source(ext.SignalSource("rsi_reversion", lambda b: ind.indicator_signals(b, ["rsi_reversion"])))
    ext.register_source(ext.SignalSource("gap", gap))
    out = ext.run_sources(bars_hour(spark, sf), ["rsi_reversion", "gap"], backtest=True)
    return rounded(out.select("source", "market", "ticker", "ts", "score"), 6)


@query(
    "ud5_cost_model",
    sql("fills", f"SELECT {IDS}, round(CASE WHEN side = 'SELL' THEN 0.002 ELSE 0.001 END * price * quantity + CASE WHEN market = 'NASDAQ' THEN 1.0 ELSE 0.0 END, 8) AS cost FROM fills"),
)
def ud5(spark, sf):
    model = ext.custom_costs(
        lambda price, quantity, market, side: F.when(side == "SELL", 0.002).otherwise(0.001) * price * quantity
        + F.when(market == "NASDAQ", 1.0).otherwise(0.0)
    )
    return rounded(model(fills(spark, sf)).select(*ID, "cost"))


@query(
    "ud6_correlation",
    sql("bars", """SELECT market, ticker, count(*) AS n, CASE WHEN stddev_pop(open) > 0 AND stddev_pop(close) > 0 THEN round(corr(open, close), 8) + 0.0 END AS corr FROM bars GROUP BY market, ticker"""),
)
def ud6(spark, sf):
    out = bars_day(spark, sf).groupBy("market", "ticker").agg(F.count(F.lit(1)).alias("n"), pearson("open", "close").alias("corr"))
    return rounded(out)


LONG = " UNION ALL ".join(
    f"SELECT market, ticker, '{code}' AS code, '{severity}' AS severity, {code} AS count FROM qcounts WHERE {code} > 0"
    for code, severity in qa.SEVERITY.items()
)


@query("ud7_issue_rows", sql("qcounts", LONG))
def ud7(spark, sf):
    return qa.issues(_counts(spark, sf))
