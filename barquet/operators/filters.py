"""Filters, splits and rule chains over record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL
from barquet.sources.ingest import first_n


def tradable(bars: DataFrame, min_price: float = 1.0, min_volume: int = 0) -> DataFrame:
    return bars.filter((F.col("close") >= min_price) & (F.col("volume") >= min_volume))


def in_window(bars: DataFrame, start: str, end: str, order: str = "d") -> DataFrame:
    """Half-open [start, end)."""
    return bars.filter((F.col(order) >= F.lit(start).cast("date")) & (F.col(order) < F.lit(end).cast("date")))


def of_market(df: DataFrame, market: str) -> DataFrame:
    return df if market == "ALL" else df.filter(F.col("market") == market)


def weekdays(spans: DataFrame, start: str = "start", end: str = "end", out: str = "d") -> DataFrame:
    """One row per weekday from start to end, both included."""
    return spans.withColumn(out, F.explode(F.sequence(start, end))).filter(F.weekday(out) < 5)


def stale_symbols(bars: DataFrame, max_days: int) -> DataFrame:
    """Last bar per symbol and whether it lags the newest last bar of all symbols by more than max_days."""
    last = bars.groupBy(*SYMBOL).agg(F.max("d").alias("last_date"))
    newest = bars.agg(F.max("d")).scalar()
    return last.select(*SYMBOL, "last_date", (F.datediff(newest, "last_date") > max_days).alias("stale"))


SIGNAL_RULES: Mapping[str, str] = {
    "score": "score BETWEEN -1 AND 1",
    "confidence": "confidence BETWEEN 0 AND 1",
    "quantity": "quantity > 0",
}


def checked(df: DataFrame, rules: Mapping[str, str] = SIGNAL_RULES) -> DataFrame:
    """Name of the first broken rule in ``rejected``; NULL for a valid record. NULL fails a rule."""
    broken = F.coalesce(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("rejected", broken)


def inception(track: DataFrame, keys: Sequence[str] = (), order: str = "as_of") -> DataFrame:
    """First row with a nonzero equity, and the rate of the first such US row with fx > 1."""
    sound = F.col("equity").isNotNull() & (F.col("equity") != 0)
    us = sound & (F.col("market") == "US") & (F.col("fx") > 1)
    return track.groupBy(*keys).agg(
        F.min(F.when(sound, F.col(order))).alias("inception"),
        F.min_by(F.when(sound, F.col("equity")), F.when(sound, F.col(order))).alias("equity"),
        F.min_by(F.when(us, F.col("fx")), F.when(us, F.col(order))).alias("fx"),
    )


# Default pre-trade limits.
PRETRADE = dict(
    max_order_notional_krw=5_000_000.0, max_position_weight=0.30, max_orders_per_run=10, fat_finger_qty=10_000,
    price_sanity_pct=0.30, cash_buffer_pct=0.01,
)


def pretrade_code(limits: Mapping[str, float] = PRETRADE) -> Column:
    """First failing rule of an order, NULL when it passes.

    Reads quantity, decision_price, last_close, side, notional_krw, cash_krw, equity_krw and
    position_weight of the row.
    """
    off = F.abs(F.try_divide(F.col("decision_price"), F.col("last_close")) - 1.0) > limits["price_sanity_pct"]
    buying = F.col("side") == "BUY"
    heavier = F.col("position_weight") + F.try_divide(F.col("notional_krw"), F.col("equity_krw"))
    return (
        F.when((F.col("quantity") <= 0) | (F.col("quantity") > limits["fat_finger_qty"]), "FAT_FINGER_QTY")
        .when((F.col("last_close") <= 0) | off, "PRICE_SANITY")
        .when(F.col("notional_krw") > limits["max_order_notional_krw"], "MAX_ORDER_NOTIONAL")
        .when(buying & (F.col("notional_krw") * (1.0 + limits["cash_buffer_pct"]) > F.col("cash_krw")), "INSUFFICIENT_CASH")
        .when(buying & (F.col("equity_krw") > 0) & (heavier > limits["max_position_weight"]), "MAX_POSITION_WEIGHT")
    )


def circuit_breaker(approved: DataFrame, run: Sequence[str], order: Sequence[str], max_orders: int) -> DataFrame:
    """The first ``max_orders`` approved orders of each run."""
    return first_n(approved, max_orders, list(run), list(order), "submission")
