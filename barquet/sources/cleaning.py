"""Cleaning of raw OHLCV rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL

REL_TOL = 1e-6
MAX_DROPPED = 5
MAX_DROPPED_SHARE = 0.005
PRICES = ("open", "high", "low", "close")


def without_gaps(raw: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN price; NULL volume is 0; the time is cut to the UTC day."""
    df = raw
    for c in PRICES:
        df = df.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    df = df.dropna(subset=list(PRICES)).withColumn("volume", F.coalesce(F.col("volume"), F.lit(0)).cast("long"))
    if "ts" in df.columns:
        df = df.withColumn("ts", F.date_trunc("day", "ts"))
    return df


def repair_float_noise(df: DataFrame, rel_tol: float = REL_TOL) -> DataFrame:
    """Lift high to the true maximum and lower low to the true minimum when the gap is float noise."""
    top, bottom = F.greatest(*PRICES), F.least(*PRICES)
    scale = F.greatest(*[F.abs(F.col(c)) for c in PRICES], F.lit(1.0)) * rel_tol
    high = F.when((F.col("high") < top) & (top - F.col("high") <= scale), top).otherwise(F.col("high"))
    low = F.when((F.col("low") > bottom) & (F.col("low") - bottom <= scale), bottom).otherwise(F.col("low"))
    return df.withColumns({"high": high, "low": low})


def inconsistent() -> Column:
    return (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))


def drop_bad_ticks(
    df: DataFrame, keys: Sequence[str] = SYMBOL, max_dropped: int = MAX_DROPPED, share: float = MAX_DROPPED_SHARE
) -> DataFrame:
    """Drop inconsistent rows, and whole symbols with more of them than the allowance.

    The verdict per symbol is an aggregate joined back, so a large symbol stays spread out.
    """
    return drop_verdicts(df, keys, max_dropped, share).filter("accepted AND NOT bad").drop("accepted", "bad")


def drop_verdicts(df: DataFrame, keys: Sequence[str], max_dropped: int, share: float) -> DataFrame:
    keys = list(keys)
    flagged = df.withColumn("bad", inconsistent())
    verdict = flagged.groupBy(*keys).agg(
        (F.count_if("bad") <= F.greatest(F.lit(float(max_dropped)), F.count(F.lit(1)) * share)).alias("accepted")
    )
    return flagged.join(verdict, keys)


def clean(raw: DataFrame, keys: Sequence[str] = SYMBOL) -> DataFrame:
    return drop_bad_ticks(repair_float_noise(without_gaps(raw)), keys)


def consistent_symbols(df: DataFrame, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Whether every row of a symbol is OHLC-consistent."""
    return df.groupBy(*keys).agg(F.bool_and(~inconsistent()).alias("consistent"))
