"""Fusing signals and turning a score into a held weight."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL, running


def combined(
    signals: DataFrame, weights: Mapping[str, float] | None = None, order: str = "ts", by: Sequence[str] = ()
) -> DataFrame:
    """Confidence-weighted mean score per symbol and time; a source without a weight counts 1."""
    w = F.lit(1.0)
    if weights:
        table = signals.sparkSession.createDataFrame(list(weights.items()), "source string, _w double")
        signals = signals.join(F.broadcast(table), "source", "left")
        w = F.coalesce("_w", F.lit(1.0))
    pull = F.col("confidence") * w
    close = [F.max("close").alias("close")] if "close" in signals.columns else []
    return signals.groupBy(*by, *SYMBOL, order).agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * pull), F.sum(pull)), F.lit(0.0)).alias("combined"),
        F.count(F.lit(1)).alias("n_sources"),
        *close,
    )


def hysteresis(
    scores: DataFrame, enter: float, leave: float = 0.0, score: str = "combined", keys: Sequence[str] = SYMBOL,
    order: Sequence[str] = ("ts",), out: str = "weight",
) -> DataFrame:
    """At or above ``enter`` hold the score, at or below ``leave`` hold nothing, between keep what is held."""
    s = F.col(score)
    df = scores.withColumn("_w", F.when(s >= enter, s).when(s <= leave, 0.0))
    held = running(df, {"_held": ("last", "_w")}, keys, order)
    return held.withColumn(out, F.coalesce("_held", F.lit(0.0))).drop("_w", "_held")
