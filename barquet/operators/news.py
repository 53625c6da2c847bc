"""News signals: items known at a bar, scored once, decayed and combined."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barquet.functions.columns import BEARISH, BULLISH, clamp, keyword_sentiment
from barquet.operators.scan import SYMBOL

ITEM_KEY = ("market", "ticker", "provider", "id")


def pandas_scorer(score: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Column], Column]:
    """Wrap ``score(titles) -> frame(score, confidence)`` as an Arrow-batched scorer column."""

    @pandas_udf("score double, confidence double")
    def udf(titles: pd.Series) -> pd.DataFrame:
        return score(titles)

    return udf


def keyword_frame(titles: pd.Series) -> pd.DataFrame:
    """The rule-based sentiment on one Arrow batch; an example for own scorers."""
    lower = titles.str.lower()
    up = lower.map(lambda t: any(w in t for w in BULLISH))
    down = lower.map(lambda t: any(w in t for w in BEARISH)) & ~up
    score = up.astype(float) * 0.7 - down.astype(float) * 0.7
    return pd.DataFrame({"score": score, "confidence": (up | down).map({True: 0.7, False: 0.2})})


def scored_once(items: DataFrame, scorer: Callable[[Column], Column] = keyword_sentiment, key: Sequence[str] = ITEM_KEY) -> DataFrame:
    """Score each item key once, however often it was delivered, and give every delivery that score.

    The first title in text order stands for a key; copies meet only as partial minima.
    """
    key = list(key)
    unique = items.groupBy(*key).agg(F.min("title").alias("title"))
    scores = unique.withColumn("_s", scorer(F.col("title"))).select(
        *key, F.col("_s.score").alias("score"), F.col("_s.confidence").alias("confidence")
    )
    return items.join(scores, key)


def news_windows(
    items: DataFrame, bars: DataFrame, lookback_days: float = 7.0, half_life_days: float = 3.0, order: str = "ts",
) -> DataFrame:
    """Per bar the aggregates of its symbol's items with ts - lookback <= published_at <= ts.

    Time is cut into blocks as long as the lookback. A bar's window is then the tail of the block
    before plus the head of its own, so two running aggregates give it exactly: no pair of bar and
    item is formed, and a symbol's items are spread over its blocks. The decay 0.5**(age/half_life)
    is split into a factor of the item and one of the bar, both relative to the block's start.
    """
    span = int(lookback_days * 86_400_000_000)
    half = half_life_days * 86_400_000_000
    items = items.select(*SYMBOL, F.unix_micros("published_at").alias("t"), "score", "confidence")
    items = items.withColumn("blk", F.floor(F.col("t") / F.lit(span)))

    def weighed(base: Column) -> DataFrame:
        w = F.pow(F.lit(2.0), (F.col("t") - base) / half) * F.col("confidence")
        return items.select(*SYMBOL, "blk", "t", w.alias("ew"), (F.col("score") * w).alias("sw"), F.lit(None).cast("long").alias("bar_t"))

    probes = bars.select(*SYMBOL, F.unix_micros(order).alias("bar_t"))
    none = F.lit(None).cast("double")

    def side(rows: DataFrame, probe_t: Column, descending: bool, tag: str) -> DataFrame:
        at = probes.select(
            *SYMBOL, F.floor(probe_t / F.lit(span)).alias("blk"), probe_t.alias("t"), none.alias("ew"), none.alias("sw"), "bar_t"
        )
        by = F.col("t").desc() if descending else F.col("t")
        w = W.partitionBy(*SYMBOL, "blk").orderBy(by).rangeBetween(W.unboundedPreceding, W.currentRow)
        line = rows.unionByName(at).select(
            *SYMBOL, "bar_t",
            F.count("ew").over(w).alias(f"n_{tag}"),
            F.sum("sw").over(w).alias(f"sw_{tag}"),
            F.sum("ew").over(w).alias(f"ew_{tag}"),
            F.max("ew").over(w).alias(f"top_{tag}"),
            F.min(F.when(F.col("ew").isNotNull(), F.col("t"))).over(w).alias(f"old_{tag}"),
            F.max(F.when(F.col("ew").isNotNull(), F.col("t"))).over(w).alias(f"new_{tag}"),
        )
        return line.filter("bar_t IS NOT NULL")

    head = side(weighed(F.col("blk") * span), F.col("bar_t"), False, "h")
    tail = side(weighed((F.col("blk") + 1) * span), F.col("bar_t") - F.lit(span), True, "t")
    both = head.join(tail, [*SYMBOL, "bar_t"])
    decay = F.pow(F.lit(2.0), -(F.col("bar_t") - F.floor(F.col("bar_t") / F.lit(span)) * span) / half)
    zero = F.lit(0.0)
    total = lambda c: (F.coalesce(f"{c}_h", zero) + F.coalesce(f"{c}_t", zero)) * decay
    return both.select(
        *SYMBOL,
        F.timestamp_micros("bar_t").alias(order),
        (F.col("n_h") + F.col("n_t")).alias("n_items"),
        F.timestamp_micros(F.least("old_h", "old_t")).alias("oldest"),
        F.timestamp_micros(F.greatest("new_h", "new_t")).alias("newest"),
        total("sw").alias("num"),
        total("ew").alias("den"),
        (F.greatest("top_h", "top_t") * decay).alias("top"),
    ).filter("n_items > 0")


def news_signal(
    items: DataFrame, bars: DataFrame, lookback_days: float = 7.0, half_life_days: float = 3.0, order: str = "ts", source: str = "news",
) -> DataFrame:
    """One signal per bar that has items: decayed mean score, and the strongest decayed confidence."""
    window = news_windows(items, bars, lookback_days, half_life_days, order)
    score = F.when(F.col("den") > 0, clamp(F.try_divide(F.col("num"), F.col("den")))).otherwise(0.0)
    return window.select(
        F.lit(source).alias("source"), *SYMBOL, order, score.alias("score"), clamp(F.col("top"), 0.0, 1.0).alias("confidence"),
        F.lit("5d").alias("horizon"),
        F.create_map(F.lit("n_items"), F.col("n_items").cast("double"), F.lit("raw_combined"), score).alias("features"),
    )
