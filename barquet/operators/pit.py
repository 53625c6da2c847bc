"""Point-in-time joins: what was known at a date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL, running


def as_of_series(probes: DataFrame, series: DataFrame, order: str = "d", value: str = "v") -> DataFrame:
    """Latest value of one global series on or before each probe date.

    The value is resolved once per distinct date (few thousand rows), then joined to the probes.
    """
    dates = probes.select(order).distinct().withColumn(value, F.lit(None).cast(series.schema[value].dataType))
    line = series.select(order, value).withColumn("_s", F.lit(0)).unionByName(dates.withColumn("_s", F.lit(1)))
    known = running(line.withColumn("_k", F.lit(1)), {"_v": ("last", value)}, ["_k"], (order, "_s"), bounded=True)
    resolved = known.filter("_s = 1").select(order, F.col("_v").alias(value))
    return probes.join(resolved, order, "left")


def known_at(
    probes: DataFrame, series: DataFrame, value: str, out: str, keys: Sequence[str] = SYMBOL, order: str = "d",
    known: str = "filed", rank: str = "period_end",
) -> DataFrame:
    """For each probe the value with the greatest ``rank`` among those with ``known`` <= the probe's date.

    One running maximum over the union of both tables; a value filed on the day itself counts.
    """
    return all_known_at(probes, {out: Series(series, value, rank, known)}, keys, order)


@dataclass(frozen=True)
class Series:
    """Filed values: which column counts, what ranks them, and when they became known."""

    rows: DataFrame
    value: str
    rank: str = "period_end"
    known: str = "filed"


def all_known_at(
    probes: DataFrame, series: Mapping[str, Series], keys: Sequence[str] = SYMBOL, order: str = "d"
) -> DataFrame:
    """``known_at`` for several series in one pass over the union of all of them."""
    keys = list(keys)
    cols = [c for c in probes.columns if c not in (*keys, order)]
    line = probes.select(*keys, order, F.struct(*cols).alias("_row"), F.lit(True).alias("_p"))
    for out, s in series.items():
        held = F.struct(F.col(s.rank).alias("r"), F.col(s.value).alias("v")).alias(f"_h_{out}")
        filed = s.rows.select(*keys, F.col(s.known).alias(order), held, F.lit(False).alias("_p"))
        line = line.unionByName(filed, allowMissingColumns=True)
    state = running(line, {f"_k_{out}": ("max", f"_h_{out}") for out in series}, keys, (order,), by_range=True)
    return state.filter("_p").select(*keys, order, "_row.*", *[F.col(f"_k_{out}.v").alias(out) for out in series])


def quarterly_series(points: DataFrame, keys: Sequence[str] = SYMBOL, tie: str | None = None) -> DataFrame:
    """Quarters from duration points: explicit 80-100 day spans, and Q4 = year less its three quarters.

    The earliest-filed value of a period stands (per fiscal year for 350-380 day spans).
    """
    keys = list(keys)
    span = F.datediff("period_end", "start")
    first = F.struct("filed", *([tie] if tie else []))
    short = points.filter((span >= 80) & (span <= 100))
    explicit = short.groupBy(*keys, "period_end").agg(F.min_by(F.struct("filed", "val"), first).alias("w")).select(
        *keys, "period_end", "w.filed", "w.val"
    )
    annual = (
        points.filter((span >= 350) & (span <= 380) & F.col("fy").isNotNull())
        .groupBy(*keys, "fy")
        .agg(F.min_by(F.struct("period_end", "filed", "val"), first).alias("w"))
        .select(*keys, "fy", F.col("w.period_end").alias("year_end"), F.col("w.filed").alias("year_filed"),
                F.col("w.val").alias("year_val"))
    )
    tagged = short.filter("fy IS NOT NULL").select(*keys, "fy", "period_end").distinct()
    newest_first = W.partitionBy(*keys, "fy").orderBy(F.col("period_end").desc())
    three = (
        tagged.join(explicit, [*keys, "period_end"])
        .join(annual, [*keys, "fy"])
        .filter("period_end < year_end")
        .withColumn("_rn", F.row_number().over(newest_first))
        .filter("_rn <= 3")
        .groupBy(*keys, "fy", "year_end", "year_filed", "year_val")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("val").alias("_s"))
        .filter("_n = 3")
    )
    derived = three.select(
        *keys, F.col("year_end").alias("period_end"), F.col("year_filed").alias("filed"),
        (F.col("year_val") - F.col("_s")).alias("val"),
    ).join(explicit, [*keys, "period_end"], "left_anti")
    return explicit.unionByName(derived)


def instant_series(points: DataFrame, keys: Sequence[str] = SYMBOL, tie: str | None = None) -> DataFrame:
    """Earliest-filed value per period end."""
    first = F.struct("filed", *([tie] if tie else []))
    return points.groupBy(*keys, "period_end").agg(F.min_by(F.struct("filed", "val"), first).alias("w")).select(
        *keys, "period_end", "w.filed", "w.val"
    )


def quarter_states(quarters: DataFrame, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Per filing date the quarters known then, oldest first.

    A key has one row per fiscal quarter, so both the window and the array are short.
    """
    known = W.partitionBy(*keys).orderBy("filed").rangeBetween(W.unboundedPreceding, W.currentRow)
    listed = quarters.withColumn("q", F.array_sort(F.collect_list(F.struct("period_end", "val")).over(known)))
    return listed.groupBy(*keys, "filed").agg(F.max("q").alias("q"))


def trailing_sum(quarters: DataFrame, keys: Sequence[str] = SYMBOL, n: int = 4) -> DataFrame:
    """State after each filing: sum of the n latest quarters, NULL with fewer."""
    state = quarter_states(quarters, keys)
    last = F.transform(F.slice("q", -n, n), lambda x: x["val"])
    total = F.aggregate(last, F.lit(0.0), lambda a, x: a + x)
    return state.select(*keys, "filed", F.when(F.size("q") >= n, total).alias("ttm"))


def standardised_surprise(quarters: DataFrame, keys: Sequence[str] = SYMBOL, min_hist: int = 8) -> DataFrame:
    """State after each filing: latest year-over-year change against mean and deviation of the earlier ones."""
    state = quarter_states(quarters, keys).filter(F.size("q") >= 1)
    n = F.size("q")
    change = F.when(
        n >= 5, F.transform(F.sequence(F.lit(4), n - 1), lambda i: F.get("q", i)["val"] - F.get("q", i - 4)["val"])
    )
    state = state.withColumn("_yoy", change).withColumn("_prior", F.slice("_yoy", 1, F.size("_yoy") - 1))
    state = state.withColumn(
        "_mean", F.try_divide(F.aggregate("_prior", F.lit(0.0), lambda a, x: a + x), F.size("_prior"))
    )
    squares = F.aggregate("_prior", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    sd = F.sqrt(F.try_divide(squares, F.size("_prior") - 1))
    sue = F.when(sd > 0, (F.element_at("_yoy", -1) - F.col("_mean")) / sd)
    enough = (n >= min_hist) & (F.size("_yoy") >= 3)
    return state.select(*keys, "filed", F.when(enough, sue).alias("sue"))


def value_ratios(bars: DataFrame, equity: DataFrame, shares: DataFrame, quarters: DataFrame) -> DataFrame:
    """Book-to-market and earnings yield of each bar from what was filed by then."""
    df = all_known_at(
        bars.select(*SYMBOL, "d", "close"),
        {
            "equity": Series(equity, "val"),
            "shares": Series(shares, "val"),
            "ttm": Series(trailing_sum(quarters), "ttm", rank="filed"),
        },
    )
    cap = F.when((F.col("shares") > 0) & (F.col("close") > 0), F.col("close") * F.col("shares"))
    return df.withColumn("book_to_market", F.col("equity") / cap).withColumn("earnings_yield", F.col("ttm") / cap)
