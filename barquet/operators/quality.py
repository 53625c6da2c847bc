"""Per-symbol data-quality checks; every check is one conditional aggregate over all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL, framed, running
from barquet.session import staged

SEVERITY = {
    "TOO_FEW_BARS": "FAIL",
    "DUPLICATE_TIMESTAMPS": "FAIL",
    "NOT_SORTED": "FAIL",
    "NONPOSITIVE_PRICE_OR_NEG_VOLUME": "FAIL",
    "OHLC_INCONSISTENT": "FAIL",
    "EXTREME_RETURN": "WARN",
    "STALE_PRICE_RUN": "WARN",
    "ZERO_VOLUME": "WARN",
    "CALENDAR_GAP": "WARN",
}


def nonpositive() -> Column:
    bad = F.col("volume") < 0
    for c in ("open", "high", "low", "close"):
        bad = bad | (F.col(c) <= 0)
    return bad


def ohlc_broken() -> Column:
    return (
        (F.col("high") < F.greatest("open", "close", "low"))
        | (F.col("low") > F.least("open", "close", "high"))
        | (F.col("high") < F.col("low"))
    )


def weekday_gap(before: Column, now: Column) -> Column:
    """Weekdays strictly between two dates; beyond 14 days the rough formula on the weekday of the first."""
    gap = F.datediff(now, before)
    counted = F.size(
        F.filter(F.sequence(F.date_add(before, 1), F.date_sub(now, 1)), lambda x: F.weekday(x) < 5)
    )
    rough = gap - 2 * F.floor((gap + F.weekday(before)) / F.lit(7))
    return F.when(gap <= 1, 0).when(gap > 14, rough).otherwise(counted)


def with_arrival(bars: DataFrame, order: str) -> DataFrame:
    """Previous row in arrival order, per symbol."""

    def build(df: DataFrame, f) -> DataFrame:
        return df.select("*", f.lag("d").alias("_pd"), f.lag("close").alias("_pc"))

    return framed(bars, build, order=(order,), back=1)


def stale_runs(marked: DataFrame, order: str, max_run: int) -> DataFrame:
    """Runs of more than ``max_run`` equal closes, counted per symbol.

    ``marked`` has the previous close of each row (``with_arrival``). A run is named by the number of price changes before it; a run of any length is one group of
    plain counts.
    """
    changed = F.when(F.col("_pc").isNull() | (F.col("close") != F.col("_pc")), 1).otherwise(0)
    numbered = running(marked.withColumn("_chg", changed), {"_run": ("sum", "_chg")}, SYMBOL, (order,))
    runs = numbered.groupBy(*SYMBOL, "_run").agg(F.count(F.lit(1)).alias("_len")).filter(F.col("_len") > max_run)
    return runs.groupBy(*SYMBOL).agg(F.count(F.lit(1)).alias("STALE_PRICE_RUN"))


def issue_counts(
    bars: DataFrame, names: DataFrame | None = None, order: str = "ingest_seq", max_daily_return: float = 0.40,
    max_stale_run: int = 5,
) -> DataFrame:
    """Wide table: one row per symbol, one count per code. ``names`` adds symbols without any bar."""
    keys = list(SYMBOL)
    # once for the counts and the runs
    marked = staged(with_arrival(bars.select(*keys, order, "d", "open", "high", "low", "close", "volume"), order), "arrival")
    jump = (F.col("_pc") > 0) & (F.abs(F.col("close") / F.col("_pc") - 1.0) > max_daily_return)
    base = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.min("d").alias("start_date"),
        F.max("d").alias("end_date"),
        F.count_if(F.col("d") <= F.col("_pd")).alias("NOT_SORTED"),
        F.count_if(nonpositive()).alias("NONPOSITIVE_PRICE_OR_NEG_VOLUME"),
        F.count_if(ohlc_broken()).alias("OHLC_INCONSISTENT"),
        F.count_if(jump).alias("EXTREME_RETURN"),
        F.count_if(F.col("volume") == 0).alias("ZERO_VOLUME"),
        F.count_if((F.col("d") > F.col("_pd")) & (weekday_gap(F.col("_pd"), F.col("d")) > 5)).alias("CALENDAR_GAP"),
    )
    table = base.join(duplicate_counts(bars), keys, "left").join(stale_runs(marked, order, max_stale_run), keys, "left")
    if names is not None:
        table = names.select(*keys).join(table, keys, "left")
    zero = F.lit(0).cast("long")
    few = F.coalesce("n_bars", zero) < 2
    others = [c for c in SEVERITY if c != "TOO_FEW_BARS"]
    return table.select(
        *keys,
        F.coalesce("n_bars", zero).alias("n_bars"),
        "start_date",
        "end_date",
        F.when(few, 1).otherwise(0).cast("long").alias("TOO_FEW_BARS"),
        *[F.when(few, zero).otherwise(F.coalesce(c, zero)).alias(c) for c in others],
    )


def duplicate_counts(bars: DataFrame) -> DataFrame:
    per_day = bars.groupBy(*SYMBOL, "d").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return per_day.groupBy(*SYMBOL).agg(F.count(F.lit(1)).alias("DUPLICATE_TIMESTAMPS"))


def issues(counts: DataFrame) -> DataFrame:
    """Long form: one row per symbol and code that occurs."""
    entries = F.array(
        *[
            F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("count"))
            for code, severity in SEVERITY.items()
        ]
    )
    return (
        counts.select(*SYMBOL, F.explode(F.filter(entries, lambda e: e["count"] > 0)).alias("e"))
        .select(*SYMBOL, "e.code", "e.severity", "e.count")
    )


def report(counts: DataFrame) -> DataFrame:
    """One row per symbol: size, span, number of issues, and whether no FAIL issue occurs."""
    fails = [F.col(c) > 0 for c, s in SEVERITY.items() if s == "FAIL"]
    failed = fails[0]
    for f in fails[1:]:
        failed = failed | f
    found = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in SEVERITY), F.lit(0))
    return counts.select(*SYMBOL, "n_bars", "start_date", "end_date", found.cast("long").alias("n_issues"), (~failed).alias("passed"))


def validation_summary(reports: DataFrame) -> DataFrame:
    """Whole-directory verdict."""
    return reports.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if("passed").alias("passed"),
        F.sum("n_bars").alias("n_bars"),
        F.bool_and("passed").alias("all_passed"),
    )


def staleness(bars: DataFrame, names: DataFrame, as_of: Column, max_age_days: int = 5) -> DataFrame:
    """NO_BARS or STALE per symbol, with the age of the newest bar."""
    last = bars.groupBy(*SYMBOL).agg(F.max("d").alias("last_date"))
    age = F.datediff(as_of, F.col("last_date"))
    return (
        names.select(*SYMBOL).join(last, list(SYMBOL), "left")
        .withColumn("age_days", age.cast("long"))
        .withColumn("code", F.when(F.col("last_date").isNull(), "NO_BARS").when(F.col("age_days") > max_age_days, "STALE"))
        .filter("code IS NOT NULL")
    )


def duplicate_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SYMBOL, "d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fx_check(rate: Column, low: float = 1e-6, high: float = 1e7) -> Column:
    """Code of a bad exchange rate given as text; NULL for a sound one."""
    number = F.trim(rate).try_cast("double")
    return (
        F.when(number.isNull(), "FX_BAD")
        .when(F.isnan(number), "FX_NAN")
        .when(number <= 0, "FX_NONPOSITIVE")
        .when((number < low) | (number > high), "FX_OUT_OF_BAND")
    )


def price_jumps(bars: DataFrame, threshold: float = 0.5, order: str = "d") -> DataFrame:
    """(symbol, date, move) where the close moved by more than ``threshold``."""

    def build(df: DataFrame, f) -> DataFrame:
        return df.withColumn("_pc", f.lag("close"))

    marked = framed(bars, build, order=(order,), back=1)
    move = F.when(F.col("_pc") > 0, F.col("close") / F.col("_pc") - 1.0)
    return marked.withColumn("move", move).filter(F.abs("move") > threshold).select(*SYMBOL, order, "move")
