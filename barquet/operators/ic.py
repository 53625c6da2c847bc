"""Information coefficient of signals: decision dates, forward returns, cross-sections, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.signals import signals_long, signals_wide
from barquet.operators.returns import calendar
from barquet.operators.scan import linear_quantiles, value_ranks
from barquet.session import staged


# Least cross-sections of the scan over the whole zoo.
ZOO_CROSS_SECTION = {"NASDAQ": 30, "KOSPI": 20}


def chronological_split(
    bars: DataFrame, train: float = 0.5, validation: float = 0.25, holdout: float = 0.25, panel: Sequence[str] = ("market",)
) -> DataFrame:
    """Half-open train / validation / holdout windows by calendar-day fractions of each panel's span."""
    if abs(train + validation + holdout - 1.0) > 1e-9:
        raise ValueError("the fractions must sum to 1")
    if min(train, validation, holdout) <= 0:
        raise ValueError("every fraction must be positive")
    span = bars.groupBy(*panel).agg(F.min("d").alias("first"), F.max("d").alias("last"))
    total = F.datediff("last", "first")
    a = F.greatest(F.lit(1), F.bround(total * F.lit(train)).cast("int"))
    b = F.greatest(F.lit(1), F.bround(total * F.lit(validation)).cast("int"))
    rest = total - a - b
    checked = F.when(rest < 1, F.raise_error(F.lit("date range too short for three splits")).cast("int")).otherwise(a)
    cut = span.withColumn("_a", checked).withColumn("_b", b)
    t1 = F.date_add("first", F.col("_a"))
    t2 = F.date_add("first", F.col("_a") + F.col("_b"))
    windows = F.array(
        F.struct(F.lit("train").alias("split"), F.col("first").alias("start"), t1.alias("end")),
        F.struct(F.lit("validation").alias("split"), t1.alias("start"), t2.alias("end")),
        F.struct(F.lit("holdout").alias("split"), t2.alias("start"), F.col("last").alias("end")),
    )
    return cut.select(*panel, F.explode(windows).alias("w")).select(*panel, "w.split", "w.start", "w.end")


def whole_span(bars: DataFrame, panel: Sequence[str] = ("market",)) -> DataFrame:
    """One window per panel that holds every date."""
    return bars.groupBy(*panel).agg(
        F.lit("all").alias("split"), F.min("d").alias("start"), F.date_add(F.max("d"), 1).alias("end")
    )


def decision_dates(
    cal: DataFrame, windows: DataFrame, horizon: int, spacing: int, strict: bool = True,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Every ``spacing``-th calendar date of each window that leaves room for the forward return.

    ``i0`` is the window's first index; the step counts dates that are skipped afterwards too.
    ``allowed(market, d)`` keeps decision dates of a regime.
    """
    size = cal.groupBy("market").agg(F.count(F.lit(1)).alias("n_dates"))
    starts = (
        cal.join(windows, "market").filter("d >= start").groupBy("market", "split", "start", "end")
        .agg(F.min("i").alias("i0"))
    )
    steps = (
        cal.join(starts, "market").join(size, "market")
        .filter((F.col("i") >= F.col("i0")) & ((F.col("i") - F.col("i0")) % spacing == 0))
        .filter((F.col("d") < F.col("end")) & (F.col("i") <= F.col("n_dates") - horizon - 1))
    )
    if strict:
        exits = cal.select("market", (F.col("i") - horizon).alias("i"), F.col("d").alias("exit_d"))
        steps = steps.join(exits, ["market", "i"]).filter("exit_d < end")
    if allowed is not None:
        steps = steps.join(allowed, ["market", "d"], "left_semi")
    return steps.select("market", "split", "d", "i", "i0")


def forward_returns(bars: DataFrame, cal: DataFrame, horizon: int) -> DataFrame:
    """Close at index i+h over open at index i+1, less 1, for symbols priced on both dates."""
    placed = bars.select("market", "ticker", "d", "open", "close").join(cal, ["market", "d"])
    entry = placed.select("market", "ticker", (F.col("i") - 1).alias("i"), "open").filter("open > 0")
    leave = placed.select("market", "ticker", (F.col("i") - horizon).alias("i"), F.col("close").alias("exit_close"))
    return entry.join(leave, ["market", "ticker", "i"]).select(
        "market", "ticker", "i", (F.col("exit_close") / F.col("open") - 1.0).alias("fwd")
    )


def scored_decisions(
    bars: DataFrame, cal: DataFrame, decisions: DataFrame, names: Sequence[str], spacing: int, wide: DataFrame | None = None
) -> DataFrame:
    """Scores at each decision date from the symbol's last bar on or before it.

    A bar answers for the calendar indices from its own to the one before the symbol's next bar, so
    its decision dates follow by arithmetic; there is no range join.
    """
    names = list(names)
    size = cal.groupBy("market").agg(F.count(F.lit(1)).alias("n_dates"))
    if wide is None:
        wide = signals_wide(
            bars, names, ahead=1, extra=lambda df, f: df.withColumn("next_d", f.lead("d"))
        )
    nexts = cal.select("market", F.col("d").alias("next_d"), F.col("i").alias("next_i"))
    placed = (
        wide.select("market", "ticker", "d", "next_d", *names)
        .join(cal, ["market", "d"])
        .join(nexts, ["market", "next_d"], "left")
        .join(size, "market")
        .withColumn("next_i", F.coalesce("next_i", "n_dates"))
        .drop("next_d", "n_dates")
    )
    starts = decisions.select("market", "split", "i0").distinct()
    first = F.ceil((F.greatest(F.col("i"), F.col("i0")) - F.col("i0")) / F.lit(spacing))
    last = F.floor((F.col("next_i") - 1 - F.col("i0")) / F.lit(spacing))
    spread = (
        placed.join(starts, "market")
        .withColumn("_a", first)
        .withColumn("_b", last)
        .filter("_a <= _b")
        .withColumn("_m", F.explode(F.sequence("_a", "_b")))
        .withColumn("k", F.col("i0") + F.col("_m") * spacing)
        .drop("d", "i", "i0", "next_i", "_a", "_b", "_m")
    )
    return spread.join(
        decisions.select("market", "split", F.col("i").alias("k"), "d"), ["market", "split", "k"]
    ).withColumnRenamed("k", "i")


def cross_sections(
    bars: DataFrame, names: Sequence[str], windows: DataFrame | None = None, horizon: int = 21,
    spacing: int | None = None, strict: bool = True, allowed: DataFrame | None = None, wide: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, decisions): one row per signal, window, decision date and symbol with score and fwd."""
    if horizon < 1 or (spacing is not None and spacing < 1):
        raise ValueError("horizon and spacing must be at least 1")
    step = spacing or horizon
    cal = staged(calendar(bars))
    decisions = staged(
        decision_dates(cal, windows if windows is not None else whole_span(bars), horizon, step, strict, allowed)
    )
    scored = scored_decisions(bars, cal, decisions, names, step, wide)
    joined = scored.join(forward_returns(bars, cal, horizon), ["market", "ticker", "i"])
    rows = signals_long(joined, list(names), ["market", "ticker", "split", "d", "fwd"])
    return rows, decisions


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; NULL when either does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_ranks(rows: DataFrame, group: Sequence[str], value: str, out: str, bounded: bool = False) -> DataFrame:
    """Ascending ranks from 1, ties share their mean rank."""
    ranks = value_ranks(rows, group, value, bounded)
    return rows.join(
        ranks.select(*group, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out)), [*group, value]
    )


def winsorised(rows: DataFrame, group: Sequence[str], value: str, pct: float, bounded: bool = False) -> DataFrame:
    """Value clipped at the group's linear quantiles pct and 1-pct (``<value>_w``) and its average rank."""
    group = list(group)
    ranks = value_ranks(rows, group, value, bounded)
    v = F.col(value)
    if pct > 0:
        bounds = linear_quantiles(ranks, group, value, {"lo": pct, "hi": 1.0 - pct})
        table = ranks.join(bounds, group)
        clipped = F.greatest(F.col("lo"), F.least(F.col("hi"), v))
        # clipping is monotone: only the two ends become ties
        ends = table.groupBy(*group).agg(
            F.sum(F.when(v <= F.col("lo"), F.col("n")).otherwise(0)).alias("at_lo"),
            F.sum(F.when(v >= F.col("hi"), F.col("n")).otherwise(0)).alias("at_hi"),
        )
        table = table.join(ends, group)
        size = F.col("group_size")
        rank = (
            F.when(F.col("lo") == F.col("hi"), (size + 1) / 2.0)
            .when(v <= F.col("lo"), (F.col("at_lo") + 1) / 2.0)
            .when(v >= F.col("hi"), size - (F.col("at_hi") - 1) / 2.0)
            .otherwise(F.col("before") + (F.col("n") + 1) / 2.0)
        )
    else:
        table, clipped, rank = ranks, v, F.col("before") + (F.col("n") + 1) / 2.0
    return rows.join(
        table.select(*group, value, clipped.alias(f"{value}_w"), rank.alias(f"{value}_rank")), [*group, value]
    )


def least_size(sizes: int | Mapping[str, int], market: str = "market") -> Column:
    if isinstance(sizes, int):
        return F.lit(sizes)
    out = F.lit(max(sizes.values()))
    for name, n in sizes.items():
        out = F.when(F.col(market) == name, n).otherwise(out)
    return out


def information_coefficients(
    rows: DataFrame, group: Sequence[str] = ("signal", "market", "split", "d"),
    min_cross_section: int | Mapping[str, int] = 20, winsorize: float = 0.01,
) -> DataFrame:
    """Per group: size, IC and rank IC against the winsorised forward return.

    ``ic`` and ``rank_ic`` are NULL for a degenerate cross-section; small ones are left out.
    ``min_cross_section`` is one number, or one per market (others: the largest of them).
    """
    group = list(group)
    rows = staged(rows)
    both = average_ranks(winsorised(rows, group, "fwd", winsorize), group, "score", "score_rank")
    ic, rank_ic = pearson("score", "fwd_w"), pearson("score_rank", "fwd_rank")
    out = both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"), rank_ic.alias("rank_ic"))
    sound = F.col("ic").isNotNull() & F.col("rank_ic").isNotNull()
    return out.filter(F.col("n") >= least_size(min_cross_section)).select(
        *group, "n", F.when(sound, F.col("ic")).alias("ic"), F.when(sound, F.col("rank_ic")).alias("rank_ic")
    )


def ic_summary(
    ics: DataFrame, decisions: DataFrame, names: Sequence[str], keys: Sequence[str] = ("signal", "market", "split")
) -> DataFrame:
    """Mean, deviation, t, IR and skip counts per signal and window; NULL where undefined."""
    listed = F.explode(F.array(*[F.lit(n) for n in names])).alias("signal")
    planned = decisions.groupBy("market", "split").agg(F.count(F.lit(1)).alias("planned")).select("*", listed)
    stats = ics.groupBy(*keys).agg(
        F.count("ic").alias("n_periods"),
        F.count(F.lit(1)).alias("_seen"),
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("std_ic"),
        F.avg("rank_ic").alias("mean_rank_ic"),
    )
    zero = F.lit(0).cast("long")
    return planned.join(stats, list(keys), "left").select(
        *keys,
        F.coalesce("n_periods", zero).alias("n_periods"),
        (F.col("planned") - F.coalesce("_seen", zero)).alias("n_skipped_small_xs"),
        (F.coalesce("_seen", zero) - F.coalesce("n_periods", zero)).alias("n_skipped_degenerate"),
        "mean_ic",
        "std_ic",
        (F.try_divide(F.col("mean_ic"), F.col("std_ic")) * F.sqrt("n_periods")).alias("ic_t_stat"),
        F.try_divide(F.col("mean_ic"), F.col("std_ic")).alias("ic_ir"),
        "mean_rank_ic",
    )


def signal_scan(
    bars: DataFrame, names: Sequence[str], windows: DataFrame, horizon: int = 21, spacing: int | None = None,
    min_cross_section: int | Mapping[str, int] = 20, winsorize: float = 0.01, allowed: DataFrame | None = None,
    survivor: str | None = None,
) -> DataFrame:
    """IC summary of every signal in every market and window, in one grouped pass.

    The holdout stays locked: windows of that name are left out, unless ``survivor`` names the one
    signal that was chosen on the others; then it alone is scored there.
    """
    if survivor is None:
        windows = windows.filter("split <> 'holdout'")
    else:
        names, windows = [survivor], windows.filter("split = 'holdout'")
    rows, decisions = cross_sections(bars, names, windows, horizon, spacing, allowed=allowed)
    ics = information_coefficients(rows, min_cross_section=min_cross_section, winsorize=winsorize)
    return ic_summary(ics, decisions, names)
