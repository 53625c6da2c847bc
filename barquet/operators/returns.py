"""Union calendar, neighbour-date returns, equal-weight indices and curve metrics.

Curves hold one row per panel and calendar date, so their windows run per panel (``bounded``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.operators.scan import running

TRADING_DAYS = 252


def calendar(bars: DataFrame, panel: Sequence[str] = ("market",), order: str = "d") -> DataFrame:
    """Distinct dates of a panel with a dense index ``i``. One row per date, so the window is small."""
    by_date = W.partitionBy(*panel).orderBy(order)
    return bars.select(*panel, order).distinct().withColumn("i", F.row_number().over(by_date) - 1)


def indexed(bars: DataFrame, cal: DataFrame, panel: Sequence[str] = ("market",), order: str = "d") -> DataFrame:
    """Bars with the calendar index of their date."""
    return bars.join(cal, [*panel, order])


def neighbour_pairs(
    bars: DataFrame, cal: DataFrame, panel: Sequence[str] = ("market",), step: int = 1
) -> DataFrame:
    """Closes of one symbol on two calendar dates ``step`` apart; a hole on either date drops the pair."""
    now = indexed(bars.select("market", "ticker", "d", "close"), cal, panel)
    then = now.select(
        "market", "ticker", (F.col("i") + step).alias("i"), F.col("d").alias("d0"), F.col("close").alias("p0")
    )
    return now.join(then, ["market", "ticker", "i"]).select(
        "market", "ticker", "i", "d0", F.col("d").alias("d1"), "p0", F.col("close").alias("p1")
    )


def equal_weight_returns(bars: DataFrame, panel: Sequence[str] = ("market",)) -> DataFrame:
    """Mean simple return over the names priced on both neighbour dates."""
    pairs = neighbour_pairs(bars, calendar(bars, panel), panel).filter("p0 > 0 AND p1 <> 0")
    return pairs.groupBy(*panel, F.col("d1").alias("d")).agg(
        F.avg(F.col("p1") / F.col("p0") - 1.0).alias("r"), F.count(F.lit(1)).alias("n")
    )


def drop_from(bars: DataFrame, first_excluded) -> DataFrame:
    """Leave out bars dated on or after a day, e.g. today's partial bar."""
    return bars.filter(F.col("d") < F.lit(first_excluded).cast("date"))


def robust_index_returns(
    bars: DataFrame, min_coverage: float = 0.5, exclude_from=None, panel: Sequence[str] = ("market",)
) -> DataFrame:
    """Equal-weight returns over well-covered dates only.

    A date is kept when at least ``min_coverage`` of all names have a bar; returns run from the
    previous kept date and need as many names again. Names are counted before ``exclude_from`` cuts.
    """
    names = bars.select(*panel, "ticker").distinct().groupBy(*panel).agg(F.count(F.lit(1)).alias("names"))
    seen = bars if exclude_from is None else drop_from(bars, exclude_from)
    kept = (
        seen.groupBy(*panel, "d")
        .agg(F.count(F.lit(1)).alias("cov"))
        .join(names, list(panel))
        .filter(F.col("cov") / F.col("names") >= min_coverage)
    )
    cal = calendar(kept, panel)
    pairs = neighbour_pairs(seen, cal, panel).filter("p0 > 0 AND p1 <> 0")
    return (
        pairs.groupBy(*panel, F.col("d1").alias("d"))
        .agg(F.avg(F.col("p1") / F.col("p0") - 1.0).alias("r"), F.count(F.lit(1)).alias("n"))
        .join(names, list(panel))
        .filter(F.col("n") >= F.col("names") * min_coverage)
        .drop("names")
    )


def compounded(
    df: DataFrame, r: str = "r", keys: Sequence[str] = ("market",), order: Sequence[str] = ("d",),
    out: str = "equity", start: float = 1.0, bounded: bool = True,
) -> DataFrame:
    """Cumulative product of 1+r as a running sum of logarithms; signs and zeros are counted apart."""
    growth = F.col(r) + 1.0
    prepared = (
        df.withColumn("_ln", F.when(growth != 0, F.ln(F.abs(growth))).otherwise(0.0))
        .withColumn("_neg", F.when(growth < 0, 1).otherwise(0))
        .withColumn("_zero", F.when(growth == 0, 1).otherwise(0))
    )
    run = running(
        prepared,
        {"_s": ("sum", "_ln"), "_n": ("sum", "_neg"), "_z": ("sum", "_zero")},
        keys,
        order,
        bounded=bounded,
    )
    sign = F.when(F.col("_n") % 2 == 0, 1.0).otherwise(-1.0)
    value = F.when(F.col("_z") > 0, 0.0).otherwise(F.lit(start) * sign * F.exp("_s"))
    return run.withColumn(out, value).drop("_ln", "_neg", "_zero", "_s", "_n", "_z")


def drawdowns(
    df: DataFrame, value: str = "equity", keys: Sequence[str] = ("market",), order: Sequence[str] = ("d",),
    bounded: bool = True,
) -> DataFrame:
    """Running peak and relative distance from it (<= 0)."""
    run = running(df, {"peak": ("max", value)}, keys, order, bounded=bounded)
    return run.withColumn("drawdown", F.when(F.col("peak") != 0, (F.col(value) - F.col("peak")) / F.col("peak")))


def first_last(value: str, order: str | Column) -> tuple[Column, Column]:
    return F.min_by(value, order), F.max_by(value, order)


def total_return(curve: DataFrame, value: str = "equity", keys: Sequence[str] = ("market",), order: str = "d"):
    """last/first - 1, and 0 for fewer than two points or a zero start."""
    first, last = first_last(value, order)
    ratio = F.try_divide(last, first) - 1.0
    return curve.groupBy(*keys).agg(
        F.coalesce(F.when(F.count(F.lit(1)) >= 2, ratio), F.lit(0.0)).alias("total_return")
    )


def max_drawdown(curve: DataFrame, value: str = "equity", keys: Sequence[str] = ("market",), order: Sequence[str] = ("d",)):
    return drawdowns(curve, value, keys, order).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def daily_metrics(returns: DataFrame, r: str = "r", keys: Sequence[str] = ("market",), order: str = "d"):
    """CAGR on 252 bars, annual volatility, Sharpe and (negative) drawdown of a daily return series."""
    curve = drawdowns(compounded(returns, r, keys, (order,)), "equity", keys, (order,))
    n, sd = F.count(F.lit(1)), F.coalesce(F.stddev_samp(r), F.lit(0.0))
    return curve.groupBy(*keys).agg(
        n.alias("n_days"),
        (F.pow(F.max_by("equity", order), F.lit(252.0) / n) - 1.0).alias("cagr"),
        (sd * F.sqrt(F.lit(252.0))).alias("ann_vol"),
        F.when(sd > 0, F.avg(r) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.max_by("equity", order).alias("final_equity"),
    )


def log_metrics(curve: DataFrame, value: str = "equity", keys: Sequence[str] = ("market",), order: str = "d"):
    """Metrics on log returns with 252 bars per year; the number of bars is the length of the curve."""
    from barquet.operators.scan import framed

    steps = framed(
        curve,
        lambda df, f: df.withColumn("_prev", f.lag(value)),
        keys=keys,
        order=(order,),
        back=1,
        bounded=True,
    )
    steps = drawdowns(steps, value, keys, (order,))
    both = (F.col("_prev") > 0) & (F.col(value) > 0)
    lr = F.when(both, F.ln(F.col(value) / F.col("_prev")))
    steps = steps.withColumn("_lr", lr)
    n = F.count("_lr")
    sd = F.coalesce(F.stddev_samp("_lr"), F.lit(0.0))
    first, last = first_last(value, order)
    bars = F.count(F.lit(1))
    out = steps.groupBy(*keys).agg(
        bars.alias("n_bars"),
        F.when(n > 0, F.pow(last / first, F.lit(252.0) / bars) - 1.0).otherwise(0.0).alias("cagr"),
        F.when(n > 0, F.least(F.lit(0.0), F.min("drawdown"))).otherwise(0.0).alias("max_drawdown"),
        F.when(sd > 0, F.avg("_lr") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        (sd * F.sqrt(F.lit(252.0))).alias("vol"),
    )
    return out.withColumn("calmar", F.try_divide(F.col("cagr"), F.abs("max_drawdown")))


def period_metrics(
    curve: DataFrame,
    returns: DataFrame,
    keys: Sequence[str] = ("market",),
    order: str = "d",
    value: str = "equity",
    r: str = "r",
    init: float = 10_000_000.0,
) -> DataFrame:
    """Metrics of a monthly curve: 365.25-day years, positive drawdown from a peak starting at ``init``."""
    keys = list(keys)
    run = running(curve, {"_p": ("max", value)}, keys, (order,), bounded=True)
    peak = F.greatest(F.col("_p"), F.lit(init))
    run = run.withColumn("_dd", F.when(peak > 0, (peak - F.col(value)) / peak).otherwise(0.0))
    shape = run.groupBy(*keys).agg(
        F.min(order).alias("start_date"),
        F.max(order).alias("end_date"),
        F.max_by(value, order).alias("end_value"),
        F.greatest(F.lit(0.0), F.max("_dd")).alias("max_dd"),
    )
    moves = returns.groupBy(*keys).agg(
        F.count(r).alias("n_months"),
        F.coalesce(F.sqrt(F.var_samp(r) * 12.0), F.lit(0.0)).alias("ann_vol"),
        F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("monthly_hit_rate"),
    )
    days = F.datediff("end_date", "start_date")
    years = F.when(days > 0, days / 365.25).otherwise(1.0)
    return (
        shape.join(moves, keys, "left")
        .withColumn("cagr", F.pow(F.col("end_value") / init, 1.0 / years) - 1.0)
        .withColumn("gross_cagr", F.col("cagr"))
        .withColumn("ann_vol", F.coalesce("ann_vol", F.lit(0.0)))
        .withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("cagr") / F.col("ann_vol")).otherwise(0.0))
        .withColumn(
            "calmar",
            F.when(F.col("max_dd") > 0, F.col("cagr") / F.col("max_dd")).when(F.col("cagr") <= 0, F.lit(0.0)),
        )
    )


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Mean over symbols of last/first - 1."""
    first, last = first_last("close", "d")
    each = bars.groupBy("market", "ticker").agg(first.alias("p0"), last.alias("p1")).filter("p0 > 0")
    return each.agg(
        F.coalesce(F.avg(F.col("p1") / F.col("p0") - 1.0), F.lit(0.0)).alias("buy_and_hold"),
        F.count(F.lit(1)).alias("symbols"),
    )


def buy_and_hold_curve(bars: DataFrame, init: float = 10_000_000.0) -> DataFrame:
    """Equal slices held from each symbol's first close; a slice without a price stays at cost.

    A date's missing slices need no row of their own: they are the slices not priced that day.
    """
    first = bars.groupBy("market", "ticker").agg(F.min_by("close", "d").alias("p0"))
    names = first.groupBy("market").agg(F.count(F.lit(1)).alias("names"))
    priced = (
        bars.join(first, ["market", "ticker"])
        .filter("p0 > 0")
        .groupBy("market", "d")
        .agg(F.sum(F.col("close") / F.col("p0")).alias("ratio"), F.count(F.lit(1)).alias("n"))
    )
    dates = bars.select("market", "d").distinct()
    return (
        dates.join(priced, ["market", "d"], "left")
        .join(names, "market")
        .select(
            "market",
            "d",
            (
                F.lit(init) / F.col("names")
                * (F.coalesce("ratio", F.lit(0.0)) + F.col("names") - F.coalesce("n", F.lit(0)))
            ).alias("equity"),
        )
    )


def period_return(weights: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted return of each holding period: weights(keys, market, ticker, w, d0, d1).

    A name without a price at either end contributes 0.
    """
    px = bars.select("market", "ticker", "d", "close")
    a = px.select("market", "ticker", F.col("d").alias("d0"), F.col("close").alias("p0"))
    b = px.select("market", "ticker", F.col("d").alias("d1"), F.col("close").alias("p1"))
    joined = weights.join(a, ["market", "ticker", "d0"], "left").join(b, ["market", "ticker", "d1"], "left")
    move = F.coalesce(F.try_divide(F.col("p1"), F.col("p0")) - 1.0, F.lit(0.0))
    return joined.groupBy(*keys).agg(F.sum(F.col("w") * move).alias("r"))


def equal_period_return(names: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean return of the names priced at both ends of names(keys, market, ticker, d0, d1); 0 if none."""
    px = bars.select("market", "ticker", "d", "close")
    a = px.select("market", "ticker", F.col("d").alias("d0"), F.col("close").alias("p0"))
    b = px.select("market", "ticker", F.col("d").alias("d1"), F.col("close").alias("p1"))
    joined = names.join(a, ["market", "ticker", "d0"], "left").join(b, ["market", "ticker", "d1"], "left")
    move = F.when((F.col("p0") > 0) & F.col("p1").isNotNull(), F.col("p1") / F.col("p0") - 1.0)
    return joined.groupBy(*keys).agg(F.coalesce(F.avg(move), F.lit(0.0)).alias("r"))
