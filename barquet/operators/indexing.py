"""Volatility target, trend gate and the risk-managed index, on one return series per panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.operators.returns import compounded, daily_metrics
from barquet.operators.scan import discounted_sum, framed, with_position

LAMBDA = 0.94


def ewma_variance(
    returns: DataFrame, r: str = "r", keys: Sequence[str] = ("market",), order: str = "d",
    lam: float = LAMBDA, out: str = "var",
) -> DataFrame:
    """EWMA variance seeded with the first squared return; the row's own return is included."""
    df = with_position(returns, keys, (order,), bounded=True)
    square = F.col(r) * F.col(r)
    df = df.withColumn("_y", F.when(F.col("pos") == 0, square).otherwise(square * (1 - lam)))
    return discounted_sum(df, lam, "_y", out, keys).drop("_y")


def vol_scalar(
    returns: DataFrame, target: float = 0.12, r: str = "r", keys: Sequence[str] = ("market",), order: str = "d",
    lam: float = LAMBDA, min_obs: int = 20, floor: float = 0.02, low: float = 0.25, high: float = 1.0,
    inclusive: bool = False,
) -> DataFrame:
    """Exposure scalar at t from returns before t (through t when ``inclusive``); 1.0 until warmed up."""
    df = ewma_variance(returns, r, keys, order, lam)
    vol = F.greatest(F.sqrt(F.greatest(F.col("var"), F.lit(0.0))) * F.sqrt(F.lit(252.0)), F.lit(floor))
    df = df.withColumn(
        "_sc",
        F.when(F.col("pos") + 1 >= min_obs, F.greatest(F.lit(low), F.least(F.lit(high), target / vol))).otherwise(1.0),
    )
    if inclusive:
        return df.withColumnRenamed("_sc", "scalar")
    shifted = framed(df, lambda x, f: x.withColumn("scalar", F.coalesce(f.lag("_sc"), F.lit(1.0))), keys, (order,), back=1, bounded=True)
    return shifted.drop("_sc")


def trend_gate(
    returns: DataFrame, window: int | None = 200, r: str = "r", keys: Sequence[str] = ("market",), order: str = "d",
    inclusive: bool = False,
) -> DataFrame:
    """True while the index level stands above its trailing mean of ``window`` levels.

    The level series starts with 1.0 before the first return; the level used at t ends at t-1
    (at t when ``inclusive``). With fewer levels than the window the gate is open.
    """
    levels = compounded(returns, r, keys, (order,), out="level")
    if window is None:
        return levels.withColumn("in_market", F.lit(True))
    last = 0 if inclusive else -1
    first = last - window + 1

    def build(df, f):
        total = F.coalesce(F.sum("level").over(f.rows(first, last)), F.lit(0.0))
        known = F.col("pos") + 1 + last  # returns known at this row
        total = total + F.when(known < window, 1.0).otherwise(0.0)  # the initial level is in the frame
        now = F.col("level") if inclusive else F.coalesce(f.lag("level"), F.lit(1.0))
        return df.withColumn(
            "in_market", F.when(known + 1 >= window, now > total / window).otherwise(True)
        )

    return framed(levels, build, keys, (order,), back=window + 1, bounded=True)


def managed_index(
    returns: DataFrame, target: float = 0.12, max_leverage: float = 1.0, window: int | None = None,
    r: str = "r", keys: Sequence[str] = ("market",), order: str = "d", inclusive: bool = False,
) -> DataFrame:
    """Daily exposure = min(scalar, max leverage) x gate, and the strategy return it earns."""
    keys = list(keys)
    scaled = vol_scalar(returns, target, r, keys, order, high=max_leverage, inclusive=inclusive)
    gated = trend_gate(returns.select(*keys, order, r), window, r, keys, order, inclusive)
    joined = scaled.select(*keys, order, r, "scalar").join(
        gated.select(*keys, order, "level", "in_market"), [*keys, order]
    )
    exposure = F.least(F.col("scalar"), F.lit(max_leverage)) * F.when(F.col("in_market"), 1.0).otherwise(0.0)
    return joined.withColumn("exposure", exposure).withColumn("r_strat", F.col("exposure") * F.col(r))


def index_report(
    daily: DataFrame, keys: Sequence[str] = ("market",), order: str = "d", r: str = "r", r_strat: str = "r_strat",
    min_days: int = 30,
) -> DataFrame:
    """Metrics of a managed index and, as ``bench_...``, of holding it unmanaged, with its exposure.

    A series of fewer than ``min_days`` returns is an error.
    """
    keys = list(keys)
    metrics = lambda value: daily_metrics(daily.select(*keys, order, F.col(value).alias("r")), keys=keys)
    bench = metrics(r)
    for c in [c for c in bench.columns if c not in keys]:
        bench = bench.withColumnRenamed(c, f"bench_{c}")
    use = daily.groupBy(*keys).agg(
        F.avg("exposure").alias("avg_exposure"),
        F.avg(F.when(F.col("in_market"), 1.0).otherwise(0.0)).alias("time_in_market"),
        F.max_by("exposure", order).alias("latest_exposure"),
    )
    short = F.raise_error(F.format_string("%d returns; a report needs at least %d", "n_days", F.lit(min_days)))
    checked = F.when(F.col("n_days") < min_days, short.cast("long")).otherwise(F.col("n_days"))
    return metrics(r_strat).join(bench, keys).join(use, keys).withColumn("n_days", checked)


def latest_exposure(
    returns: DataFrame, target: float = 0.15, window: int | None = 200, max_leverage: float = 1.0,
    r: str = "r", keys: Sequence[str] = ("market",), order: str = "d",
) -> DataFrame:
    """Exposure after the last return of each series."""
    daily = managed_index(returns, target, max_leverage, window, r, keys, order, inclusive=True)
    return daily.groupBy(*keys).agg(
        F.max(order).alias("as_of"), F.max_by("exposure", order).alias("exposure")
    )
