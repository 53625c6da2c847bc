"""Cross-sectional candidate signals as window expressions over a symbol's own bars.

A signal is a name, the number of bars it needs, and a function of the frame helper that gives a
column; ``_r`` is the simple return of the bar. A row never sees a later row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL, Frames, framed, with_halo, with_position


@dataclass(frozen=True)
class Signal:
    bars: int
    column: Callable[[Frames], Column]


SIGNALS: dict[str, Signal] = {}


def register_signal(name: str, bars: int, column: Callable[[Frames], Column]) -> None:
    """Make a signal available by name; ``bars`` is the history it needs, its own bar included."""
    SIGNALS[name] = Signal(bars, column)


def _ratio(near: int, far: int) -> Callable[[Frames], Column]:
    def column(f: Frames) -> Column:
        top = f.lag("close", near) if near else F.col("close")
        return F.try_divide(top, f.lag("close", far)) - 1.0

    return column


def _negative(column: Callable[[Frames], Column]) -> Callable[[Frames], Column]:
    return lambda f: -column(f)


def _low_volatility(n: int):
    return lambda f: -F.stddev_samp("_r").over(f.rows(-(n - 1)))


def _illiquidity(n: int):
    def column(f: Frames) -> Column:
        traded = F.col("close") * F.col("volume")
        return F.avg(F.when(traded > 0, F.abs("_r") / traded)).over(f.rows(-(n - 1)))

    return column


def _volume_trend(short: int, long: int):
    def column(f: Frames) -> Column:
        base = F.avg("volume").over(f.rows(-(long - 1)))
        return F.when(base > 0, F.avg("volume").over(f.rows(-(short - 1))) / base - 1.0)

    return column


def _near_high(n: int):
    def column(f: Frames) -> Column:
        top = F.max("high").over(f.rows(-(n - 1)))
        return F.when(top > 0, F.col("close") / top)

    return column


def _negative_skewness(n: int):
    def column(f: Frames) -> Column:
        frame = f.rows(-(n - 1))
        return F.when(F.stddev_pop("_r").over(frame) > 0, -F.skewness("_r").over(frame))

    return column


register_signal("momentum_12_1", 253, _ratio(21, 252))
register_signal("momentum_12_2", 253, _ratio(42, 252))
register_signal("momentum_6_1", 127, _ratio(21, 126))
register_signal("momentum_3_1", 64, _ratio(21, 63))
register_signal("reversal_5", 6, _negative(_ratio(0, 5)))
register_signal("reversal_21", 22, _negative(_ratio(0, 21)))
register_signal("long_term_reversal", 757, _negative(_ratio(252, 756)))
register_signal("low_volatility_60", 61, _low_volatility(60))
register_signal("max_lottery_21", 22, lambda f: -F.max("_r").over(f.rows(-20)))
register_signal("pct_52w_high", 252, _near_high(252))
register_signal("amihud_21", 22, _illiquidity(21))
register_signal("volume_trend", 64, _volume_trend(21, 63))
register_signal("return_skewness_60", 61, _negative_skewness(60))


def with_return(df: DataFrame, f: Frames) -> DataFrame:
    return df.withColumn("_r", F.try_divide(F.col("close"), f.lag("close")) - 1.0)


def signals_wide(bars: DataFrame, names: Iterable[str], order: str = "d", ahead: int = 0, extra=None) -> DataFrame:
    """All named signals in one pass over one sort; NULL until a signal has its history.

    ``extra(df, frames)`` may add columns that need the same frames.
    """
    names = list(names)

    def build(df: DataFrame, f: Frames) -> DataFrame:
        df = with_return(df, f)
        df = df.select(
            "*", *[F.when(f.full(SIGNALS[n].bars), SIGNALS[n].column(f)).alias(n) for n in names]
        )
        return extra(df, f) if extra else df

    back = max([SIGNALS[n].bars for n in names], default=1)
    return framed(bars, build, order=(order,), back=back, ahead=ahead)


def signals_long(wide: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, signal) with a score; NULL and NaN scores are no opinion."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return (
        wide.selectExpr(*keep, f"stack({len(names)}, {pairs}) as (signal, score)")
        .filter(F.col("score").isNotNull() & ~F.isnan("score"))
    )


def python_signal(
    bars: DataFrame, fn: Callable[[Mapping[str, np.ndarray]], np.ndarray], history: int, name: str = "score",
    columns: Sequence[str] = ("open", "high", "low", "close", "volume"), order: str = "d",
) -> DataFrame:
    """A Python function of the trailing ``history`` bars, for signals no expression can give.

    ``fn`` is called once per chunk: it gets each column as a matrix with one row per bar, the ``history`` values
    up to it (a view, nothing is copied), and returns one number per row; NaN is no opinion. A chunk is
    bounded and comes with its halo as Arrow columns; no task holds a whole symbol.
    """
    kind = dict(bars.dtypes)[order]
    keep = [*SYMBOL, order, *columns]
    placed = with_halo(with_position(bars.select(*keep), order=(order,)), back=history - 1, chunk=max(1024, 2 * history))

    def per_chunk(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("pos")
        scores = np.full(len(chunk), np.nan)
        if len(chunk) >= history:
            numbers = {c: chunk[c].to_numpy().astype(np.float64) for c in columns}
            views = {c: np.lib.stride_tricks.sliding_window_view(v, history) for c, v in numbers.items()}
            scores[history - 1 :] = fn(views)
        # a chunk begins with the halo, so only a symbol's first bars lack history
        scored = chunk.select([*SYMBOL, order]).append_column(name, pa.array(scores, from_pandas=True))
        return scored.filter(chunk["_own"])

    schema = f"market string, ticker string, {order} {kind}, {name} double"
    return placed.groupBy(*SYMBOL, "_chunk").applyInArrow(per_chunk, schema)
