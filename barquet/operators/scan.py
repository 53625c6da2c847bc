"""Ordered computations per key that never need one key in one task.

A symbol may hold any share of the rows, so no window here is partitioned by symbol alone.
Five tools replace it:

* ``with_position``  dense 0-based position per key, from block counts plus a rank inside a block;
* ``with_halo``      cuts a key's sequence into position chunks and copies the few rows a
                     bounded frame needs from the neighbouring chunk;
* ``running``        unbounded-preceding aggregates, from block totals plus a frame inside a block;
* ``in_order``       parts of the whole order by range cuts, where one order runs over many symbols;
* ``discounted_sum`` S[t] = q*S[t-1] + y[t] in two levels (EWMA, Wilder smoothing).

A series with one row per calendar date and panel (an index, an equity curve) is short by nature;
for those ``bounded=True`` takes the plain window per key.

All are built-in expressions; the tables with one row per (key, block) are the only ones a whole
key passes through, and their length is bounded by the time span over the block width.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.session import staged

SYMBOL = ("market", "ticker")

BLOCK_DAYS = 64
BLOCK_HOURS = 64


def time_block(df: DataFrame, order: str, width: int | None = None) -> Column:
    """Coarse, monotone bucket of the ordering column."""
    kind = dict(df.dtypes)[order]
    if kind == "date":
        return F.floor(F.unix_date(F.col(order)) / F.lit(width or BLOCK_DAYS))
    if kind.startswith("timestamp"):
        seconds = F.unix_seconds(F.col(order).cast("timestamp"))
        return F.floor(seconds / F.lit((width or BLOCK_HOURS) * 3600))
    return F.floor(F.col(order) / F.lit(width or BLOCK_DAYS))


PART = "_part"


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Deal rows into parts by sampled range cuts of the whole (keys, order) tuple, and write them.

    The number of a row's part is in ``_part`` and rises with the order of its key, whatever the values
    of the order are: a time that many rows share, or a symbol with most of the rows, is cut like any
    other stretch. ``with_position`` and ``running`` take parts as their blocks (``part=PART``).
    """
    if PART in df.columns:
        return df
    columns = [*keys, *order]
    cut = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return staged(cut.withColumn(PART, F.spark_partition_id()), "ordered")


def with_position(
    df: DataFrame,
    keys: Sequence[str] = SYMBOL,
    order: Sequence[str] = ("d",),
    out: str = "pos",
    width: int | None = None,
    bounded: bool = False,
    part: str | None = None,
) -> DataFrame:
    """Add the dense position of each row in its key's order. ``order`` must be unique per key.

    Blocks are stretches of time, or the values of a column ``part`` that rises with the order.
    """
    keys = list(keys)
    if bounded:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    df = df.withColumn("_blk", F.col(part) if part else time_block(df, order[0], width))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        df.join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_blk", "_off")
    )


def with_halo(
    df: DataFrame, back: int = 0, ahead: int = 0, pos: str = "pos", chunk: int | None = None
) -> DataFrame:
    """Copy each row into every chunk whose frames can reach it; ``_own`` marks the original."""
    size = chunk or max(4096, 4 * max(back, ahead))
    own = F.floor(F.col(pos) / F.lit(size))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(pos) - ahead) / F.lit(size)))
    last = F.floor((F.col(pos) + back) / F.lit(size))
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_chunk") == own
    )


def framed(
    df: DataFrame,
    build: Callable[[DataFrame, "Frames"], DataFrame],
    keys: Sequence[str] = SYMBOL,
    order: Sequence[str] = ("d",),
    back: int = 0,
    ahead: int = 0,
    chunk: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Run window expressions that look at most ``back`` rows behind and ``ahead`` rows ahead.

    ``build(df, frames)`` adds columns; the position column ``pos`` is present and stays.
    """
    if "pos" not in df.columns:
        df = with_position(df, keys, order, bounded=bounded)
    if bounded:
        return build(df, Frames(keys))
    cut = with_halo(df, back, ahead, chunk=chunk)
    built = build(cut, Frames([*keys, "_chunk"]))
    return built.filter("_own").drop("_own", "_chunk")


class Frames:
    """Window specs over one chunk, ordered by position."""

    def __init__(self, keys: Sequence[str]):
        self.w = W.partitionBy(*keys).orderBy("pos")

    def rows(self, lo: int, hi: int = 0):
        return self.w.rowsBetween(lo, hi)

    def lag(self, col: str | Column, n: int = 1) -> Column:
        return F.lag(col, n).over(self.w)

    def lead(self, col: str | Column, n: int = 1) -> Column:
        return F.lead(col, n).over(self.w)

    def full(self, n: int) -> Column:
        """True from the n-th row of the key on."""
        return F.col("pos") >= F.lit(n - 1)


def running(
    df: DataFrame,
    aggs: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = SYMBOL,
    order: Sequence[str] = ("d",),
    end: int = 0,
    by_range: bool = False,
    width: int | None = None,
    bounded: bool = False,
    part: str | None = None,
) -> DataFrame:
    """Unbounded-preceding aggregates: ``{out: (kind, column)}``, kind in sum/max/min/last/count.

    ``last`` skips NULL. ``end=-1`` leaves out the current row. ``by_range`` makes rows with an
    equal first ordering column visible to each other. ``part`` as in ``with_position``.
    """
    keys = list(keys)

    def near(w):
        frame = w.orderBy(order[0]).rangeBetween(W.unboundedPreceding, W.currentRow) if by_range else (
            w.orderBy(*order).rowsBetween(W.unboundedPreceding, end))
        return {
            "sum": lambda c: F.sum(c).over(frame),
            "count": lambda c: F.count(c).over(frame),
            "max": lambda c: F.max(c).over(frame),
            "min": lambda c: F.min(c).over(frame),
            "last": lambda c: F.last(c, ignorenulls=True).over(frame),
        }

    if bounded:
        whole = near(W.partitionBy(*keys))
        return df.select("*", *[whole[kind](col).alias(out) for out, (kind, col) in aggs.items()])
    if part and by_range:
        raise ValueError("rows of one time cannot see each other across parts of it")
    df = df.withColumn("_blk", F.col(part) if part else time_block(df, order[0], width))
    key_order = F.struct(*order)
    total = {
        "sum": lambda c: F.sum(c),
        "count": lambda c: F.count(c),
        "max": lambda c: F.max(c),
        "min": lambda c: F.min(c),
        "last": lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(key_order.alias("o"), F.col(c).alias("v")))),
    }
    totals = df.groupBy(*keys, "_blk").agg(
        *[total[kind](col).alias(f"_t_{out}") for out, (kind, col) in aggs.items()]
    )
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = {
        "sum": lambda c: F.sum(c).over(before),
        "count": lambda c: F.sum(c).over(before),
        "max": lambda c: F.max(c).over(before),
        "min": lambda c: F.min(c).over(before),
        "last": lambda c: F.max(c).over(before)["v"],
    }
    carried = totals.select(
        *keys, "_blk", *[carry[kind](f"_t_{out}").alias(f"_c_{out}") for out, (kind, _) in aggs.items()]
    )
    local = near(W.partitionBy(*keys, "_blk"))
    joined = df.join(carried, [*keys, "_blk"])
    joined = joined.select(
        "*", *[local[kind](col).alias(f"_l_{out}") for out, (kind, col) in aggs.items()]
    )
    columns = []
    for out, (kind, _) in aggs.items():
        here, far = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind in ("sum", "count"):
            both = F.coalesce(here, F.lit(0)) + F.coalesce(far, F.lit(0))
            both = both if kind == "count" else F.when(here.isNotNull() | far.isNotNull(), both)
        elif kind == "max":
            both = F.greatest(here, far)
        elif kind == "min":
            both = F.least(here, far)
        else:
            both = F.coalesce(here, far)
        columns.append(both.alias(out))
    return joined.select(*[c for c in df.columns if c != "_blk"], *columns)


def discounted_sum(
    df: DataFrame, q: float, y: str, out: str, keys: Sequence[str] = SYMBOL, size: int = 256
) -> DataFrame:
    """S[t] = sum over i<=t of q**(t-i) * y[i], on the dense ``pos`` of each key.

    Inside a chunk the sum is a scaled prefix sum (q**-size stays small); older chunks enter
    through their totals, as far back as q**distance is above double precision.
    """
    keys = list(keys)
    df = df.withColumn("_c", F.floor(F.col("pos") / size)).withColumn("_j", F.col("pos") % size)
    totals = df.groupBy(*keys, "_c").agg(
        F.sum(F.pow(F.lit(q), F.lit(size - 1) - F.col("_j")) * F.col(y)).alias("_t")
    )
    reach = max(1, math.ceil(80.0 / (-math.log(q) * size)))
    order = W.partitionBy(*keys).orderBy("_c")
    carry = F.lit(0.0)
    for k in range(1, reach + 1):
        carry = carry + F.coalesce(F.lag("_t", k).over(order), F.lit(0.0)) * (q ** (size * (k - 1)))
    carried = totals.select(*keys, "_c", carry.alias("_s"))
    inside = W.partitionBy(*keys, "_c").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    scaled = F.sum(F.pow(F.lit(q), -F.col("_j")) * F.col(y)).over(inside)
    value = F.pow(F.lit(q), F.col("_j")) * scaled + F.pow(F.lit(q), F.col("_j") + 1) * F.col("_s")
    return df.join(carried, [*keys, "_c"]).withColumn(out, value).drop("_c", "_j", "_s")


def value_ranks(
    df: DataFrame, group: Sequence[str], value: str, bounded: bool = False, splits: int = 31
) -> DataFrame:
    """Per group and distinct value: ``n`` rows hold it and ``before`` rows lie below it.

    Equal values collapse before the shuffle, so a heavy tie is one row. Unless the caller has
    checked that groups are small (``bounded``), a group is cut at approximate quantiles and the
    counts of the lower cuts are added; the cuts steer balance only, any cut points give the same
    result. ``df`` is read up to three times: stage it first.
    """
    group = list(group)
    base = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    if bounded:
        below = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return base.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    fractions = [i / (splits + 1) for i in range(1, splits + 1)]
    cuts = df.groupBy(*group).agg(F.percentile_approx(value, fractions, 1000).alias("_cuts"))
    base = base.join(cuts, group).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    lower = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*group, "_b")
        .agg(F.sum("n").alias("_t"))
        .withColumn("_off", F.coalesce(F.sum("_t").over(lower), F.lit(0)))
        .drop("_t")
    )
    below = W.partitionBy(*group, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        base.join(offsets, [*group, "_b"])
        .withColumn("before", F.col("_off") + F.coalesce(F.sum("n").over(below), F.lit(0)))
        .drop("_b", "_off")
    )


def linear_quantiles(ranks: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation from a ``value_ranks`` table."""
    sized = ranks.groupBy(*group).agg(F.sum("n").alias("_size"))
    table = ranks.join(sized, list(group))
    aggs = []
    for out, p in probs.items():
        at = F.lit(p) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)

        def holds(position: Column) -> Column:
            return (F.col("before") <= position) & (position < F.col("before") + F.col("n"))

        a = F.max(F.when(holds(low), F.col(value)))
        b = F.max(F.when(holds(high), F.col(value)))
        share = F.max(at - low)
        aggs.append((a + (b - a) * share).alias(out))
    return table.groupBy(*group).agg(*aggs, F.max("_size").alias("group_size"))
