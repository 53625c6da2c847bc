"""Near-duplicates by SimHash: segment-popcount embedding, grid range join, exact check.

A 64-bit fingerprint is mapped to the bit counts of its 2-bit segments, written as thermometer
codes (00, 01, 11), so that the Manhattan distance of two embeddings is the bit count of their xor.
It is a lower bound of the Hamming distance. The range join "Manhattan distance at most 2" runs on
a grid: the segments form five axes, and two points within 2 agree on at least three of them, so
both fall into one of ten cells of three axes each. Inside a cell the bound is tested first and the
Hamming distance after it.

A cell with more than ``CELL_ROWS`` fingerprints is not searched by pairs. Its fingerprints are
linked through midpoints: two fingerprints within 2 share a 64-bit word within 1 of both, so each
emits itself and its 64 one-bit neighbours; all (at most 65) that meet in one word are within 2 of
each other and form a star. That path is exact as well; no link is lost, and no group, however
large, makes more than 65 rows per member.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; repeated
rows share a fingerprint; a null id never becomes a component id unless all ids of the component
are null. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_batches, whole
from .graph import components

RADIUS = 2
CELL_ROWS = 64
SHINGLE = 3
SEED = 42
LOW_BITS = 0x5555555555555555
#: Axes as runs of 2-bit segments: 7 + 7 + 6 + 6 + 6 = 32.
AXIS_SEGMENTS = (7, 7, 6, 6, 6)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cell_masks() -> list[int]:
    """Bit masks of the ten cells: every choice of three of the five axes."""
    axes, at = [], 0
    for n in AXIS_SEGMENTS:
        axes.append(((1 << (2 * n)) - 1) << at)
        at += 2 * n
    keep = len(axes) - RADIUS
    return [signed(sum(c)) for c in combinations(axes, keep)]


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, how many of the hashes have it set."""
    low = np.uint64(0x0101010101010101)
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        short = -len(part) % 255
        part = np.concatenate([part, np.zeros(short, np.uint64)]).reshape(-1, 255)
        for k in range(8):
            # eight byte-wide counters per word; 255 rows cannot overflow one
            lanes = ((part >> np.uint64(k)) & low).sum(axis=1, dtype=np.uint64)
            totals[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return totals


def fingerprint(text: str, step: int = 65_536) -> int:
    """SimHash of the whole text's 3-word shingles, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    totals, count = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, count, step):
        part = words[at : at + step + SHINGLE - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[: -SHINGLE] + 1])
        pairs = zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        totals += bit_totals(
            np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(part) - SHINGLE + 1)
        )
    return sum(1 << i for i in np.flatnonzero(2 * totals > count).tolist())


def fingerprints(text: str | Column) -> Column:
    """Fingerprint column as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([signed(fingerprint(t)) for t in batch], dtype="int64")

    return run(whole(text))


def embedding(fp: Column) -> Column:
    """Bit counts of the 2-bit segments as thermometer codes in one long."""
    above = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(above).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(above).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def links(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` within 2 bits.

    Cold cells give every link; crowded ones give the stars of shared midpoints.
    """
    point = F.col("fp")
    code = embedding(point)
    cells = fps.select(
        point,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("axes"), code.bitwiseAND(F.lit(m)).alias("cell"))
                    for i, m in enumerate(cell_masks())
                ]
            )
        ).alias("c"),
    ).select("fp", "c.axes", "c.cell")
    crowded = staged(
        cells.groupBy("axes", "cell").count().filter(F.col("count") > cell_rows).select("axes", "cell"), "crowded"
    )
    members = (
        cells.join(crowded, ["axes", "cell"], "left_anti")
        .groupBy("axes", "cell")
        .agg(F.collect_list("fp").alias("m"))
        .filter(F.size("m") > 1)
    )

    def partners(a: Column) -> Column:
        def near(b: Column) -> Column:
            bound = F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= RADIUS
            return (b > a) & bound & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)

        return F.transform(F.filter("m", near), lambda b: F.struct(a.alias("a"), b.alias("b")))

    cold = members.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.a", "e.b")
    inside = cells.join(crowded, ["axes", "cell"], "left_semi").select("fp").distinct()
    flips = F.array(point, *[point.bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    stars = (
        inside.select("fp", F.explode(flips).alias("mid"))
        .groupBy("mid")
        .agg(F.array_sort(F.collect_list("fp")).alias("m"))
        .filter(F.size("m") > 1)
        .select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 65)).alias("b"))
    )
    return cold.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp (signed long), root, component_id.

    ``root`` is the fingerprint that names the component, ``component_id`` its smallest id.
    """
    bounded_batches(docs.sparkSession)
    marked = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.xxhash64(whole(text)).alias("text_hash"), fingerprints(text).alias("fp")
        ),
        "fingerprints",
    )
    fps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fp")
    labels = components(links(fps))
    rooted = fps.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_digits(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp) if isinstance(fp, str) else fp)), 16, "0")
