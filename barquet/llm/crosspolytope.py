"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (random signs, then a Hadamard transform, three
times) and falls to the nearest signed axis. Each of ``TABLES`` tables has ``HASHES`` such rotations.
A candidate enters one bucket a table; a query also probes the next nearest axes. Inside a bucket
all candidates are scored exactly for the queries that reach it, as one matrix product, and a query
leaves with its best few; the tables' results are merged.

Equal vectors are one class, scored once; the class stands for its smallest ids. A bucket is dealt
in chunks of ``CHUNK`` classes and blocks of ``CHUNK`` queries, by counts taken first, so a crowded
bucket is many groups. One hash of a d-dimensional vector has 2d buckets: raise ``hashes`` (and
``tables``) where a bucket would hold too many rows to score.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take no part;
vectors meet only those of their own length; ties go to the smaller id; a query with no candidate
has no row; rows with the same id are one row (the smallest of its vectors). Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_batches
from .vectors import matrix, sound_vectors

TABLES = 16
HASHES = 1
PROBES = 8
CHUNK = 4096
SALTS = 32
MARGIN = 4
SEED = 11


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = y.shape
    half = 1
    while half < d:
        y = y.reshape(n, d // (2 * half), 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        half *= 2
    return y.reshape(n, d)


def rotated(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """The ``number``-th pseudo-rotation of the rows of ``x``, padded to a power of two."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :d] = x
    signs = np.random.default_rng([seed, number, size])
    for _ in range(3):
        y = hadamard(y * signs.choice([-1.0, 1.0], size))
    return y


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """Per row the nearest ``probes`` signed axes, nearest first; axis i is 2i, its opposite 2i + 1."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Bucket numbers, rows by (tables * probes ** hashes); table t's lie together."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for t in range(tables):
        code = np.zeros((len(x), 1), np.int64)
        for h in range(hashes):
            near = axes(rotated(x, t * hashes + h, seed), probes)
            span = 2 << max(0, x.shape[1] - 1).bit_length()
            code = (code[:, :, None] * span + near[:, None, :]).reshape(len(x), -1)
        out.append(code)
    return np.concatenate(out, axis=1)


def bucket_column(v: str, tables: int, hashes: int, probes: int, seed: int = SEED) -> Column:
    @F.pandas_udf("array<long>")
    def run(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), dtype=object)
        lengths = column.map(len)
        for _, part in column.groupby(lengths):
            out[part.index] = list(buckets(matrix(part), tables, hashes, probes, seed))
        return out

    return run(F.col(v))


def _reached(points: DataFrame, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    """rep, v, dim, tab, bucket: one row for each bucket that a point enters."""
    each = probes**hashes
    at = points.withColumn("codes", bucket_column("v", tables, hashes, probes, seed))
    return at.select("rep", "v", F.size("v").alias("dim"), F.posexplode("codes").alias("i", "bucket")).select(
        "rep", "v", "dim", F.expr(f"i div {each}").cast("int").alias("tab"), "bucket"
    )


def _best(group: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` best candidate classes of every query of one group."""
    query, cand = group[group["asking"]], group[~group["asking"]]
    if not len(query) or not len(cand):
        return pd.DataFrame({"q": [], "rep": [], "score": []})
    cand = cand.sort_values("rep")
    a, b = matrix(query["v"]), matrix(cand["v"])
    size_a, size_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    near = (a @ b.T) / (size_a[:, None] * size_b[None, :])
    # a product of matrices may differ in the last bit from group to group: with a margin for that, and then
    # exactly, each pair by itself
    some = np.argsort(-near, axis=1, kind="stable")[:, : keep + MARGIN]
    score = np.stack([(x * b[at]).sum(axis=1) for x, at in zip(a, some, strict=True)])
    score /= size_a[:, None] * size_b[some]
    reps = cand["rep"].to_numpy()[some]
    order = np.lexsort((reps, -score), axis=1)[:, :keep]
    return pd.DataFrame(
        {
            "q": np.repeat(query["rep"].to_numpy(), order.shape[1]),
            "rep": np.take_along_axis(reps, order, axis=1).ravel(),
            "score": np.take_along_axis(score, order, axis=1).ravel(),
        }
    )


def first_ids(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """The ``keep`` smallest vec_id of each key, in two steps so that no key is one task."""
    salted = W.partitionBy(key, F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    some = rows.withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= keep).drop("_n")
    return some.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("vec_id"))).filter(F.col("_n") <= keep).drop("_n")


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    chunk: int = CHUNK,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query row.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    bounded_batches(table.sparkSession, 4096)
    sound = sound_vectors(table, vec_id, vector).filter(F.exists("v", lambda x: x != 0.0))
    vecs = staged(sound.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    classes = staged(
        vecs.groupBy("v").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max(F.when(is_query, 1).otherwise(0)).alias("asks")
        ),
        "classes",
    )
    crowd = vecs.join(classes.filter("n > 1").select("v", "rep"), "v").select("rep", "vec_id")
    members = first_ids(crowd, "rep", k + 1).unionByName(
        classes.filter("n = 1").select("rep", F.col("rep").alias("vec_id"))
    )
    keys = ["dim", "tab", "bucket"]
    cand = _reached(classes, tables, hashes, 1, seed)
    asks = _reached(classes.filter("asks = 1"), tables, hashes, probes, seed)

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))

    dealt = staged(parts(cand, "chunks").join(parts(asks, "blocks"), keys), "buckets")
    mix = F.xxhash64("rep")
    cand = cand.join(dealt, keys).select(
        "rep", "v", *keys, F.pmod(mix, "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    asks = asks.join(dealt, keys).select(
        "rep", "v", *keys, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(mix, "blocks").cast("int").alias("block"),
    )
    group = [*keys, "chunk", "block"]
    keep = k + 1
    met = asks.withColumn("asking", F.lit(True)).unionByName(cand.withColumn("asking", F.lit(False)))
    found = met.groupBy(*group).applyInPandas(lambda g: _best(g, keep), "q long, rep long, score double")
    best = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "rep"]
    best = best.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(*order))).filter(F.col("_n") <= keep)
    rows = best.drop("_n").join(members, "rep")
    ranked = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = (
        rows.withColumn("_n", F.row_number().over(ranked))
        .filter(F.col("_n") <= keep)
        .groupBy("q")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    )
    queries = vecs.filter(is_query).join(classes.select("v", F.col("rep").alias("q")), "v").select("q", F.col("vec_id").alias("query_id"))
    picked = queries.join(lists, "q").select(
        "query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near")
    )
    return picked.select("query_id", F.posexplode("near").alias("i", "x")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )
