"""Exact top-k inner products with KD-trees: a median tree deals the rows into shards, each shard keeps its own.

The upper tree comes from a sample of at most ``SAMPLE`` rows: the widest coordinate is cut at its
median until a shard has about ``SHARD`` rows, so shards are regions and not random lots. Each shard
grows its tree by exact medians down to ``LEAF`` rows and is written once as one row: tight boxes of all nodes,
ids and vectors. The largest inner product a query can have inside a box is the sum over the
coordinates of the larger of q*low and q*high.

A query is bounded against the boxes of all shards (in blocks; boxes only) and visits shards best
bound first, in rounds of 1, 4, 16 and the rest. After each round its kth score so far is a floor
for the next: a shard with a smaller bound is never sent the query. Inside a shard the tree is traversed
best first from its root: the next node is the one with the best bound, and the traversal ends
at the first bound below the kth score. Bounds that tie with it are still followed, as ties go by id.

Rows with equal vectors have equal scores, so of each vector only the ``k + 1`` smallest ids are searched; a
vector that very many rows share cannot fill a shard. Queries are a stated set, met in blocks.

Scores are exact. While the sums stay below 2**53 they are taken in doubles; shards and queries with
larger numbers are scored in Python's whole numbers, without bounds, and a score outside 64 bits is the
nearest number inside. Defined results: vectors that are null, empty or hold null or non-finite
numbers take no part; vectors meet only those of their own length; ties go to the smaller id; rows
with the same id are one row (the smallest vector stays). Extra columns are never read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_batches
from .crosspolytope import first_ids
from .vectors import matrix, sound_vectors

SHARD = 8192
LEAF = 256
SAMPLE = 16_384
#: Queries and boxes of one cell.
BLOCK = 4096
#: Shards that a query has visited at most after each round but the last.
VISITS = (1, 5, 21)
EXACT, FINITE = float(1 << 53), 1.7e308
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


@dataclass
class Tree:
    """A KD-tree over ``x``, whose rows are in the order of its leaves. ``nodes``: left, right (-1 in leaves), start, stop."""

    x: np.ndarray
    ids: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grow(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.lexsort((ids,))
    nodes, low, high = [[-1, -1, 0, len(x)]], [], []
    at = 0
    while at < len(nodes):
        _, _, start, stop = nodes[at]
        part = x[order[start:stop]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        spread = high[-1] - low[-1]
        axis = int(spread.argmax())
        if stop - start > leaf and spread[axis] > 0:
            order[start:stop] = order[start:stop][np.argsort(part[:, axis], kind="stable")]
            middle = (start + stop) // 2
            nodes[at][:2] = [len(nodes), len(nodes) + 1]
            nodes += [[-1, -1, start, middle], [-1, -1, middle, stop]]
        at += 1
    return Tree(x[order], ids[order], np.array(nodes, np.int64), np.array(low), np.array(high))


def traverse(tree: Tree, q: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the query's ``k`` best rows of the tree that reach ``floor``, best node first."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)

    def bound(node: int) -> float:
        return float(up @ tree.high[node] + down @ tree.low[node])

    scores, ids = np.zeros(0), np.zeros(0, np.int64)
    kth = floor
    heap = [(-bound(0), 0)]
    while heap:
        best, node = heapq.heappop(heap)
        if -best < kth:
            break
        left, right, start, stop = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                if (reach := bound(child)) >= kth:
                    heapq.heappush(heap, (-reach, int(child)))
            continue
        found = tree.x[start:stop] @ q
        good = np.flatnonzero((found >= kth) & (tree.ids[start:stop] != own))
        if len(good):
            scores = np.concatenate([scores, found[good]])
            ids = np.concatenate([ids, tree.ids[start:stop][good]])
            first = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[first], ids[first]
            if len(scores) == k:
                kth = max(floor, scores[-1])
    return scores, ids


def all_rows(tree: Tree, q: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
    """The same by whole numbers of any size, row by row."""
    whole = [int(c) for c in q]
    found = [
        (-max(LOWEST, min(HIGHEST, sum(a * int(b) for a, b in zip(whole, row)))), int(i))
        for row, i in zip(tree.x, tree.ids) if i != own
    ]
    best = heapq.nsmallest(k, found)
    return [-s for s, _ in best], [i for _, i in best]


def cuts(sample: np.ndarray, shards: int) -> list[tuple[int, float, int, int]]:
    """The upper tree: (axis, cut, left, right) per node; a child below zero is shard ``-1 - child``."""
    nodes: list[list] = []
    leaves = 0
    todo = [(sample, shards, -1, 0)]
    while todo:
        rows, want, parent, side = todo.pop(0)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if want > 1 and spread[axis] > 0:
            me = len(nodes)
            cut = float(np.median(rows[:, axis]))
            under = rows[:, axis] < cut
            if not under.any():
                cut = float(rows[:, axis].max())
                under = rows[:, axis] < cut
            nodes.append([axis, cut, 0, 0])
            todo += [(rows[under], want // 2, me, 2), (rows[~under], want - want // 2, me, 3)]
        else:
            me, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def shard_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    while (live := np.flatnonzero(at >= 0)).size:
        axis = np.array([nodes[i][0] for i in at[live]])
        cut = np.array([nodes[i][1] for i in at[live]])
        left, right = (np.array([nodes[i][s] for i in at[live]]) for s in (2, 3))
        at[live] = np.where(x[live, axis] < cut, left, right)
    return -1 - at


def shard_column(v: str, trees: dict[int, list[tuple[int, float, int, int]]]) -> Column:
    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column), np.int64)
        size = column.map(len).to_numpy()
        for dim in np.unique(size):
            if trees.get(int(dim)):
                mine = np.flatnonzero(size == dim)
                out[mine] = shard_of(matrix(column.iloc[mine]), trees[int(dim)])
        return pd.Series(out)

    return run(v)


SHARDS = "dim int, shard long, low array<double>, high array<double>, shape array<int>, ids binary, x binary, nodes binary, lows binary, highs binary"


def _grown(leaf: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = grow(matrix(rows["v"]), rows["vec_id"].to_numpy(np.int64), leaf)
        packed = [[a.tobytes()] for a in (tree.ids, tree.x, tree.nodes, tree.low, tree.high)]
        return pd.DataFrame({
            "dim": [tree.x.shape[1]], "shard": [rows["shard"].iloc[0]], "low": [tree.low[0]], "high": [tree.high[0]],
            "shape": [[len(tree.x), len(tree.nodes)]], **dict(zip(("ids", "x", "nodes", "lows", "highs"), packed, strict=True)),
        })

    return run


def _unpacked(row: pd.Series) -> Tree:
    rows, nodes = row["shape"]
    dim = int(row["dim"])

    def read(name: str, kind: type, shape: tuple[int, ...]) -> np.ndarray:
        return np.frombuffer(row[name], kind).reshape(shape)

    return Tree(
        read("x", np.float64, (rows, dim)), read("ids", np.int64, (rows,)), read("nodes", np.int64, (nodes, 4)),
        read("lows", np.float64, (nodes, dim)), read("highs", np.float64, (nodes, dim)),
    )


def _visit(k: int):
    def run(asks: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asks) and len(shards):
            tree = _unpacked(shards.iloc[0])
            most = np.abs(tree.x).max() * float(tree.x.shape[1])
            for own, q, floor in zip(asks["query_id"], asks["v"], asks["floor"], strict=True):
                q = np.asarray(q, np.float64)
                if most * np.abs(q).max() < EXACT:
                    found = traverse(tree, q, own, floor, k)
                else:
                    found = all_rows(tree, q, own, k)
                out += [(own, int(i), int(s)) for s, i in zip(*found, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pd.DataFrame({n: np.array(c, np.int64) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def _bounds(cell: pd.DataFrame) -> pd.DataFrame:
    """The bound of every shard of the cell for every query of the cell."""
    asks, boxes = cell[cell["asking"]], cell[~cell["asking"]]
    if not len(asks) or not len(boxes):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "shard": np.zeros(0, np.int64), "bound": np.zeros(0)})
    q = matrix(asks["v"])
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ matrix(boxes["high"]).T + np.minimum(q, 0) @ matrix(boxes["v"]).T
        # beyond exact sums: room for rounding, and the range that scores have
        bound = np.where(np.abs(bound) < EXACT, bound, np.clip(np.nan_to_num(bound, nan=np.inf) + np.abs(bound) * 1e-6, LOWEST, HIGHEST))
    bound = np.nan_to_num(bound, nan=float(HIGHEST))
    return pd.DataFrame({
        "query_id": np.repeat(asks["id"].to_numpy(), len(boxes)),
        "shard": np.tile(boxes["id"].to_numpy(), len(asks)),
        "bound": bound.ravel(),
    })


def top_products(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard: int = SHARD,
    block: int = BLOCK,
    leaf: int = LEAF,
    visits: tuple[int, ...] = VISITS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(scale * x) vectors.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    bounded_batches(table.sparkSession, 4096)

    def quantised(x: Column) -> Column:
        y = F.greatest(F.least(x * scale, F.lit(FINITE)), F.lit(-FINITE))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    whole_numbers = F.transform("v", quantised)
    vecs = staged(
        sound_vectors(table, vec_id, vector).select("vec_id", whole_numbers.alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v")),
        "quantised",
    )
    asks = vecs.filter(is_query).withColumn("dim", F.size("v"))
    # of rows with one vector only the first ids can come in
    classes = vecs.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    crowd = vecs.join(classes.filter(F.col("n") > k + 1).select("v", "rep"), "v")
    beyond = crowd.join(first_ids(crowd.select("rep", "vec_id"), "rep", k + 1).select("vec_id"), "vec_id", "left_anti").select("vec_id")
    rows = staged(vecs.join(beyond, "vec_id", "left_anti").withColumn("dim", F.size("v")), "rows")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().toLocalIterator()}
    total = sum(sizes.values())
    trees = {}
    if total > shard:
        drawn = rows.filter(F.rand(1) < min(1.0, SAMPLE / total)).select("dim", "v").toLocalIterator()
        lists: dict[int, list] = {}
        for r in drawn:
            lists.setdefault(r["dim"], []).append(r["v"])
        trees = {d: cuts(np.array(v, float), -(-sizes[d] // shard)) for d, v in lists.items()}
    placed = rows.withColumn("shard", shard_column("v", trees))
    shards = staged(placed.groupBy("dim", "shard").applyInPandas(_grown(leaf), SHARDS), "shards")

    # every query against every shard's box, in cells
    asked = asks.count()
    q_blocks, s_blocks = (F.lit(n) for n in (max(1, -(-asked // block)), max(1, -(-total // (shard * block)))))
    number = F.pmod(F.xxhash64("id"), q_blocks).cast("int")
    left = asks.select("dim", F.col("vec_id").alias("id"), "v", F.lit(None).cast("array<double>").alias("high"), F.lit(True).alias("asking"))
    left = left.withColumn("i", number).withColumn("j", F.explode(F.sequence(F.lit(0), s_blocks - 1)))
    right = shards.select("dim", F.col("shard").alias("id"), F.col("low").alias("v"), "high", F.lit(False).alias("asking"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), q_blocks - 1))).withColumn("j", F.pmod(F.xxhash64("id"), s_blocks).cast("int"))
    bounds = left.unionByName(right).groupBy("dim", "i", "j").applyInPandas(_bounds, "query_id long, shard long, bound double")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "shard"))
    plan = staged(bounds.withColumn("turn", turn), "plan")

    best: DataFrame | None = None
    done = 0
    for until in (*visits, None):
        part = plan.filter((F.col("turn") > done) & (F.col("turn") <= until if until else F.lit(True)))
        if best is None:
            part = part.withColumn("floor", F.lit(float("-inf")))
        else:
            kth = best.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("n"))
            floor = F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf"))
            part = part.join(kth, "query_id", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf")))).filter("bound >= floor")
        sent = part.join(asks.select(F.col("vec_id").alias("query_id"), "dim", "v"), "query_id").select("query_id", "dim", "v", "shard", "floor")
        sent = staged(sent, "sent")
        if until is None and sent.isEmpty():
            break
        lots = sent.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / block).alias("lots"))
        keys = ["dim", "shard", "lot"]
        q_side = sent.join(lots, ["dim", "shard"]).withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots")).drop("lots")
        s_side = shards.join(lots, ["dim", "shard"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots", "low", "high")
        found = q_side.groupBy(*keys).cogroup(s_side.groupBy(*keys)).applyInPandas(_visit(k), FOUND)
        every = found if best is None else best.unionByName(found)
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = staged(every.withColumn("_n", order).filter(F.col("_n") <= k).drop("_n"), "best")
        done = until
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
