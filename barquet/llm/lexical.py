"""Ranked lexical search: item vocabulary tiles times document impact tiles, by dense products.

Terms are the longest runs of ASCII letters, digits and characters beyond ASCII; A to Z are
lower-cased. A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, its impact in a document
``(10**9 * tf) div (1000 * tf + 8m)`` with ``m = 25 + (75 * n * N) div L``; a document's score is the
sum of weight times impact over the item's terms, repeats included. N counts the documents with a
term, L all their terms, n one document's terms, df the documents with the term, tf its occurrences.

Items come in tiles of at most ``TILE_TERMS`` terms in all (one item above that is a tile of its
own), so what a task holds of them is bounded; the documents are read once for a tile. One pass
over the texts keeps each document's length and its counts of the tile's terms, written once; df,
N and L are aggregates of that table. In the second pass a batch of documents is one tile: items
are taken ``GROUP`` at a time with the compact vocabulary of just these items, impacts of the
batch are laid out densely over slices of it and multiplied in float64. A slice ends before the largest
sum any item could reach in it passes 2**53, so each product is exact; sums over slices are 64-bit
integers. Terms whose weight alone could pass that bound are multiplied in integers. Each tile keeps,
for every item, all documents that reach its kth score, then the first k by score and id, so ties
at the cut are settled by id. The tiles' winners meet in two rounds, per item and part, then per item.

Defined results: null and blank texts have no term, do not count in N and score 0 (no row). A null
item id takes no part; rows that repeat an item id are one item, of its smallest text (null last). Rows that
repeat a document id are documents of their own, and each may take a rank; a null id comes after
all others. No item, no document or no common term gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_batches, whole

#: Terms (repeats included) of the items that one pass over the documents serves.
TILE_TERMS = 1 << 20
#: Items multiplied at once, and the widest slice of their vocabulary.
GROUP, SLICE = 128, 2048
EXACT = 1 << 53
IMPACT = 1_000_000  # an impact is below this
PARTS = 64
NO_ID = (1 << 63) - 1

#: Bytes that belong to terms keep their place (A to Z as a to z), all others part terms.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _counted(names: list[bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per document its length and the places (in ``names``) and counts of the terms it holds."""
    place = {t: i for i, t in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = terms(text)
                if found:
                    held = [(place[t], c) for t, c in Counter(found).items() if t in place]
                    rows.append((doc_id, len(found), [i for i, _ in held], [c for _, c in held]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "place", "tf"])

    return run


def slices(weights: np.ndarray, width: int = SLICE, limit: int = EXACT) -> list[slice]:
    """Cuts of the columns of ``weights`` (items x terms) so that no item's sum in a slice can pass ``limit``."""
    out, start = [], 0
    reach = np.zeros(len(weights), np.int64)
    for at in range(weights.shape[1]):
        more = reach + weights[:, at] * IMPACT
        if at > start and (at - start == width or more.max() >= limit):
            out.append(slice(start, at))
            start, more = at, weights[:, at] * IMPACT
        reach = more
    return [*out, slice(start, weights.shape[1])] if weights.shape[1] else out


class _Group:
    """A few items over the compact vocabulary of their terms: exact slices and heavy columns."""

    def __init__(self, items: list[Counter], weight: np.ndarray):
        self.vocabulary = np.unique(np.concatenate([np.fromiter(c, np.int64, len(c)) for c in items]))
        at = np.searchsorted(self.vocabulary, np.arange(len(weight)))
        table = np.zeros((len(items), len(self.vocabulary)), np.int64)
        for row, counts in enumerate(items):
            for term, times in counts.items():
                table[row, at[term]] = times * int(weight[term])
        heavy = table.max(axis=0) >= EXACT // IMPACT
        self.heavy, self.heavy_weights = np.flatnonzero(heavy), table[:, heavy]
        self.light = np.flatnonzero(~heavy)
        self.column = np.full(len(weight), -1)
        self.column[self.vocabulary] = np.arange(len(self.vocabulary))
        light = table[:, ~heavy]
        self.slices = [(s, light[:, s].astype(np.float64)) for s in slices(light)]

    def scores(self, docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """(docs x items) exact scores from the sparse impacts of a tile of documents."""
        column = self.column[term]
        here = column >= 0
        dense = np.zeros((docs, len(self.vocabulary)))
        dense[row[here], column[here]] = impact[here]
        out = np.zeros((docs, len(self.heavy_weights)), np.int64)
        whole_tile = dense if not len(self.heavy) else dense[:, self.light]
        for cut, weights in self.slices:
            out += (whole_tile[:, cut] @ weights.T).astype(np.int64)
        for j, at in enumerate(self.heavy.tolist()):
            out += dense[:, at].astype(np.int64)[:, None] * self.heavy_weights[:, j][None, :]
        return out


def tile_top(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per column its first k rows by (score, falling; id, rising), of those above 0: (column, rows)."""
    for at in range(scores.shape[1]):
        mine = scores[:, at]
        rows = np.flatnonzero(mine > 0)
        if len(rows) > k:
            kth = np.partition(mine[rows], len(rows) - k)[len(rows) - k]
            rows = rows[mine[rows] >= kth]
        if len(rows):
            yield at, rows[np.lexsort((ids[rows], -mine[rows]))[:k]]


def _ranked(
    items: list[tuple[int, Counter]], weight: np.ndarray, documents: int, length: int, k: int, group: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = range(0, len(items), group)
        groups = [_Group([c for _, c in items[i : i + group]], weight) for i in cuts]
        item_ids = np.array([i for i, _ in items], np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["doc_id"].to_numpy(np.int64)
            m = 25 + (75 * batch["n"].to_numpy(np.int64) * documents) // length
            row = np.repeat(np.arange(len(batch)), batch["place"].map(len).to_numpy(np.int64))
            if not len(row):
                continue
            term = np.concatenate(batch["place"].to_list()).astype(np.int64)
            tf = np.concatenate(batch["tf"].to_list()).astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            for start, part in zip(cuts, groups, strict=True):
                scores = part.scores(len(batch), row, term, impact)
                for at, rows in tile_top(scores, ids, k):
                    new_s, new_i = scores[rows, at], ids[rows]
                    if (old := best.get(start + at)) is not None:
                        new_s, new_i = np.concatenate([old[0], new_s]), np.concatenate([old[1], new_i])
                        first = np.lexsort((new_i, -new_s))[:k]
                        new_s, new_i = new_s[first], new_i[first]
                    best[start + at] = (new_s, new_i)
        for at, (s, i) in best.items():
            yield pd.DataFrame({"item_id": item_ids[at], "doc_id": i, "score": s})

    return run


def _tiled(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Items with the number of their tile; tiles hold ``limit`` terms at most, or one item."""
    tiles = 1
    while True:
        dealt = items.withColumn("tile", F.pmod(F.xxhash64("item_id", F.lit(tiles)), F.lit(tiles)).cast("int"))
        full = dealt.groupBy("tile").agg(F.sum(F.length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
        most = full.filter((F.col("size") > 2 * limit) & (F.col("n") > 1)).agg(F.max("size")).first()[0]
        if most is None:
            return dealt, tiles
        tiles = max(2 * tiles, -(-most * tiles // (2 * limit)))


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    tile_terms: int = TILE_TERMS,
    group: int = GROUP,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    bounded_batches(documents.sparkSession)
    wanted = (
        items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
        .filter("item_id IS NOT NULL").groupBy("item_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    )
    # a term takes a code point and a separator at least, so a tile of 2 x limit code points holds the limit
    dealt, tiles = _tiled(staged(wanted, "items"), tile_terms)
    # a null id travels as the largest number: pandas would turn a column of longs with nulls into doubles
    docs = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole(text).alias("text"))
    found = [part for tile in range(tiles) if (part := _search_tile(docs, dealt.filter(F.col("tile") == tile), k, group)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for part in found[1:]:
        best = best.unionAll(part)

    def first(frame: DataFrame, *keys: str) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        return frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    parts = first(best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "item_id", "part").drop("rank", "part")
    no_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return first(parts, "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), no_id, "score")


def _search_tile(docs: DataFrame, tile: DataFrame, k: int, group: int) -> DataFrame | None:
    """Candidates (item_id, doc_id, score) for the items of one tile, whose texts are bounded."""
    counted = [(r["item_id"], Counter(terms(r["text"]))) for r in tile.orderBy("item_id").toLocalIterator()]
    counted = [(i, c) for i, c in counted if c]
    if not counted:
        return None
    names = sorted(set().union(*(c for _, c in counted)))
    place = {t: i for i, t in enumerate(names)}
    held = staged(docs.mapInPandas(_counted(names), "doc_id long, n long, place array<int>, tf array<int>"), "counts")
    n_docs, length = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    # one row per term of the tile: bounded as the tile is
    df = held.select(F.explode("place").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    known = np.zeros(len(names), np.int64)
    for r in df.select("place", weight.cast("long").alias("w")).collect():
        known[r["place"]] = r["w"]
    coded = [(i, Counter({place[t]: n for t, n in c.items()})) for i, c in counted]
    ranked = _ranked(coded, known, n_docs, length, k, group)
    return held.mapInPandas(ranked, "item_id long, doc_id long, score long")


def oracle(documents: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """DuckDB SQL for ``search``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def found(text: str) -> str:
        return f"unnest(regexp_extract_all(translate({text}, '{upper}', '{lower}'), '{pattern}'))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM {documents}),
t AS (SELECT row_id, doc_id, {found("text")} AS term FROM d),
tf AS (SELECT row_id, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
len AS (SELECT row_id, sum(tf)::BIGINT AS n FROM tf GROUP BY row_id),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM len),
i AS (SELECT item_id, min(text) AS text FROM {items} WHERE item_id IS NOT NULL GROUP BY item_id),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, {found("text")} AS term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
s AS (SELECT q.item_id, tf.row_id, tf.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (row_id), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}
"""
