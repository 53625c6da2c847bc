"""Repeated passages of at least ``LENGTH`` bytes, by run-length indexes over routed contexts.

Every string of ``LENGTH`` bytes holds an anchor: the ``SEED_BYTES`` bytes in it whose hash is
smallest (leftmost of equals). The windows with one anchor lie side by side, and the stretch they
cover is that anchor's context. Equal windows have equal anchors at equal places, so

* a context that occurs twice consists of repeated windows only, wherever it occurs;
* one that occurs once can repeat a window only in another context of the same anchor.

Contexts of the second kind, with the others of their anchor, are routed by anchor into blocks of
about ``BLOCK_CONTEXTS``. Each block is indexed by a run-compressed Burrows-Wheeler transform with
sampled run ends, and the matching statistics streamed from it say where ``LENGTH`` bytes repeat.
An anchor stays in one block, which so holds ``HOT_CONTEXTS`` and the usual number at most (some
3 MB of text). One with more different contexts would not fit a task: there every window's hash is
counted instead, which is linear and finds the same windows.

Nothing is collected per anchor or per passage: equal contexts are counted with partial aggregates,
and a text that occurs many times is marked once, by its hash. Texts pass a shuffle twice: once to
cut the contexts that need an index, once to remove what was found.

Defined results: a null text is empty; a text shorter than ``LENGTH`` keeps all bytes; repeated rows
repeat their text, so both lose it; null ids are kept. Extra columns are never read. Equality of
anchors, contexts and texts is by 64-bit hashes (texts with their length).
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_batches, whole
from .runindex import repeated_starts

LENGTH = 200
SEED_BYTES = 64
BLOCK_CONTEXTS = 4096
HOT_CONTEXTS = 8192
#: Bytes hashed at a time; longer texts are worked off in overlapping pieces.
PIECE = 1 << 19
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
INDEX_BITS = 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of any stretch of a byte string from one running sum (arithmetic modulo 2**64)."""

    def __init__(self, size: int = PIECE + 2 * LENGTH):
        self.up, self.down = _powers(STEP, size + 1), _powers(BACK, size + 1)
        # one odd number per byte value
        self.code = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[raw] * self.down[: len(raw)], dtype=np.uint64)])

    def stretch(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((sums[b] - sums[a]) * self.up[a])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    n = len(key) - width + 1
    full = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    down = np.minimum.accumulate(full, axis=1).ravel()
    up = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


def contexts(raw: np.ndarray, hasher: Hasher, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """(start, width, anchor hash, context hash) of a text's contexts, whole text."""
    made = []
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        # windows that start in [at, at + PIECE)
        part = raw[at : at + PIECE + length - 1]
        sums = hasher.sums(part)
        n = len(part) - seed + 1
        place = np.arange(n)
        h = hasher.stretch(sums, place, place + seed)
        key = (h >> np.uint64(INDEX_BITS) << np.uint64(INDEX_BITS)) | place.astype(np.uint64)
        anchor = (sliding_least(key, length - seed + 1) & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
        turn = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], turn])
        stop = np.concatenate([turn, [len(anchor)]]) - 1 + length
        a = anchor[first]
        shape = mixed(((a - first) << 32 | (stop - first)).astype(np.uint64))
        made.append((first + at, stop - first, h[a], hasher.stretch(sums, first, stop) ^ shape))
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*made, strict=True))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = whole(text)
    return docs.select(F.xxhash64(body).alias("tk"), F.octet_length(body).alias("n"), body.alias("text"))


def _anchors(docs: DataFrame, text: str, length: int, seed: int) -> DataFrame:
    """tk, n, start, width, anchor, ctx: the contexts of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            made = [contexts(np.frombuffer(t.encode(), np.uint8), hasher, length, seed) for t in batch["text"]]
            sizes = [len(m[0]) for m in made]
            cols = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0)] * 4
            yield pd.DataFrame(
                {
                    "tk": np.repeat(batch["tk"].to_numpy(), sizes), "n": np.repeat(batch["n"].to_numpy(), sizes),
                    "start": cols[0].astype(np.int32), "width": cols[1].astype(np.int32),
                    "anchor": cols[2].view(np.int64), "ctx": cols[3].view(np.int64),
                }
            )

    long_enough = _keyed(docs, text).filter(F.col("n") >= length)
    return long_enough.mapInPandas(run, "tk long, n int, start int, width int, anchor long, ctx long")


def release(df: DataFrame) -> None:
    """Let Spark drop shuffles that nothing refers to any more, as its cleaner does from time to time."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _cut_contexts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """anchor, ctx, single, hot, body: the bytes of the contexts to be indexed, each at most once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for body, marks in zip(batch["text"], batch["marks"], strict=True):
                raw = body.encode()
                for m in marks:
                    if m["ctx"] not in seen:
                        seen.add(m["ctx"])
                        rows.append((m["anchor"], m["ctx"], m["single"], m["hot"], raw[m["start"] : m["start"] + m["width"]]))
            yield pd.DataFrame(rows, columns=["anchor", "ctx", "single", "hot", "body"])

    met = _keyed(docs, text).join(wanted.hint("shuffle_hash"), ["tk", "n"]).select("text", "marks")
    return met.mapInPandas(run, "anchor long, ctx long, single boolean, hot boolean, body binary")


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, width) of the maximal stretches covered by windows at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    a = starts[np.concatenate([[0], cut])]
    b = starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length
    return list(zip(a.tolist(), (b - a).tolist(), strict=True))


FOUND = "ctx long, spans array<struct<start:int,width:int>>"


def _indexed(cut: DataFrame, blocks: Column, length: int) -> DataFrame:
    """ctx, spans: what repeats inside the contexts that occur once, from one index per block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("ctx").sort_values(["anchor", "ctx"])
        starts = repeated_starts(group["body"].tolist(), length)
        rows = [
            (c, [{"start": a, "width": w} for a, w in _runs(s, length)])
            for c, one, s in zip(group["ctx"], group["single"], starts, strict=True)
            if one and len(s)
        ]
        return pd.DataFrame(rows, columns=["ctx", "spans"])

    routed = cut.filter("not hot").withColumn("block", F.pmod(F.xxhash64("anchor"), blocks))
    return routed.groupBy("block").applyInPandas(run, FOUND)


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """ctx, spans for contexts of crowded anchors: windows whose hash comes from two contexts."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for c, body in zip(batch["ctx"], batch["body"], strict=True):
                raw = np.frombuffer(body, np.uint8)
                at = np.arange(len(raw) - length + 1)
                h = hasher.stretch(hasher.sums(raw), at, at + length).view(np.int64)
                out.append(pd.DataFrame({"ctx": c, "at": at.astype(np.int32), "h": h}))
            if out:
                yield pd.concat(out)

    rows = cut.filter("hot").select("ctx", "body").dropDuplicates(["ctx"]).mapInPandas(windows, "ctx long, at int, h long")
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    spans = F.transform(F.array_sort(F.collect_list("at")), lambda s: F.struct(s.alias("start"), F.lit(length).alias("width")))
    return rows.join(twice, "h").groupBy("ctx").agg(spans.alias("spans"))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """tk, n, spans: per text (by hash and bytes) the stretches that repeat, unmerged."""
    bounded_batches(docs.sparkSession)
    anchors = _anchors(docs, text, length, seed)
    # read twice below; without the table the hashing of all texts would run twice as well
    kinds = staged(anchors.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("k")), "kinds")
    release(docs)
    crowd = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("k") == 1).cast("int")).alias("singles"))
    crowd = crowd.filter("kinds > 1 and singles > 0").withColumn("hot", F.col("kinds") > HOT_CONTEXTS).select("anchor", "hot")
    flags = staged(
        kinds.join(crowd, "anchor", "left")
        .filter("k > 1 or hot is not null")
        .select("anchor", "ctx", (F.col("k") == 1).alias("single"), "hot"),
        "flags",
    )
    release(docs)
    mark = F.struct("start", "width", "anchor", "ctx", "single", "hot")
    marks = staged(
        anchors.join(flags, ["anchor", "ctx"]).groupBy("tk", "n").agg(F.collect_set(mark).alias("marks")), "marks"
    )
    release(docs)
    wanted = marks.select("tk", "n", F.filter("marks", lambda m: m["hot"].isNotNull()).alias("marks")).filter(F.size("marks") > 0)
    cut = staged(_cut_contexts(docs, text, wanted), "contexts")
    release(docs)
    # a scalar of the staged table: how many blocks the contexts fill
    blocks = cut.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CONTEXTS), F.lit(1))).scalar()
    found = staged(_indexed(cut, blocks, length).unionByName(_counted(cut, length)), "found")
    each = marks.select("tk", "n", F.explode("marks").alias("m"))
    plain = each.filter("not m.single").select("tk", "n", F.col("m.start").alias("start"), F.col("m.width").alias("width"))
    edge = (
        each.filter("m.single")
        .select("tk", "n", F.col("m.start").alias("base"), F.col("m.ctx").alias("ctx"))
        .join(found, "ctx")
        .select("tk", "n", "base", F.explode("spans").alias("s"))
        .select("tk", "n", (F.col("base") + F.col("s.start")).alias("start"), F.col("s.width").alias("width"))
    )
    spans = plain.unionByName(edge).groupBy("tk", "n").agg(F.collect_set(F.struct("start", "width")).alias("spans"))
    return staged(spans, "spans")


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged (start, end), touching ones joined."""
    out: list[list[int]] = []
    for a, w in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + w)
        else:
            out.append([a, a + w])
    return [(a, b) for a, b in out]


def without_repeats(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in removed:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, removed (spans), kept_sha256."""
    import hashlib

    spans = repeated_spans(docs, text, length, seed)
    release(docs)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept_sha256 string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for body, found in zip(texts, spans, strict=True):
            raw = body.encode()
            gone = covered([(s["start"], s["width"]) for s in found]) if found is not None else []
            kept = without_repeats(raw, gone)
            pieces = [{"start": a, "end": b} for a, b in gone]
            rows.append((len(raw), len(raw) - len(kept), len(gone), pieces, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])

    body = whole(text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tk"), F.octet_length(body).alias("n"))
    met = keyed.join(spans.hint("shuffle_hash"), ["tk", "n"], "left")
    return met.select("doc_id", cleaned("text", "spans").alias("r")).select("doc_id", "r.*")
