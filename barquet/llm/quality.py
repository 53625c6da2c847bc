"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A document is a sparse vector: its hashed words (logarithmic counts, scaled to length one), one
indicator per binned structure statistic, and one per binned piece of metadata. The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i (v_if x_i)**2 ],

every pairwise interaction in time linear in the non-zeros, and gives the logistic of it. It is
trained on a bounded sample of labelled documents, drawn by hashes of ids.

Defined results: a null or empty text has only its structure indicators and is scored like any
other; a null in a metadata column has an indicator of its own; labels that are null, or whose ids
are not in the table, teach nothing; of repeated labels of an id the smaller counts; with no usable
label every score is 0.5. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_batches, whole

#: Bound of the labelled sample.
SAMPLE_DOCS = 4096
WORD_BUCKETS = 8192
BINS = 16
RANK = 8
EPOCHS = 6
BATCH = 64
RATE = 0.1
DECAY = 1e-4
SEED = 5
STATS = (
    "letters", "upper", "digits", "spaces", "stops", "symbols", "other", "lines", "word_length",
    "distinct", "top_word", "long_words", "line_length", "repeated_pairs", "echo", "size",
)
# Classes of bytes: 0 lower letter, 1 upper letter, 2 digit, 3 space, 4 sentence mark, 5 symbol, 6 not ASCII, 7 line end
BYTE_CLASS = np.full(256, 5, np.uint8)
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 0, 1, 2
BYTE_CLASS[[9, 11, 12, 13, 32]] = 3
BYTE_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
BYTE_CLASS[128:], BYTE_CLASS[10] = 6, 7
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Multiplier of the rolling word hash (odd, so that it has an inverse) and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and byte lengths of the lower-cased words of a text's bytes."""
    space = np.isin(BYTE_CLASS[raw], (3, 7))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power = np.full(len(raw), BACK, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    forward = np.full(len(raw), STEP, np.uint64)
    forward[0] = 1
    forward = np.cumprod(forward, dtype=np.uint64)
    h = (total[b] - total[a]) * forward[a]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), b - a


def statistics(raw: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of ``STATS``, each in [0, 1]."""
    n = max(1, len(raw))
    c = np.bincount(BYTE_CLASS[raw], minlength=8) / n
    letters = c[0] + c[1] + c[6]
    count = max(1, len(words))
    kinds, times = np.unique(words, return_counts=True) if len(words) else (words, np.zeros(1))
    lines = int((raw == 10).sum()) + 1
    pairs = words[1:] * np.uint64(STEP) + words[:-1]
    return np.array(
        [
            letters, c[1] / max(letters, 1e-9), c[2], c[3], c[4], c[5], c[6],
            min(1.0, lines / count), min(1.0, lengths.mean() / 20 if len(words) else 0.0),
            len(kinds) / count, times.max() / count, float((lengths > 15).mean()) if len(words) else 0.0,
            min(1.0, np.log1p(n / lines) / 10), 1 - len(np.unique(pairs)) / max(1, len(pairs)) if len(pairs) else 0.0,
            float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0,
            min(1.0, np.log1p(len(raw)) / 14),
        ]
    )


def features(text: str, metadata: Sequence[float | None] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's non-zeros, its whole text read."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words, lengths = word_hashes(raw) if len(raw) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = np.bincount((words % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at])
    value = value / max(np.linalg.norm(value), 1e-9)
    stats = np.minimum((statistics(raw, words, lengths) * BINS).astype(np.int64), BINS - 1)
    extra = [BINS if m is None or m != m else min(BINS - 1, int(np.log2(max(0.0, m) + 1))) for m in metadata]
    base = WORD_BUCKETS + BINS * np.arange(len(STATS)) + stats
    more = WORD_BUCKETS + BINS * len(STATS) + (BINS + 1) * np.arange(len(extra)) + np.array(extra, np.int64)
    dense = np.concatenate([base, more]).astype(np.int64)
    return np.concatenate([at, dense]), np.concatenate([value, np.full(len(dense), 0.5)])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of documents whose non-zeros begin at ``starts`` of (at, x)."""
        vx = self.v[at] * x[:, None]
        total = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((total * total).sum(axis=1) - squares)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, seed: int = SEED) -> Machine:
    """Fit by stochastic gradients with per-weight rates (AdaGrad) on the logistic loss."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    gw0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            at = np.concatenate([rows[k][0] for k in pick])
            x = np.concatenate([rows[k][1] for k in pick])
            sizes = np.array([len(rows[k][0]) for k in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            slope = (logistic(m.logits(at, x, starts)) - labels[pick]) / len(pick)
            each = np.repeat(slope, sizes) * x
            total = np.repeat(np.add.reduceat(m.v[at] * x[:, None], starts), sizes, axis=0)
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, each, len(used)) + DECAY * m.w[used]
            part = each[:, None] * (total - m.v[at] * x[:, None])
            dv = np.stack([np.bincount(place, part[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * m.v[used]
            d0 = slope.sum()
            gw0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w0 -= RATE * d0 / np.sqrt(gw0)
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
    return m


def space(metadata: Sequence[str]) -> int:
    return WORD_BUCKETS + BINS * len(STATS) + (BINS + 1) * len(metadata)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    doc_id: str = "doc_id",
    metadata: Sequence[str] = (),
    train_rows: Column | None = None,
    sample_docs: int = SAMPLE_DOCS,
    seed: int = SEED,
) -> Machine:
    """Train on at most ``sample_docs`` labelled documents; ``train_rows`` is a condition on the id.

    Ids are drawn from the narrow label table: of each hash slot the id with the smallest hash. Of rows
    with one id the smallest text counts. The driver receives the sparse features of the drawn documents only.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if train_rows is not None:
        known = known.filter(train_rows)
    mix = F.xxhash64(F.col(doc_id).cast("string"))
    drawn = staged(
        known.groupBy(F.pmod(mix, F.lit(sample_docs)).alias("slot"))
        .agg(F.min(F.struct(F.xxhash64(mix).alias("h"), F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))).alias("m"))
        .select("m.id", "m.y"),
        "drawn",
    )
    names = [f"m{i}" for i in range(len(metadata))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            meta = b[names].to_numpy(float) if names else np.zeros((len(b), 0))
            made = [features(t, m) for t, m in zip(b["text"], meta.tolist(), strict=True)]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "at": [a for a, _ in made], "x": [x for _, x in made]})

    # at most ``sample_docs`` ids, so the broadcast has a fixed bound; rows that repeat an id are one before
    # anything leaves the executors
    one = (
        docs.select(
            F.col(doc_id).alias("id"), whole(text).alias("text"), *[F.col(c).cast("double").alias(n) for c, n in zip(metadata, names, strict=True)]
        )
        .join(F.broadcast(drawn), "id")
        .groupBy("id").agg(F.min(F.struct("text", *names, "y")).alias("one"))
        .select("id", "one.*")
    )
    rows = one.mapInPandas(read, "id long, y double, at array<long>, x array<double>")
    got = sorted(((r["id"], r["y"], r["at"], r["x"]) for r in rows.toLocalIterator()), key=lambda r: r[0])
    pairs = [(np.array(a, np.int64), np.array(x)) for _, _, a, x in got]
    return train(pairs, np.array([float(y >= 0.5) for _, y, _, _ in got]), space(metadata), seed)


def score(machine: Machine, text: str | Column, metadata: Sequence[str] = ()) -> Column:
    """Probability that a document is good."""
    m = Machine(machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32))

    @F.pandas_udf("double")
    def run(texts: pd.Series, *more: pd.Series) -> pd.Series:
        meta = np.stack([c.to_numpy(float) for c in more], axis=1) if more else np.zeros((len(texts), 0))
        out = []
        for t, row in zip(texts, meta.tolist(), strict=True):
            at, x = features(t, row)
            out.append(float(m.logits(at, x, np.array([0]))[0]))
        return pd.Series(logistic(np.array(out, float)))

    return run(whole(text), *[F.col(c).cast("double") for c in metadata])
