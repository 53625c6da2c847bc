"""Order-preserving packing: window cuts by dynamic programming.

The documents of one input partition, in table order, form one stream of token ids. It is cut into
windows of at most ``WINDOW`` tokens. A cut may stand at a document's end (free), at a sentence's
end (a small penalty) or, where neither comes for long, at a fixed stride inside a sentence (a
larger one). The cuts minimise padding plus penalties plus a constant per window. A window is
padded to ``WINDOW`` unless its length is a power of two, so

    cost(j) = penalty(j) + min( min over i within reach of cost(i) + WINDOW - (b_j - b_i),
                                min over powers p of cost(i at b_j - p) )

and the first inner minimum runs over a sliding range of ``cost(i) + b_i``: a monotone queue gives
it in constant time per cut. The stream is worked off in blocks; the last windows of a block are
dropped and sought again with the next one, so a task holds one block, whatever its share of rows.

Nothing is shuffled. Sequence ids are the partition's number and a running number; a task that is
run again gives the same ones.

Defined results: a null or empty text is one token, the end id; repeated rows are packed once each;
null ids are kept; an empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole

WINDOW = 1024
END_ID = 0
SENTENCE_PENALTY = 4
SPLIT_PENALTY = 24
WINDOW_COST = 8
#: Where no document or sentence ends for this many tokens, cuts at this stride are allowed.
STRIDE = 32
BLOCK = 1 << 18
REDONE_WINDOWS = 16
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def load_encoder(name: str = "byte_bpe_50k") -> tuple[Callable[[str], list[int]], np.ndarray, np.ndarray]:
    """(encode, ends, starts): ids of a text, and per id whether it can end or follow a sentence.

    Ids are those of the tokenizer file. Texts in Latin-1 without a special token's name take the
    same vocabulary's rank file, which gives the same ids in a quarter of the time.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ordinary = quick.encode_ordinary

    def encode(text: str) -> list[int]:
        try:
            text.encode("latin-1")
            if "<|" not in text:
                return ordinary(text)
        except UnicodeEncodeError:
            pass
        return full.encode(text, add_special_tokens=False).ids

    size = max(full.get_vocab_size(), max(ranks.values()) + 1)
    ends, starts = np.zeros(size, bool), np.zeros(size, bool)
    for piece, i in ranks.items():
        ends[i] = piece.endswith((b".", b"!", b"?", b"\n"))
        starts[i] = piece[:1] in (b" ", b"\n")
    return encode, ends, starts


def candidate_cuts(
    ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Positions a window may end at (0 first, the stream's end last) and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int32)
    inner = np.flatnonzero(ends[ids[:-1]] & starts[ids[1:]]) + 1
    penalty[inner] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    if penalty[n] < 0:
        penalty[n] = SPLIT_PENALTY
    at = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(at) > 2 * STRIDE)
    for i in wide.tolist():
        gap = slice(at[i] + STRIDE, at[i + 1], STRIDE)
        penalty[gap] = SPLIT_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts (without 0) of the cheapest division of [0, at[-1]]."""
    n = len(at)
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(n)
    hits: dict[int, list[int]] = {}
    p = 1
    while p <= window:
        far = at - p
        found = np.flatnonzero(far >= 0)
        prior = index[far[found]]
        keep = prior >= 0
        for j, i in zip(found[keep].tolist(), prior[keep].tolist(), strict=True):
            hits.setdefault(j, []).append(i)
        p *= 2
    where, fee = at.tolist(), penalty.tolist()
    cost, prev = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + position, position, index
    for j in range(1, n):
        b = where[j]
        while queue[0][1] < b - window:
            queue.popleft()
        low, _, i = queue[0]
        c = low + window - b
        for k in hits.get(j, ()):
            if cost[k] < c or (cost[k] == c and k < i):
                c, i = cost[k], k
        c += fee[j] + WINDOW_COST
        cost[j], prev[j] = c, i
        c += b
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, b, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(where[j])
        j = prev[j]
    return cuts[::-1]


class Packer:
    """Packs one stream of documents; ``add`` and ``finish`` give finished pieces."""

    def __init__(self, ends: np.ndarray, starts: np.ndarray, first_sequence: int = 0, block: int = BLOCK):
        self.ends, self.starts, self.block = ends, starts, block
        self.sequence = first_sequence
        self.parts: list[np.ndarray] = []
        self.held = 0
        # documents in the buffer: id, tokens before the buffer's start (first one only), all tokens, end
        self.docs: list[tuple[object, int, int, int]] = []

    def add(self, doc_id: object, ids: list[int]) -> pd.DataFrame | None:
        self.parts.append(np.array([*ids, END_ID], np.uint32))
        self.held += len(ids) + 1
        self.docs.append((doc_id, 0, len(ids) + 1, self.held))
        return self._cut(last=False) if self.held >= self.block else None

    def finish(self) -> pd.DataFrame | None:
        return self._cut(last=True) if self.held else None

    def _cut(self, last: bool) -> pd.DataFrame | None:
        ids = self.parts[0] if len(self.parts) == 1 else np.concatenate(self.parts)
        doc_ends = np.fromiter((d[3] for d in self.docs), np.int64, len(self.docs))
        cuts = best_cuts(*candidate_cuts(ids, doc_ends, self.ends, self.starts))
        if not last:
            cuts = cuts[:-REDONE_WINDOWS]
            if not cuts:
                return None
        stop = cuts[-1]
        windows = np.concatenate([[0], cuts]).astype(np.int64)
        edges = np.union1d(windows, doc_ends[doc_ends < stop])
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, lo, side="right")
        win = np.searchsorted(windows, lo, side="right") - 1
        doc_starts = np.concatenate([[-self.docs[0][1]], doc_ends[:-1]])
        bounds = zip(lo.tolist(), hi.tolist(), strict=True)
        out = pd.DataFrame(
            {
                "doc_id": pd.Series([self.docs[k][0] for k in doc.tolist()], dtype="Int64"),
                "start": lo - doc_starts[doc],
                "length": hi - lo,
                "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in bounds],
                "doc_tokens": [self.docs[k][2] for k in doc.tolist()],
                "sequence_id": self.sequence + win,
                "offset": lo - windows[win],
            }
        )
        self.sequence += len(cuts)
        self.parts, self.held = [ids[stop:]], len(ids) - stop
        left = [d for d in self.docs if d[3] > stop]
        if left:
            name, gone, size, end = left[0]
            left[0] = (name, size - (end - stop), size, end)
        self.docs = [(name, gone, size, end - stop) for name, gone, size, end in left]
        return out


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, ends, starts = load_encoder(tokenizer)
        packer = Packer(ends, starts, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for key, body in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                done = packer.add(None if key is None else int(key), encode(body))
                if done is not None:
                    yield done
        done = packer.finish()
        if done is not None:
            yield done

    # as text, so that a null among the ids does not turn the others into floats
    key = F.col(doc_id).cast("long").cast("string").alias("doc_id")
    return docs.select(key, whole(text).alias("text")).mapInPandas(run, PIECES)
