"""A run-length index of one block of text, in numpy.

The block's suffixes are sorted once; what is kept of the Burrows-Wheeler transform are its runs,
and text positions sampled at both ends of every run. The longest match of a suffix with its
neighbour in suffix order is computed only at those samples. Inside a run it follows: if the
neighbour is preceded by the same byte, the match of the next position to the right is one shorter.
So one stream over the text from left to right gives every position's matching statistic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: End marks after each string: as many as a packed word has bytes.
WORD = 8


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, lengths): strings one after the other, each followed by end marks (0).

    Byte 0 inside a string becomes 255, which UTF-8 never uses.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(lengths + WORD) - lengths - WORD
    text = np.zeros(int((lengths + WORD).sum()) + WORD, np.uint8)
    body = np.frombuffer(b"".join(strings), np.uint8)
    at = np.arange(len(body)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    text[at] = np.where(body == 0, 255, body)
    return text, starts, lengths


def packed(text: np.ndarray) -> np.ndarray:
    """At every position the next eight bytes as one number, first byte highest."""
    word = np.zeros(len(text), np.uint64)
    for k in range(WORD):
        part = np.zeros(len(text), np.uint64)
        part[: len(text) - k] = text[k:]
        word |= part << np.uint64(8 * (WORD - 1 - k))
    return word


def suffix_order(text: np.ndarray, word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Content positions by the string from there to its end mark, ties by position.

    ``left`` is how many content bytes follow from a position (0 at marks). Prefix doubling: only
    groups that are still tied are sorted again.
    """
    where = np.flatnonzero(left)
    order = where[np.argsort(word[where])]
    n = len(order)
    rank = np.zeros(len(text) + 1, np.int64)
    fresh = np.concatenate([[True], word[order[1:]] != word[order[:-1]]]) if n else np.zeros(0, bool)
    slots = np.arange(n)
    h = WORD
    while True:
        first = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = first + 1
        alone = fresh & np.concatenate([fresh[1:], [True]]) if len(fresh) else fresh
        slots = slots[~alone]
        if not len(slots):
            return order
        tied = order[slots]
        ahead = left[tied] > h
        if not ahead.any():
            break
        second = np.where(ahead, rank[np.minimum(tied + h, len(text))], 0)
        key = (rank[tied].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        turn = np.argsort(key)
        order[slots] = tied[turn]
        key = key[turn]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        h *= 2
    # equal to their ends: by position
    tied = order[slots]
    order[slots] = tied[np.lexsort((tied, rank[tied]))]
    return order


def match_lengths(word: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bytes from positions ``a`` and ``b``, up to the nearer end mark."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    at = 0
    while len(live):
        differ = word[a[live] + at] ^ word[b[live] + at]
        same = differ == 0
        ended = live[~same]
        if len(ended):
            d = differ[~same]
            # equal leading bytes of the word, from the place of its highest set bit
            high = np.zeros(len(d), np.int64)
            for s in (32, 16, 8):
                big = d >= np.uint64(1) << np.uint64(s)
                high += np.where(big, s, 0)
                d = np.where(big, d >> np.uint64(s), d)
            out[ended] = at + WORD - 1 - high // 8
        live = live[same]
        at += WORD
        over = most[live] <= at
        out[live[over]] = at
        live = live[~over]
    return np.minimum(out, most)


@dataclass
class RunIndex:
    """Runs of the transform (byte, length) with sampled text positions at both ends."""

    heads: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: the suffix before a run's first and the one after its last, -1 where there is none
    before: np.ndarray
    after: np.ndarray

    @classmethod
    def build(cls, text: np.ndarray, word: np.ndarray, left: np.ndarray) -> RunIndex:
        order = suffix_order(text, word, left)
        prior = np.where(order > 0, text[order - 1], 0)
        # a string's first position has no byte before it in its string: a run of its own
        new = np.concatenate([[True], (prior[1:] != prior[:-1]) | (prior[1:] == 0)]) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(order)]]) - 1 if len(begin) else begin
        none = np.int64(-1)
        return cls(
            prior[begin], end - begin + 1, order[begin], order[end],
            np.where(begin > 0, order[begin - 1], none) if len(begin) else begin,
            np.where(end < len(order) - 1, order[np.minimum(end + 1, len(order) - 1)], none) if len(begin) else begin,
        )

    def statistics(self, word: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For every position the longest match with a suffix that starts elsewhere in the block."""
        best = np.zeros(len(left), np.int64)
        for sample, beside in ((self.first, self.before), (self.last, self.after)):
            known = np.full(len(left), -1, np.int64)
            real = beside >= 0
            known[sample] = 0
            known[sample[real]] = match_lengths(word, left, sample[real], beside[real])
            at = np.arange(len(left))
            since = np.maximum.accumulate(np.where(known >= 0, at, 0))
            streamed = known[since] - (at - since)
            best = np.maximum(best, np.where(left > 0, streamed, 0))
        return best


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string the positions at which ``length`` bytes start that also start elsewhere."""
    if not strings:
        return []
    text, starts, lengths = joined(strings)
    left = np.zeros(len(text), np.int64)
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    left[at] = np.repeat(starts + lengths, lengths) - at
    word = packed(text)
    hit = np.flatnonzero(RunIndex.build(text, word, left).statistics(word, left) >= length)
    owner = np.searchsorted(starts, hit, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [hit[cut[i] : cut[i + 1]] - starts[i] for i in range(len(strings))]
