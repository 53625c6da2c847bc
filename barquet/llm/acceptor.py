"""Minimised acceptors of word lists, and their composition with a one-edit transducer, as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols are code points; an arc is keyed by its state and symbol in one number.
SYMBOLS = 1 << 21


def letters(words: list[str]) -> np.ndarray:
    """Code points of the words, one row each, padded with 0."""
    made = np.array(words, dtype=np.str_)
    return made.view(np.uint32).reshape(len(words), -1).astype(np.int64)


@dataclass(frozen=True)
class Acceptor:
    """A minimal deterministic acceptor. Arcs are sorted by state and symbol.

    ``before`` of an arc is the number of accepted words that its state reaches ahead of it, so the
    sum along a path, plus one for each final state left behind, is the word's place in the sorted list.
    """

    start: int
    final: np.ndarray
    key: np.ndarray
    target: np.ndarray
    before: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def symbol(self, arcs: np.ndarray) -> np.ndarray:
        return self.key[arcs] % SYMBOLS


def _levels(word: np.ndarray) -> list[np.ndarray]:
    """Per depth the number (within the depth) of the trie node that each sorted word's prefix is."""
    out = [np.zeros(len(word), np.int64)]
    new = np.zeros(len(word), bool)
    for at in range(word.shape[1]):
        new[1:] |= word[1:, at] != word[:-1, at]
        out.append(np.cumsum(new))
    return out


def build(word: np.ndarray) -> Acceptor:
    """The minimal acceptor of sorted, distinct, padded words.

    Trie nodes of one height (length of the longest way on) are merged where finality and arcs
    agree, lowest height first, so that all targets are classes already.
    """
    length = (word > 0).sum(axis=1)
    depth_node, base = [], 0
    for at, number in enumerate(_levels(word)):
        here = np.where(length >= at, number, -1)
        _, dense = np.unique(here, return_inverse=True)
        dense = dense - (1 if (here < 0).any() else 0)
        depth_node.append(np.where(here >= 0, dense + base, -1))
        base += int(dense.max()) + 1
    nodes = base
    final = np.zeros(nodes, np.int64)
    final[np.stack(depth_node)[length, np.arange(len(word))]] = 1
    parent, symbol, child = [], [], []
    height = np.zeros(nodes, np.int64)
    for at in range(word.shape[1]):
        rows = np.flatnonzero(length > at)
        below, index = np.unique(depth_node[at + 1][rows], return_index=True)
        parent.append(depth_node[at][rows[index]])
        symbol.append(word[rows[index], at])
        child.append(below)
    for at in reversed(range(word.shape[1])):
        np.maximum.at(height, parent[at], height[child[at]] + 1)
    parent, symbol, child = np.concatenate(parent), np.concatenate(symbol), np.concatenate(child)
    order = np.lexsort((symbol, parent))
    parent, symbol, child = parent[order], symbol[order], child[order]
    first = np.searchsorted(parent, np.arange(nodes), "left")
    degree = np.searchsorted(parent, np.arange(nodes), "right") - first
    _, code = np.unique(symbol, return_inverse=True)
    state = np.full(nodes, -1)
    states = 0
    speaker = []  # one trie node of each state
    by_height = np.argsort(height, kind="stable")
    cuts = np.searchsorted(height[by_height], np.arange(height.max() + 2))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        same = by_height[low:high]
        mark = final[same]
        for j in range(int(degree[same].max())):
            more = np.flatnonzero(degree[same] > j)
            arc = first[same[more]] + j
            _, step = np.unique(code[arc] * nodes + state[child[arc]], return_inverse=True)
            _, number = np.unique(mark[more] * len(step) + step, return_inverse=True)
            mark[more] = number + int(mark.max()) + 1
        _, one, number = np.unique(mark, return_index=True, return_inverse=True)
        state[same] = number + states
        speaker.append(same[one])
        states += len(one)
    speaker = np.concatenate(speaker)
    arcs = np.concatenate([np.arange(first[s], first[s] + degree[s]) for s in speaker]) if len(child) else np.zeros(0, np.int64)
    source = np.repeat(np.arange(states), degree[speaker])
    target = state[child[arcs]]
    bounds = np.searchsorted(source, np.arange(states + 1))
    words_below = np.bincount(np.concatenate([n[n >= 0] for n in depth_node]), minlength=nodes)
    accepts = words_below[speaker]
    running = np.cumsum(accepts[target]) - accepts[target]
    before = running - running[bounds[source]] if len(source) else running
    return Acceptor(
        start=int(state[depth_node[0][0]]),
        final=final[speaker].astype(bool),
        key=source * SYMBOLS + symbol[arcs],
        target=target,
        before=before,
        first=bounds[:-1],
        last=bounds[1:],
    )


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers from ``first`` up to ``last``: (row, number)."""
    size = last - first
    row = np.repeat(np.arange(len(first)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[row]


def one_edit_pairs(a: Acceptor, exact: int, same_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs that acceptor, one-edit transducer and acceptor accept; each pair once.

    The first ``exact`` symbols are read without an edit. Words of a replacement have ``same_length``;
    with an insertion the word of ``i`` is the longer one. The edit stands where the two first differ.
    """
    found_i, found_j = [], []
    # before the edit both copies are in one state: one entry per prefix
    state, place = np.array([a.start]), np.array([0])
    none = np.zeros(0, np.int64)
    p, q, i, j, banned, level = none, none, none, none, none, none.astype(bool)
    depth = 0
    while len(state) or len(p):
        done = a.final[p] & a.final[q]
        done &= ~level | (depth == same_length)
        found_i.append(i[done])
        found_j.append(j[done])
        # after the edit both copies read the same symbol
        row, arc = _spread(a.first[p], a.last[p])
        symbol = a.symbol(arc)
        want = q[row] * SYMBOLS + symbol
        other = np.minimum(np.searchsorted(a.key, want), max(len(a.key) - 1, 0))
        on = np.flatnonzero(a.key[other] == want) if len(want) else none
        on = on[symbol[on] != banned[row[on]]]
        row, arc, other = row[on], arc[on], other[on]
        next_i = i[row] + a.final[p[row]] + a.before[arc]
        next_j = j[row] + a.final[q[row]] + a.before[other]
        parts = [(a.target[arc], a.target[other], next_i, next_j, np.full(len(row), -1), level[row])]
        row, arc = _spread(a.first[state], a.last[state])
        behind = place[row] + a.final[state[row]]
        inner = behind + a.before[arc]
        if depth >= exact:
            # insertion: one copy reads a symbol; the other stays, and must not read the same one next
            parts.append((a.target[arc], state[row], inner, place[row], a.symbol(arc), np.zeros(len(row), bool)))
        if exact <= depth < same_length:
            # replacement: two arcs of one state, the smaller symbol first
            one, two = _spread(arc + 1, a.last[state[row]])
            mark = np.full(len(one), -1)
            parts.append((a.target[arc[one]], a.target[two], inner[one], behind[one] + a.before[two], mark, mark < 0))
        state, place = a.target[arc], inner
        p, q, i, j, banned, level = (np.concatenate(x) for x in zip(*parts, strict=True))
        depth += 1
    return np.concatenate(found_i), np.concatenate(found_j)
