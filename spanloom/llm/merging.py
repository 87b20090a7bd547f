"""Byte-pair merging of many sequences at once, on ragged numpy arrays.

In every round each sequence merges its lowest-rank pair at all its places, from the left where
places overlap. Merging one pair at a time gives the same, unless a merge makes a pair of lower
rank than its own, which would have gone before places still to come. That shows in the next
round as a lower level, or at once where the next place begins with that pair's right symbol;
such a sequence is merged again, one pair at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

_NO_RANK = np.int64(1 << 40)


class Pairs:
    """Mergeable pairs of symbols, their ranks, and the symbols that they make."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], symbols: int):
        """pairs: (left, right, rank, made); symbols: how many there are."""
        table = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.width = np.int64(symbols)
        self.keys, self.ranks, self.made = table[:, 0] * self.width + table[:, 1], table[:, 2].copy(), table[:, 3].copy()

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made) of neighbours; _NO_RANK where they don't merge."""
        if not self.keys.size:
            return np.full(left.size, _NO_RANK), np.zeros(left.size, np.int64)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK), self.made[at]


def one_by_one(pairs: Pairs, symbols: np.ndarray) -> np.ndarray:
    """Merge the lowest rank first, the leftmost of equals, with a heap over a linked list."""
    ids = symbols.tolist()
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    ranks, made = (x.tolist() for x in pairs.find(symbols[:-1], symbols[1:]))
    heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r < _NO_RANK]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ids[i] != left or j >= len(ids) or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else len(ids)
            if y < len(ids):
                (r,), (m,) = pairs.find(np.array([ids[x]]), np.array([ids[y]]))
                if r < _NO_RANK:
                    heapq.heappush(heap, (int(r), x, ids[x], ids[y], int(m)))
    return np.array([s for s, a in zip(ids, alive, strict=True) if a], np.int64)


def merge_all(pairs: Pairs, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What survives of sequences that lie one after another, and their new lengths."""
    n, start, symbols = lengths.size, symbols, symbols.copy()
    seq = np.repeat(np.arange(n), lengths)
    ranks, made = np.full(symbols.size, _NO_RANK), np.zeros(symbols.size, np.int64)  # of each symbol with its right neighbour

    def refresh(at: np.ndarray) -> None:
        at = at[(at >= 0) & (at < symbols.size)]
        ranks[at] = _NO_RANK
        at = at[at + 1 < symbols.size]
        at = at[seq[at] == seq[at + 1]]
        ranks[at], made[at] = pairs.find(symbols[at], symbols[at + 1])

    refresh(np.arange(symbols.size))
    level, late = np.full(n, -1, np.int64), np.zeros(n, bool)
    done_seq, done = [], []
    while symbols.size:
        first = np.flatnonzero(np.concatenate([[True], seq[:-1] != seq[1:]]))
        sizes = np.diff(np.append(first, symbols.size))
        least, own = np.minimum.reduceat(ranks, first), seq[first]
        late[own] |= least < level[own]
        level[own] = least
        live = (least < _NO_RANK) & ~late[own]
        if not live.all():  # what has no pair left is done
            keep = np.repeat(live, sizes)
            done_seq.append(seq[~keep])
            done.append(symbols[~keep])
            symbols, seq, ranks, made, least, sizes = symbols[keep], seq[keep], ranks[keep], made[keep], least[live], sizes[live]
            if not symbols.size:
                break
        at = np.flatnonzero(ranks == np.repeat(least, sizes))
        # of overlapping places every other one counts, from the left
        if (np.diff(at) == 1).any():
            run = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(run, at, -1))
            at = at[(at - begin) % 2 == 0]
        beside = at[:-1][(np.diff(at) == 2) & (seq[at[:-1]] == seq[at[1:]])]
        early, _ = pairs.find(made[beside], symbols[beside + 2])
        late[seq[beside[early <= ranks[beside]]]] = True
        symbols[at] = made[at]
        stay = np.ones(symbols.size, bool)
        stay[at + 1] = False
        symbols, seq, ranks, made = symbols[stay], seq[stay], ranks[stay], made[stay]
        at = at - np.arange(at.size)
        refresh(np.concatenate([at - 1, at]))
    if not done:
        return np.zeros(0, np.int64), lengths.copy()
    owner, found = np.concatenate(done_seq), np.concatenate(done)
    order = np.argsort(owner, kind="stable")
    owner, found = owner[order], found[order]
    if late.any():
        ends = np.cumsum(lengths)
        pieces = np.split(found, np.cumsum(np.bincount(owner, minlength=n))[:-1])
        for i in np.flatnonzero(late):
            pieces[i] = one_by_one(pairs, start[ends[i] - lengths[i] : ends[i]])
        return np.concatenate(pieces), np.array([p.size for p in pieces])
    return found, np.bincount(owner, minlength=n)
