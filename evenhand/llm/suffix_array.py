"""Suffix arrays over the words of a slab of documents, in numpy."""

from __future__ import annotations

import numpy as np


def stable_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ``keys`` (unsigned, below 2**bits) in ascending order, ties by position.
    Where key and position fit 64 bits they are sorted as one number."""
    n = len(keys)
    low = max(1, int(n - 1).bit_length()) if n else 1
    if bits + low > 64:
        return np.argsort(keys, kind="stable")
    both = (keys.astype(np.uint64) << np.uint64(low)) | np.arange(n, dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << low) - 1)).astype(np.int64)


def dense_ids(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and for each position the place of its hash among them."""
    n = len(hashes)
    low = max(1, int(n - 1).bit_length()) if n else 1
    order = stable_order(hashes >> np.uint64(low), 64 - low)
    s = hashes[order]
    if np.any(s[1:] < s[:-1]):  # different hashes with the same leading bits
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    ids = np.empty(n, np.int64)
    ids[order] = np.cumsum(new) - 1
    return s[new], ids


class SuffixArray:
    """Suffixes of documents in the order of their words, up to ``depth`` words.

    ``ids`` holds the words of all documents as numbers from 1, with a 0 after each document;
    ``order`` the positions of all words, sorted by what begins there. Ranks are refined by
    doubling: once suffixes are sorted by k words, the rank of the suffix k words on sorts
    them by 2k. Only suffixes that are still tied are sorted again. ``prefixes`` keeps the
    ranks of all rounds, for ``common``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, depth: int, prefixes: bool = False) -> None:
        self.vocabulary, own = dense_ids(hashes)
        n, docs = len(hashes), len(counts)
        self.starts = np.concatenate(([0], np.cumsum(counts + 1)))[:docs]
        self.ids = np.zeros(n + docs + 1, np.int64)
        self.place = np.arange(n) + np.repeat(np.arange(docs), counts)
        self.ids[self.place] = own + 1
        per_id = np.bincount(own, minlength=len(self.vocabulary))
        self.bounds = np.concatenate(([0], np.cumsum(per_id)))
        order = self.place[stable_order(own, max(1, int(len(self.vocabulary)).bit_length()))] if n else self.place
        rank = np.zeros(n + docs + 1, np.int64)
        rank[self.place] = self.bounds[own] + 1
        bits = int(n + 1).bit_length()
        slots = np.flatnonzero(np.repeat(per_id > 1, per_id))
        width = 1
        self.levels = [(1, rank.astype(np.int32))] if prefixes else []
        while width < depth and len(slots):
            at = order[slots]
            key = (rank[at] << bits) | rank[np.minimum(at + width, n + docs)]
            by = stable_order(key, 2 * bits)
            at, key = at[by], key[by]
            order[slots] = at
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            rank[at] = slots[new][group] + 1
            sizes = np.bincount(group)
            slots = slots[np.repeat(sizes > 1, sizes)]
            width *= 2
            if prefixes:
                self.levels.append((width, rank.astype(np.int32)))
        self.order, self.depth = order, width if len(slots) else depth

    def common(self) -> np.ndarray:
        """The number of words that each suffix shares with the one before it in order."""
        if len(self.order) < 2:
            return np.zeros(len(self.order), np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(len(self.order), np.int64)
        left, last = np.flatnonzero(self.ids[a] == self.ids[b]), len(self.ids) - 1
        a, b = a[left], b[left]
        shared = np.zeros(len(left), np.int64)
        for width, rank in reversed(self.levels):
            same = (rank[a] == rank[b]) & (self.ids[a] > 0) & (self.ids[b] > 0)
            a = np.minimum(a + same * width, last)
            b = np.minimum(b + same * width, last)
            shared += same * width
        out[left + 1] = shared
        return out

    def search(self, hashes: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> tuple:
        """Binary search of sequences of words: for position j, those from j to ``ends[j]``.
        Gives the range of ``order`` at the depth ``marks[j]`` (empty where that is not
        reached), the longest depth reached and one place of such a longest match."""
        at = np.searchsorted(self.vocabulary, hashes)
        found = at < len(self.vocabulary)
        found[found] = self.vocabulary[at[found]] == hashes[found]
        ids = np.where(found, at + 1, -1)
        n = len(hashes)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[found], high[found] = self.bounds[at[found]], self.bounds[at[found] + 1]
        longest, where = np.where(found, 1, 0), np.zeros(n, np.int64)
        where[found] = self.order[low[found]]
        from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
        depth, live = 1, np.flatnonzero(found)
        while len(live):
            done = live[marks[live] == depth]
            from_[done], to[done] = low[done], high[done]
            live = live[live + depth < ends[live]]
            want = ids[live + depth]
            live, want = live[want > 0], want[want > 0]
            a, b = low[live], high[live]
            first = self._bound(a, b, want, depth)
            last = self._bound(first, b, want + 1, depth)
            low[live], high[live] = first, last
            live = live[first < last]
            depth += 1
            longest[live], where[live] = depth, self.order[low[live]]
        return from_, to, longest, where

    def _bound(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, depth: int) -> np.ndarray:
        """The first place in [low, high) whose word at ``depth`` is not below ``want``."""
        low, high = low.copy(), high.copy()
        left = np.flatnonzero(low < high)
        end = len(self.ids) - 1
        while len(left):
            middle = (low[left] + high[left]) >> 1
            less = self.ids[np.minimum(self.order[middle] + depth, end)] < want[left]
            low[left[less]] = middle[less] + 1
            high[left[~less]] = middle[~less]
            left = left[low[left] < high[left]]
        return low
