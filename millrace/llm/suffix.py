"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as larger or smaller than their right neighbour; leftmost-smaller substrings are
sorted by induction, named by comparing neighbours, and their reduced string is sorted recursively; the order of
all suffixes is then induced from it. Over few symbols induction runs bucket by bucket: a wave takes all suffixes that
are known in a bucket and places the suffixes before them, so each step is an array operation. Over many symbols, where
waves would hold a suffix or two, the same induction runs suffix by suffix.
"""

from __future__ import annotations

import numpy as np

from .textops import U64

#: Up to this many symbols induction runs in waves. Both forms give the same order.
WAVE_SYMBOLS = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if len(differs):
        grows = s[differs + 1] > s[differs]
        runs = np.diff(np.concatenate([[-1], differs]))
        smaller[: differs[-1] + 1] = np.repeat(grows, runs)
    return smaller


def _before(smaller: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, what its induction asks for: the suffix before it, if that is larger, or if it is smaller; else -1."""
    before = np.arange(-1, len(smaller) - 1)
    kind = np.concatenate([[False], smaller[:-1]])
    return np.where(kind, -1, before), np.where(kind, before, -1)


class _Waves:
    """Induction by buckets. A wave of a few suffixes is placed one by one: an array operation has a price of its own."""

    FEW = 16

    def __init__(self, s: np.ndarray, smaller: np.ndarray):
        counts = np.bincount(s)
        self.larger, self.smaller = _before(smaller)
        self.s = s.astype(np.uint16) if len(counts) <= 1 << 16 else s  # short numbers are sorted by radix
        self.used = np.flatnonzero(counts).tolist()
        self.head = np.concatenate([[0], np.cumsum(counts)])
        self.large = np.bincount(s[~smaller], minlength=len(counts)).tolist()
        self.sa = np.empty(len(s), np.int64)
        self.count = np.arange(len(s))

    def _place(self, cursor: np.ndarray, q: np.ndarray, step: int) -> None:
        """Put q, in order, at the cursors of their first symbols, moving those by step; -1 stands for none."""
        s, sa = self.s, self.sa
        if len(q) <= self.FEW:
            for x in q.tolist():
                if x >= 0:
                    c = s[x]
                    sa[cursor[c]] = x
                    cursor[c] += step
            return
        q = q[q >= 0]
        c = s[q]
        order = c.argsort(kind="stable")
        size = np.bincount(c, minlength=len(cursor))
        begin = size.cumsum() - size
        sa[(cursor - step * begin)[c[order]] + step * self.count[: len(q)]] = q[order]
        cursor += step * size

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """lms: positions of leftmost-smaller suffixes in the order they are known to have."""
        sa, larger, smaller = self.sa, self.larger, self.smaller
        first = self.s[lms]
        asked = larger[lms[first.argsort(kind="stable")]]
        cut = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=len(self.head) - 1))]).tolist()
        edge = self.head.tolist()
        heads = self.head[:-1].copy()
        for c in self.used:
            done, top = edge[c], int(heads[c])
            while top > done:
                self._place(heads, larger[sa[done:top]], 1)
                done, top = top, int(heads[c])
            if cut[c + 1] > cut[c]:
                self._place(heads, asked[cut[c] : cut[c + 1]], 1)
        tails = self.head[1:] - 1
        for c in reversed(self.used):
            done, low = edge[c + 1] - 1, int(tails[c])
            while low < done:
                self._place(tails, smaller[sa[low + 1 : done + 1][::-1]], -1)
                done, low = low, int(tails[c])
            if self.large[c]:
                self._place(tails, smaller[sa[edge[c] : edge[c] + self.large[c]][::-1]], -1)
        sa[0] = len(sa) - 1
        return sa


class _Steps:
    """The same induction, suffix by suffix."""

    def __init__(self, s: np.ndarray, smaller: np.ndarray):
        self.head = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.larger, self.smaller = ([*x.tolist(), -1] for x in _before(smaller))  # the last for empty slots
        self.s, self.n = s.tolist(), len(s)

    def induce(self, lms: np.ndarray) -> np.ndarray:
        s, larger, smaller, n = self.s, self.larger, self.smaller, self.n
        sa = [n] * n
        tails = self.head[1:].tolist()
        for p in reversed(lms.tolist()):
            c = s[p]
            tails[c] = t = tails[c] - 1
            sa[t] = p
        heads = self.head[:-1].tolist()
        for p in sa:  # what is placed lies ahead, so it is met in turn
            q = larger[p]
            if q >= 0:
                c = s[q]
                h = heads[c]
                sa[h] = q
                heads[c] = h + 1
        tails = self.head[1:].tolist()
        for p in reversed(sa):
            q = smaller[p]
            if q >= 0:
                c = s[q]
                tails[c] = t = tails[c] - 1
                sa[t] = q
        return np.array(sa, np.int64)


def _names(s: np.ndarray, found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of sorted leftmost-smaller substrings (start, size): equal substrings, which are neighbours, get equal ranks."""
    fresh = np.ones(len(found), bool)
    pair, k = np.flatnonzero(size[1:] == size[:-1]) + 1, 0
    while len(pair):
        pair = pair[s[found[pair] + k] == s[found[pair - 1] + k]]
        k += 1
        done = size[pair] == k
        fresh[pair[done]] = False
        pair = pair[~done]
    return np.cumsum(fresh) - 1


def _sort(s: np.ndarray) -> np.ndarray:
    """Suffix array of s, whose last symbol is its unique smallest, 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    buckets = (_Waves if s.max() < WAVE_SYMBOLS else _Steps)(s, smaller)
    if len(lms) == 1:
        return buckets.induce(lms).copy()
    sa = buckets.induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = sa[is_lms[sa]]
    # A substring reaches from one leftmost-smaller symbol up to and with the next.
    end = np.empty(n, np.int64)
    end[lms] = np.append(lms[1:] + 1, n)
    name = _names(s, found, end[found] - found)
    reduced = np.empty(n, np.int64)
    reduced[found] = name
    reduced = reduced[lms]
    if name[-1] + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = _sort(reduced)
    return buckets.induce(lms[order]).copy()


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of a byte array (without a sentinel)."""
    if not len(data):
        return np.zeros(0, np.int64)
    return _sort(np.append(data.astype(np.int64) + 1, 0))[1:]


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix before it in the array (-1: none), and the length of their common prefix.

    A common prefix is found by comparing bytes only where the symbols before the two suffixes differ; everywhere else it
    is one less than at the position before. The sum of the lengths compared is at most 2 n log n.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    every = np.arange(n)
    back = np.maximum(phi, 1) - 1
    follows = (every > 0) & (phi > 0) & (data[np.maximum(every, 1) - 1] == data[back]) if n else np.zeros(0, bool)
    at = np.flatnonzero(~follows & (phi >= 0))
    other = phi[at]
    size, most = np.zeros(len(at), np.int64), n - np.maximum(at, other)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, U64)
    for j in range(8):
        word |= padded[j : j + n].astype(U64) << U64(8 * j)
    live = np.arange(len(at))
    while len(live):
        differ = word[at[live] + size[live]] ^ word[other[live] + size[live]]
        equal = differ == 0
        first = np.bitwise_count((differ & (~differ + U64(1))) - U64(1)) // 8  # bytes before the first that differs
        size[live] += np.where(equal, 8, first)
        live = live[equal]
        live = live[size[live] < most[live]]
    value = np.zeros(n, np.int64)
    value[at] = np.minimum(size, most)
    last = np.maximum.accumulate(np.where(follows, 0, every)) if n else every
    return phi, value[last] - (every - last)
