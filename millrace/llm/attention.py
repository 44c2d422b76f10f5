"""A small causal self-attention language model over symbols, trained and run in numpy.

A symbol is a frequent subword id, or one of a few groups of rare ids. Symbols fall into classes of about equal weight. The model
gives P(symbol | before) = P(class | attention) * P(symbol | class, last symbol): the second factor and the start of the first come
from bigram counts, what attention adds to the classes is learned. Both factors are normalised, so the product is a
probability of the next symbol and a text's score is the log of a true probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32
STEP = 512  # windows scored at once, which stay in a core's cache


@dataclass(frozen=True)
class Shape:
    symbols: int = 1024
    shared: int = 64  # symbols that stand for groups of rare ids
    classes: int = 64
    chunk: int = 16  # positions scored in a window; it reaches back over as many before them
    width: int = 32
    keys: int = 8
    values: int = 24
    epochs: int = 3
    batch: int = 256
    rate: float = 0.01
    windows: int = 80_000  # of the sample that training starts from
    seed: int = 11
    rounds: int = 16  # in which all windows are learned, each in one of them, where the sample does not hold all


END = 0  # the symbol of a text's end, which also stands before its first


def symbols_of(counts: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each id, log probability of the id in its symbol); counts[-1] belongs to the end."""
    n = len(counts) - 1
    order = np.lexsort((np.arange(n), -counts[:n]))
    own = s.symbols - s.shared - 1
    symbol = np.empty(n + 1, np.int64)
    symbol[order[:own]] = np.arange(1, len(order[:own]) + 1)
    symbol[order[own:]] = own + 1 + np.arange(len(order[own:])) % s.shared
    symbol[n] = END
    weight = counts + 0.1
    total = np.bincount(symbol, weights=weight, minlength=s.symbols)
    return symbol, np.log(weight / total[symbol])


def classes_of(pairs: np.ndarray, s: Shape) -> np.ndarray:
    """Class of each symbol: halves of equal weight along the main direction of what stands before the symbols, again and again."""
    weight = pairs.sum(0) + 1e-3
    view = np.sqrt(pairs / (pairs.sum(1, keepdims=True) + 1.0)).T
    view = view / np.maximum(np.linalg.norm(view, axis=1, keepdims=True), 1e-9)
    group = np.zeros(s.symbols, np.int64)
    for _ in range(int(np.log2(s.classes))):
        new = group * 2
        for g in np.unique(group):
            inside = np.flatnonzero(group == g)
            w = weight[inside]
            x = view[inside] - np.average(view[inside], axis=0, weights=w)
            u, _, _ = np.linalg.svd(x * np.sqrt(w)[:, None], full_matrices=False)
            along = u[:, 0] / np.sqrt(w)
            along *= np.sign(along[np.argmax(np.abs(along))]) or 1
            order = np.argsort(along, kind="stable")
            half = np.cumsum(w[order])
            new[inside[order[half - w[order] / 2 > half[-1] / 2]]] += 1
        group = new
    return group


@dataclass
class Attention:
    """weights: E, Q, K, V, R (by distance), O. Tables come from counts: start[last, class], inside[last, symbol]."""

    shape: Shape
    group: np.ndarray
    start: np.ndarray
    inside: np.ndarray
    weights: dict[str, np.ndarray]


def untrained(pairs: np.ndarray, s: Shape) -> Attention:
    """pairs[last, next]: counts of the training texts. Bigrams are smoothed with unigrams by the number of followers."""
    uni = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * s.symbols)
    kinds = np.maximum((pairs > 0).sum(1, keepdims=True), 1)
    p = (pairs + kinds * uni) / (pairs.sum(1, keepdims=True) + kinds)
    group = classes_of(pairs, s)
    of_class = np.zeros((s.symbols, s.classes))
    for g in range(s.classes):
        of_class[:, g] = p[:, group == g].sum(1)
    of_class = np.maximum(of_class, 1e-12)
    inside = np.log(p) - np.log(of_class[:, group])
    rng = np.random.default_rng(s.seed)
    w = {
        "E": rng.normal(0, 0.5, (s.symbols, s.width)), "Q": rng.normal(0, 0.2, (s.width, s.keys)), "K": rng.normal(0, 0.2, (s.width, s.keys)),
        "V": rng.normal(0, 0.3, (s.width, s.values)), "R": -0.5 * np.arange(2 * s.chunk), "O": np.zeros((s.values, s.classes)),
    }
    return Attention(s, group, np.log(of_class).astype(F32), inside.astype(F32), {k: v.astype(F32) for k, v in w.items()})


def _distance(s: Shape) -> np.ndarray:
    """Distance of query i and key j of a window, -1 where the key is not before the query."""
    d = np.arange(s.chunk)[:, None] + s.chunk - np.arange(2 * s.chunk)[None, :]
    return np.where(d < 0, -1, d)


class Adam:
    """Adam's moments for the weights of a model."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.moved, self.done = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}, 0

    def step(self, w: dict[str, np.ndarray], grad: dict[str, np.ndarray], rate: float) -> None:
        self.done += 1
        for k, g in grad.items():
            m, v = self.moved[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w[k] -= rate * (m / (1 - 0.9**self.done)) / (np.sqrt(v / (1 - 0.99**self.done)) + 1e-8)


def learn(model: Attention, before: np.ndarray, target: np.ndarray, first: np.ndarray) -> Attention:
    """Adam over minibatches. before: (n, 2 * chunk) symbols of windows, target: (n, chunk) symbols or -1, first: windows at a text's start."""
    s, w = model.shape, model.weights
    if not len(before):
        return model
    d = _distance(s)
    adam = Adam(w)
    rng = np.random.default_rng(s.seed)
    steps, done = s.epochs * -(-len(before) // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(before))
        for lo in range(0, len(order), s.batch):
            pick = order[lo : lo + s.batch]
            grad = _gradient(model, before[pick], target[pick], first[pick], d)
            done += 1
            adam.step(w, grad, s.rate * min(1, done / 20) * (1 - (done - 1) / steps))
    return model


def _gradient(model: Attention, before: np.ndarray, target: np.ndarray, first: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    sums = Sums(model, d)
    sums.add(before.reshape(-1, model.shape.chunk), target, first)
    return sums.gradient()


class Sums:
    """What gradients of windows add up to: by symbol for keys, queries and values, so embeddings are multiplied out once, not in each window."""

    def __init__(self, model: Attention, d: np.ndarray | None = None):
        s, w = model.shape, model.weights
        self.s, self.w, self.group, self.kind = s, w, model.group, w["E"].dtype
        self.d = _distance(s) if d is None else d
        self.start = model.start.astype(self.kind, copy=False)
        self.q, self.k, self.v = (w["E"] @ w[x] for x in "QKV")
        self.bias = np.where(self.d < 0, -1e9, w["R"][np.maximum(self.d, 0)]).astype(self.kind)
        self.wild = _reach(self.q, self.k, w["R"]) > 60 or np.linalg.norm(self.v, axis=1).max() * np.linalg.norm(w["O"], axis=0).max() > 40
        self.parts = [np.zeros((s.symbols, 2 * s.keys + s.values)), np.zeros(w["O"].shape), np.zeros(self.d.shape), np.zeros(1)]

    def texts(self, symbols: np.ndarray, offsets: np.ndarray) -> None:
        """Adds every window of texts that follow each other in symbols."""
        rows, target, first = rows_of(symbols, offsets, self.s)
        for lo in range(0, len(target), STEP // 2):
            hi = min(lo + STEP // 2, len(target))
            self.add(rows[lo : hi + 1], target[lo:hi], first[lo:hi])

    def add(self, rows: np.ndarray, target: np.ndarray, first: np.ndarray) -> None:
        """rows: symbols before each place, two rows for each window, or one and the last of the window before it."""
        s, kind = self.s, self.kind
        n, c, kd, vd = len(target), s.chunk, s.keys, s.values
        hop = 2 if len(rows) == 2 * n else 1
        if not n:
            return
        last = rows[1::hop].ravel()
        q, k, v = self.q.take(last, axis=0).reshape(n, c, kd), _pairs(self.k.take(rows, axis=0), n, hop), _pairs(self.v.take(rows, axis=0), n, hop)
        a = q @ k.transpose(0, 2, 1)
        a += self.bias
        a[first, :, :c] = -1e9
        if self.wild:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= (a.reshape(n * c, -1) @ np.ones(2 * c, kind)).reshape(n, c, 1)
        ctx = (a @ v).reshape(n * c, vd)
        p = ctx @ self.w["O"]
        p += self.start.take(last, axis=0)
        if self.wild:
            p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        to = target.ravel()
        known = to >= 0
        p *= (known / (p @ np.ones(s.classes, kind))).astype(kind)[:, None]
        at = np.flatnonzero(known)
        p.ravel()[at * s.classes + self.group[to[at]]] -= 1
        by_symbol, g_o, by_place, total = self.parts
        total += len(at)
        g_o += ctx.T @ p
        g_ctx = p @ self.w["O"].T
        along = (g_ctx * ctx) @ np.ones(vd, kind)
        g_ctx = g_ctx.reshape(n, c, vd)
        g_v = a.transpose(0, 2, 1) @ g_ctx
        g_s = g_ctx @ v.transpose(0, 2, 1)
        g_s -= along.reshape(n, c, 1)
        g_s *= a
        by_place += g_s.sum(0)
        g = np.zeros((len(rows), c, 2 * kd + vd), kind)
        old, new = g[::hop][:n], g[1::hop][:n]
        new[..., :kd] = g_s @ k
        for x, lo, hi in ((g_s.transpose(0, 2, 1) @ q, kd, 2 * kd), (g_v, 2 * kd, 2 * kd + vd)):
            old[..., lo:hi] += x[:, :c]
            new[..., lo:hi] += x[:, c:]
        order = np.argsort(rows, axis=None, kind="stable")
        symbol = rows.ravel()[order]
        cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        by_symbol[symbol[cut]] += np.add.reduceat(g.reshape(-1, g.shape[-1]).take(order, axis=0), cut, axis=0)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def gradient(self, flat: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean over all places that were added, here or, with flat, in all tasks."""
        if flat is not None:
            self.parts = [x.reshape(old.shape) for x, old in zip(np.split(flat, np.cumsum([x.size for x in self.parts])[:-1]), self.parts, strict=True)]
        s, w, n = self.s, self.w, max(1, self.parts[3][0])
        by_symbol, g_o, by_place = (x / n for x in self.parts[:3])
        q, k, v = np.split(by_symbol, [s.keys, 2 * s.keys], axis=1)
        seen = self.d >= 0
        found = {"E": q @ w["Q"].T + k @ w["K"].T + v @ w["V"].T, "Q": w["E"].T @ q, "K": w["E"].T @ k, "V": w["E"].T @ v, "R": np.bincount(self.d[seen], weights=by_place[seen], minlength=2 * s.chunk), "O": g_o}
        return {name: x.astype(self.kind) for name, x in found.items()}


def _reach(q: np.ndarray, k: np.ndarray, r: np.ndarray) -> float:
    """No score of a query and a key is larger."""
    return np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(r).max()


def _pairs(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    """(n, 2 * chunk, width) of x (rows, chunk, width): two rows each, every hop rows, not copied."""
    return np.lib.stride_tricks.as_strided(x, (n, 2 * x.shape[1], x.shape[2]), (hop * x.strides[0], *x.strides[1:]), writeable=False)


def rows_of(symbols: np.ndarray, offsets: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, target, first) of all windows of texts that follow each other: rows[i + 1] stands before the places of window i, rows[i] before those of the one before it."""
    c, n, starts = s.chunk, np.diff(offsets), window_starts(offsets, s)
    place = np.arange(len(symbols)) + np.repeat(starts[:-1] * c - offsets[:-1], n)
    target = np.full(int(starts[-1]) * c, -1, np.int16)
    target[place] = symbols
    rows = np.full(len(target) + c + 1, END, np.int16)
    rows[place + c + 1] = symbols
    begin = starts[:-1][n > 0]
    rows[(begin + 1) * c] = END
    first = np.zeros(int(starts[-1]), bool)
    first[begin] = True
    return rows[:-1].reshape(-1, c), target.reshape(-1, c), first


def window_starts(offsets: np.ndarray, s: Shape) -> np.ndarray:
    """Number of the first window of each text, and of all; every position is the target of one window."""
    return np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // s.chunk))])


def windows_of(symbols: np.ndarray, offsets: np.ndarray, which: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, target, first) of the windows `which` of texts that follow each other in symbols."""
    c, starts = s.chunk, window_starts(offsets, s)
    text = np.searchsorted(starts, which, side="right") - 1
    part = which - starts[text]
    begin = offsets[text] + part * c
    at = begin[:, None] + np.arange(c)
    target = np.where(at < offsets[text + 1][:, None], symbols[np.minimum(at, max(0, len(symbols) - 1))], -1)
    before = symbols[np.clip(begin[:, None] + np.arange(-c, c) - 1, 0, max(0, len(symbols) - 1))]
    first = part == 0
    before[first, c] = END
    return before, target, first


class Scorer:
    """Tables of a trained model for scoring: keys, queries and values of a symbol are looked up, not multiplied out."""

    def __init__(self, model: Attention):
        s, w = model.shape, model.weights
        self.s, self.group, self.inside = s, model.group.astype(np.int32), model.inside
        self.q = (w["E"] @ w["Q"]).astype(F32)
        self.k = (w["E"] @ w["K"]).astype(F32)
        self.v = np.hstack([w["E"] @ w["V"], np.ones((s.symbols, 1))]).astype(F32)  # the last column sums the weights
        self.start, self.o = model.start, w["O"].astype(F32)
        d = _distance(s)
        self.bias = np.where(d < 0, F32(-1e9), w["R"][np.maximum(d, 0)]).astype(F32)
        self.wild = _reach(self.q, self.k, w["R"]) > 60

    def log_p(self, before: np.ndarray, target: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log of P(target) in each place; 0 where there is none. Only scores that may leave float's range are limited."""
        out = np.zeros(target.shape)
        for lo in range(0, len(before), STEP):
            hi = min(lo + STEP, len(before))
            out[lo:hi] = self._some(before[lo:hi].reshape(-1, self.s.chunk), 2, target[lo:hi], first[lo:hi])
        return out

    def _some(self, rows: np.ndarray, hop: int, target: np.ndarray, first: np.ndarray) -> np.ndarray:
        """rows: as in Sums.add."""
        n, c = target.shape
        last, to = rows[1::hop].ravel(), target.ravel()
        a = self.q.take(last, axis=0).reshape(n, c, -1) @ _pairs(self.k.take(rows, axis=0), n, hop).transpose(0, 2, 1)
        a += self.bias
        if self.wild:
            np.clip(a, -60, 60, out=a)
            a[:, self.bias < -1e8] = -1e9
        np.exp(a, out=a)
        a[first, :, :c] = 0
        ctx = a @ _pairs(self.v.take(rows, axis=0), n, hop)
        ctx = (ctx[..., :-1] / ctx[..., -1:]).reshape(-1, self.s.values)
        logit = ctx @ self.o
        logit += self.start.take(last, axis=0)
        there = np.maximum(to, 0)
        mine = logit[np.arange(len(to)), self.group[there]]
        np.exp(logit, out=logit)
        got = mine - np.log(logit @ np.ones(logit.shape[1], F32)) + self.inside[last, there]
        return np.where(to >= 0, got, 0).reshape(target.shape)

    def texts(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each text, a few windows at a time: a long text takes little more than its symbols."""
        rows, target, first = rows_of(symbols, offsets, self.s)
        got = np.zeros(len(target))
        for lo in range(0, len(target), STEP):
            hi = min(lo + STEP, len(target))
            got[lo:hi] = self._some(rows[lo : hi + 1], 1, target[lo:hi], first[lo:hi]).sum(1)
        return np.bincount(np.repeat(np.arange(len(offsets) - 1), -(-np.diff(offsets) // self.s.chunk)), weights=got, minlength=len(offsets) - 1)
