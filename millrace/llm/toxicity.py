"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

Spans that may hide a word (tokens that mix letters with digits or symbols, three or more single letters that are
spaced out, letters repeated three times or more, words with accents, full-width letters, letters of other alphabets
that look like Latin ones, or invisible characters) become character lattices: every symbol may stand for itself,
for the letters it imitates, or, where it repeats, separates or is invisible, for nothing. A Viterbi decoder picks
the path with the best product of channel and character language model; a span whose best path is
itself stays. Restored words are then scored by evidence learned from labelled rows.

Scale: the language model counts 4-grams of 32 symbols over all documents (at most 2**20 counts, pre-added
in each task); the labelled sample is bounded by `sample_per_class`; scoring is one pass without a
shuffle. The broadcast tables have fixed upper sizes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, rows_with, table
from .quality import labelled_sample
from .textops import buffers, slices

THRESHOLD = 0.3
SYMBOLS = 32

#: What a symbol may stand for besides itself, with its channel log probability.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: Letters of other alphabets by the Latin letter that they look like (Cyrillic, then Greek, then others).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ω": "w", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d",
}
IMITATE, SAME, DROP_REPEAT, DROP_SEPARATOR, KEEP_ODD = math.log(0.3), 0.0, math.log(0.4), math.log(0.4), math.log(0.02)

_LEET = r"0-9@$!|+(€*"
_MIXED = rf"(?:[^\W\d_][.\-_]*[{_LEET}]|[{_LEET}][.\-_]*[^\W\d_]|[^\W\d_][.\-_]+[^\W\d_])"
_PART = rf"(?:[^\W\d_]|[{_LEET}.\-_])"
_SPACED = r"[^\W\d_](?:[ .\-_*]+[^\W\d_]){2,}"
_ODD = re.compile(
    rf"(?<![^\W_]){_SPACED}(?![^\W_])"  # spaced-out letters
    rf"|(?<![^\W\d_])(?<![{_LEET}.\-_])(?!\({_SPACED}(?![^\W_]))(?={_PART}*?{_MIXED}){_PART}+"  # letters and symbols mixed
)
_TRIPLE = re.compile(r"([^\W\d_])\1\1+")
_WORD = re.compile(r"[^\W\d_]+")
#: Characters that may disguise a word: outside of Latin letters with and without accents, but for the dotless i.
_FOREIGN = re.compile("[\u00ad\u0131\u0250-\U0010ffff]+")
LEET = set("0123456789@$!|+(*")


def repeats(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the words that hold a letter three times in a row. Every character is passed once."""
    end = 0
    for m in _TRIPLE.finditer(text):
        if m.start() >= end:
            start = m.start()
            while start > end and text[start - 1].isalpha():
                start -= 1
            word = _WORD.match(text, start)
            end = word.end() if word else m.end()
            yield start, end


@lru_cache(1 << 12)
def latin(c: str) -> str:
    """The Latin letter that a character outside ASCII stands for (by its looks, or without its accent, width or style), or ''."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    first, *marks = unicodedata.normalize("NFKD", c).lower()
    return first if "a" <= first <= "z" and all(map(unicodedata.combining, marks)) else ""


@lru_cache(1 << 12)
def invisible(c: str) -> bool:
    """Zero-width characters, soft hyphens and marks over the letter before."""
    return unicodedata.category(c) in ("Cf", "Mn")


@lru_cache(1 << 15)
def disguised(token: str) -> bool:
    """Whether all characters outside ASCII stand for Latin letters or are invisible, and the token is not plainly a word of another alphabet."""
    odd = [c for c in token if c > "\x7f"]
    seen = [c for c in odd if not invisible(c)]
    return all(map(latin, seen)) and (any("a" <= c <= "z" for c in token) or any(c not in LOOKALIKES for c in seen))


def foreign(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens with foreign characters that may be Latin words in disguise. Every character is passed once."""
    end = 0
    for m in _FOREIGN.finditer(text):
        if m.start() >= end:
            start = m.start()
            while start > end and (text[start - 1].isalpha() or text[start - 1] in LEET):
                start -= 1
            end = m.end()
            while end < len(text) and (text[end].isalpha() or text[end] in LEET or (text[end] > "\x7f" and invisible(text[end]))):
                end += 1
            if disguised(text[start:end]) if end - start <= 64 else disguised.__wrapped__(text[start:end]):
                yield start, end


def spans(text: str, odd: bool = True) -> Iterator[tuple[int, int]]:
    """(start, end) of the spans that may hide a word, in order; of two that overlap the one that begins first. Without `odd` only those
    with characters outside ASCII."""
    found = [((m.start(), m.end()) for m in _ODD.finditer(text)), repeats(text)] if odd else []
    if not text.isascii():
        found.append(foreign(text))
    end = 0
    for span in merge(*found, key=lambda x: x[0]):
        if span[0] >= end:
            yield span
            end = span[1]


@dataclass(frozen=True)
class Settings:
    sample_per_class: int = 2500
    min_support: int = 3
    support_share: float = 0.004
    min_evidence: float = 2.0
    min_likelihood_ratio: float = 24.0
    prefixes: tuple[int, ...] = (4, 5, 6)


# ---------------------------------------------------------------- character language model


def _symbol_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    t[0xC0:] = 27
    return t


_SYMBOL = _symbol_table()


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): 4-grams of symbols over the whole texts of all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in slices(offsets, 1 << 20):
                part = data[offsets[lo] : offsets[hi]]
                s = _SYMBOL[part[(part & 0xC0) != 0x80]].astype(np.int32)
                s = np.concatenate([np.zeros(3, np.int32), s, np.zeros(1, np.int32)])
                s = s[np.concatenate([[True, True, True], (s[3:] > 0) | (s[2:-1] > 0)])]
                code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
                total += np.bincount(code, minlength=SYMBOLS**4)
        found = np.flatnonzero(total)
        for lo in range(0, len(found), 50_000):
            part = found[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated log P(symbol | three before it), shape (32, 32, 32, 32)."""
    c4 = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    p = np.full((SYMBOLS,) * 4, 0.05 / SYMBOLS)
    for weight, drop in ((0.5, 0), (0.25, 1), (0.15, 2), (0.05, 3)):
        c = c4.sum(axis=tuple(range(drop)))
        total = c.sum(axis=-1, keepdims=True)
        p += weight * np.where(total > 0, c / np.maximum(total, 1), 1 / SYMBOLS)
    return np.log(p).astype(np.float32)


class Restorer:
    """Viterbi decoder over character lattices, with a bounded cache of spans."""

    def __init__(self, model: np.ndarray, limit: int = 50_000):
        self.model, self.limit, self.cache, self.plain = model, limit, {}, {}
        self.flat = array("f", np.ascontiguousarray(model, np.float32).tobytes())

    def arcs(self, span: str) -> list[list[tuple[str, float]]]:
        """For each character, what it may stand for ('' for nothing) and the channel's log probability."""
        lattice, spaced = [], len(re.findall(r"[ .\-_*]", span)) >= 3 or re.fullmatch(_SPACED, span)
        for i, c in enumerate(span):
            out = []
            if c > "\x7f" and invisible(c):
                out += [(c, KEEP_ODD), ("", DROP_SEPARATOR)]
            elif c > "\x7f" and (plain := latin(c)):
                styled = c not in LOOKALIKES and unicodedata.decomposition(c).startswith("<")  # another width or style of the letter itself
                out += [(plain, SAME)] if styled else [(c, SAME), (plain, IMITATE)]
                if i and span[i - 1] == c:
                    out.append(("", DROP_REPEAT))
            elif c.isalpha():
                out.append((c, SAME))
                if i and span[i - 1] == c:
                    out.append(("", DROP_REPEAT))
            else:
                out.append((c, KEEP_ODD))
                out += [(x, IMITATE) for x in IMITATES.get(c, "")]
                if c in " .-_*" and spaced or c in ".-_":
                    out.append(("", DROP_SEPARATOR))
                if i and span[i - 1] == c and c in IMITATES:
                    out.append(("", DROP_REPEAT))
            lattice.append(out)
        return lattice

    def decode(self, span: str) -> str:
        known = self.cache.get(span)
        if known is not None:
            return known
        flat, mask = self.flat, SYMBOLS**3 - 1
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # the three symbols before, five bits each
        for arcs in self.arcs(span):
            after: dict[int, tuple[float, tuple]] = {}
            coded = [(out, cost, symbol(out) if out else -1) for out, cost in arcs]
            for before, (score, path) in states.items():
                for out, cost, d in coded:
                    if d < 0:
                        key, value = before, score + cost
                    else:
                        at = before * SYMBOLS + d
                        key, value = at & mask, score + cost + flat[at]
                    best = after.get(key)
                    if best is None or value > best[0]:
                        after[key] = (value, (path, out) if out else path)
            states = after
        path = max(states.items(), key=lambda x: (x[1][0] + flat[x[0] * SYMBOLS], x[0]))[1][1]
        letters = []
        while path:
            path, out = path
            letters.append(out)
        result = "".join(reversed(letters))
        if len(self.cache) >= self.limit:
            self.cache.clear()
        if len(span) <= 64:
            self.cache[span] = result
        return result

    def words(self, text: str, suspicious: bool = True, sought=None) -> set[str]:
        """Distinct words of the text as written and, where it may hide some, as restored (unless suspicious only those with foreign characters).

        Accents are part of many languages: a word with some is read without them only where `sought` says so of the plain word.
        """
        low = text.lower()
        found = set(_WORD.findall(low))
        if sought and not low.isascii():
            known, more = self.plain, []
            for w in found:
                if not w.isascii():
                    hit = known.get(w)
                    if hit is None:
                        plain = unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode()
                        hit = len(plain) >= len(w) and sought(plain)
                        if len(known) >= self.limit:
                            known.clear()
                        known[w] = hit
                    if hit:
                        more += _WORD.findall(self.decode(w))
            found.update(more)
        for start, end in spans(low, suspicious):
            span = low[start:end]
            restored = self.decode(span)
            if restored != span:
                found.update(_WORD.findall(restored))
        return found


_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[0xC0:] = True
_SYMBOL_BYTE = np.zeros(256, bool)
_SYMBOL_BYTE[[ord(c) for c in "0123456789@$!|+(*.-_"]] = True
_SYMBOL_BYTE[0xC0:] = True
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in "0123456789@$!|+(*"]] = True
_LEET_BYTE[0xE2:] = True
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[ord(c) for c in " .-_*"]] = True


def suspicious_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """False for texts in which no span of ASCII can match; a few array passes spare most texts the search.

    A span holds a symbol right before a letter, one that imitates a letter right after a letter or a separator, a letter three
    times in a row, or three single letters with separators between. Characters outside ASCII count as letters and as symbols.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    second = data[np.minimum(at + 1, len(data) - 1)] if len(data) else lead
    letter, n = _LETTER_BYTE[lead], len(lead)
    code = np.where(lead >= 0xC0, lead.astype(np.uint16) << 8 | second | 0x20, lead | 0x20)
    hit = np.zeros(n, bool)
    if n > 2:
        last = np.zeros(len(data) + 1, bool)
        last[offsets] = True
        hit[:-1] |= ~last[at[1:]] & _SYMBOL_BYTE[lead[:-1]] & letter[1:] & ((lead[:-1] < 0xC0) | (lead[:-1] >= 0xE2))
        hit[:-2] |= letter[:-2] & (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:])
        dotted = np.isin(lead[:-1], [ord(c) for c in ".-_"])
        hit[:-1] |= ~last[at[1:]] & (letter[:-1] | dotted) & _LEET_BYTE[lead[1:]]
        gap = _GAP_BYTE[lead]
        one = np.flatnonzero(~np.concatenate([[False], gap[1:] & gap[:-1] & ~last[at[1:]]]))  # a run of separators as one
        x, g = letter[one], gap[one]
        if len(one) > 4:
            free = np.concatenate([[True], ~x[:-1] | (lead[one[:-1]] >= 0x80) | last[at[one[1:]]]])  # no ASCII letter before
            open_ = np.concatenate([free[1:] | ~x[1:] | (lead[one[1:]] >= 0x80), [True]])  # nor behind
            three = free[:-4] & x[:-4] & g[1:-3] & x[2:-2] & g[3:-1] & x[4:]
            more = np.flatnonzero(three & (open_[4:]))
            hit[one[more]] = True
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at[hit], side="right") - 1] = True
    return out


def restore(text: str, restorer: Restorer) -> str:
    """The lower-cased text with every span replaced by its best reading."""
    low, out, at = (text or "").lower(), [], 0
    for start, end in spans(low):
        out += [low[at:start], restorer.decode(low[start:end])]
        at = end
    return "".join([*out, low[at:]])


# ---------------------------------------------------------------- evidence


class Evidence:
    """Learned log odds of words and word beginnings."""

    def __init__(self, weights: dict[str, float], s: Settings, limit: int = 200_000):
        self.weights, self.s, self.limit, self.cache, self.least = weights, s, limit, {}, min(s.prefixes, default=1 << 30)

    def of(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            get, size = self.weights.get, len(word)
            got = get(word, 0.0) if size < self.least else max([get(word, 0.0), *[get(word[:k] + "~", 0.0) for k in self.s.prefixes if size >= k]])
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache[word] = got
        return got

    def strong(self, word: str) -> bool:
        return self.of(word) >= self.s.min_evidence

    def summary(self, words: set[str]) -> tuple[float, float, float, float]:
        """The three strongest evidences, and the log of the number of words (more words, more chance hits)."""
        known, least, strong = self.cache.get, self.s.min_evidence, []
        for word in words:
            e = known(word)
            if e is None:
                e = self.of(word)
            if e >= least:
                strong.append(e)
        strong = sorted(strong, reverse=True)[:3]
        return (*strong, *[0.0] * (3 - len(strong)), math.log1p(len(words)))


def _features(words: set[str], s: Settings) -> list[str]:
    return list(words | {w[:k] + "~" for w in words for k in s.prefixes if len(w) >= k})


@dataclass
class Model:
    language: np.ndarray
    weights: dict[str, float]
    coefficients: tuple[float, ...]  # intercept, three strongest evidences, log number of words


def held_out(doc_id):
    return F.coalesce(remainder(doc_id, 4) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Language model over all documents; evidence and calibration from the bounded labelled sample."""
    counts = np.zeros(SYMBOLS**4, np.int64)
    got = ngram_counts(docs).toArrow()
    counts[got.column("code").to_numpy()] = got.column("n").to_numpy()
    language = language_model(counts)
    sample = cut(labelled_sample(docs, labels, "toxic", held_out, s.sample_per_class).select("text", "label"))
    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else 0.0
        return Model(language, {}, (prior, 0.0, 0.0, 0.0, 0.0))
    shipped = docs.sparkSession.sparkContext.broadcast(language)
    known_rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    prior = known_rows.agg(F.avg("toxic")).first()[0]

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shipped.value)
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in _features(restorer.words(text or ""), s):
                    tally.setdefault(f, [0, 0])[label] += 1
        names = list(tally)
        for lo in range(0, len(names), 20_000):
            part = names[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([tally[f][1] for f in part], pa.int64()), pa.array([tally[f][0] for f in part], pa.int64())], names=["f", "t", "c"])

    least = max(s.min_support, math.ceil(s.support_share * n1))
    t, c, n = F.col("t").cast("double"), F.col("c").cast("double"), float(n1 + n0)
    both = t + c
    ratio = 2 * (t * F.log(t * n / (both * n1)) + F.when(c > 0, c * F.log(c * n / (both * n0))).otherwise(0.0))
    sums = sample.mapInArrow(explode, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rows = sums.where((F.col("t") >= least) & (F.col("t") * n0 >= 6 * (F.col("c") + 0.5) * n1) & (ratio >= s.min_likelihood_ratio)).collect()  # as bounded as the sample is
    found = docs.sparkSession.sparkContext.broadcast({r.f for r in rows})

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(feature, neighbours of its first occurrence): copies of one text have them in common."""
        restorer, seen = Restorer(shipped.value), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = ["", *_WORD.findall(restore(text, restorer)), ""]
                once: set[str] = set()
                for i in range(1, len(words) - 1):
                    for f in (words[i], *(words[i][:k] + "~" for k in s.prefixes if len(words[i]) >= k)):
                        if f in found.value and f not in once:
                            once.add(f)
                            seen.add((f, f"{words[i - 1]} {words[i + 1]}"))
        rows = sorted(seen)
        for lo in range(0, len(rows), 20_000):
            part = rows[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), pa.array([n for _, n in part], pa.string())], names=["f", "near"])

    apart = {r.f: r.n for r in sample.where("label = 1").select("text").mapInArrow(contexts, "f string, near string").groupBy("f").agg(F.countDistinct("near").alias("n")).collect()}

    def independent(r) -> bool:
        t = min(r.t, apart.get(r.f, 0))
        both = t + r.c
        return t >= least and 2 * (t * math.log(t * n / (both * n1)) + (r.c * math.log(r.c * n / (both * n0)) if r.c else 0.0)) >= s.min_likelihood_ratio

    weights = {r.f: math.log((r.t + 0.5) / (n1 + 1)) - math.log((r.c + 0.5) / (n0 + 1)) for r in rows if independent(r)}
    known = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, evidence = Restorer(shipped.value), Evidence(known.value, s)
        for batch in batches:
            found = [evidence.summary(restorer.words(t or "", sought=evidence.strong)) for t in batch.column(0).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.float64()) for c in columns)], names=["label", "a", "b", "c", "n"])

    got = sample.mapInArrow(measure, "label int, a double, b double, c double, n double").toArrow().sort_by([(x, "ascending") for x in ("label", "a", "b", "c", "n")])
    return Model(language, weights, _logistic(np.stack([got.column(x).to_numpy() for x in ("a", "b", "c", "n")], 1), got.column("label").to_numpy(), prior))


def _logistic(x: np.ndarray, label: np.ndarray, prior: float, ridge: float = 0.5, steps: int = 40) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the classes weigh as among all labelled rows."""
    m = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.where(label == 1, prior * len(x) / max(1, (label == 1).sum()), (1 - prior) * len(x) / max(1, (label == 0).sum()))
    beta, keep = np.zeros(m.shape[1]), np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        hessian = (m * (w * p * (1 - p))[:, None]).T @ m + keep + 1e-9 * np.eye(len(beta))
        beta -= np.linalg.solve(hessian, m.T @ (w * (p - label)) + keep @ beta)
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """docs plus a double column `score` in (0, 1), in place of one that is there; a null or empty text has no evidence."""
    docs = docs.drop("score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        restorer, evidence = Restorer(m.language), Evidence(m.weights, s)
        first, *rest = m.coefficients
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            out = []
            data, offsets = buffers(column)
            for lo, hi in slices(offsets, 1 << 20):
                flags = suspicious_texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for text, flag in zip(column.slice(lo, hi - lo).to_pylist(), flags.tolist(), strict=True):
                    z = first + sum(b * x for b, x in zip(rest, evidence.summary(restorer.words(text or "", flag, evidence.strong)), strict=True))
                    out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, rows_with(docs, "score double"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
