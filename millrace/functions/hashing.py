"""Digests, stable orders and 64-bit fingerprints as Column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stable_key(seed: int | str, *parts: Column) -> Column:
    """sha256("seed:part"): an order that no sort of the input can change."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def seed_number(c: Column) -> Column:
    """First eight bytes of the SHA-256 of a text, as an unsigned number in text form (it exceeds a long)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10)


def normal_hash(c: Column, chars: int = 64) -> Column:
    """Hex text of a hash as a number of `chars` digits: lower case, zeros in front. One that has more digits is refused."""
    return F.when(F.length(c) > chars, F.raise_error(F.concat(F.lit(f"a hash of more than {chars} hex characters: "), c))).otherwise(F.lpad(F.lower(c), chars, "0"))


def hash_words(c: Column, chars: int = 64) -> list[Column]:
    """The number of a hash as longs of 64 bits, the highest first."""
    whole = normal_hash(c, chars)

    def half(at: int) -> Column:
        return F.conv(F.substring(whole, at, 8), 16, 10).cast("long")

    return [F.shiftleft(half(at), 32).bitwiseOR(half(at + 8)) for at in range(1, chars + 1, 16)]


def hamming(a: Column, b: Column, chars: int = 64) -> Column:
    """Number of differing bits of two hashes of up to `chars` hex characters, as numbers: a shorter one has zeros in front."""
    parts = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(hash_words(a, chars), hash_words(b, chars), strict=True)]
    return sum(parts[1:], parts[0])


def bits_to_hex(bits: Column, n: int = 64) -> Column:
    """Hex characters of an array of n booleans (a multiple of 32), the first the highest bit."""
    def half(lo: int) -> Column:
        value = F.aggregate(F.slice(bits, lo, 32), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long"))
        return F.lpad(F.lower(F.hex(value)), 8, "0")

    return F.concat(*[half(lo) for lo in range(1, n + 1, 32)])


def difference_hash(pixels: Column, size: int = 8) -> Column:
    """dHash of size rows of size + 1 gray values: each is brighter than its right neighbour or not."""
    at = F.sequence(F.lit(0), F.lit(size * size - 1))
    left = lambda i: (F.floor(i / size) * (size + 1) + i % size).cast("int")
    return bits_to_hex(F.transform(at, lambda i: F.get(pixels, left(i)) > F.get(pixels, left(i) + 1)), size * size)


def simhash(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """id, kept columns, simhash (16 hex characters) of the words of every text; a text without words has hash 0.

    A value of the row alone: nothing is shuffled. Words are told apart by white space of ASCII after lower-casing.
    """
    return docs.select(id_col, *(keep or []), _simhash(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("simhash"))


_BLANK = re.compile("[ \t\n\x0b\f\r]+")
_WORDS_AT_ONCE, _TEXTS_AT_ONCE, _KNOWN_WORDS = 1 << 15, 256, 1 << 17


@F.arrow_udf(StringType())
def _simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What a task holds besides its batch does not grow with texts: words of _WORDS_AT_ONCE, hashes of _KNOWN_WORDS words, texts of _TEXTS_AT_ONCE as Python's."""
    known: dict[str, int] = {}

    def hashes(texts: list[list[str]]) -> np.ndarray:
        """Sums of signed bits of 64-bit word hashes, one row for each text."""
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for w in {w for t in texts for w in t} - known.keys():
            known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        flat = np.array([known[w] for t in texts for w in t], ">u8")
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), 64), np.int64)
        if len(flat):
            used = np.flatnonzero(sizes)
            ones = np.add.reduceat(np.unpackbits(flat.view(np.uint8)).reshape(-1, 64), np.concatenate([[0], np.cumsum(sizes[used])[:-1]]), axis=0, dtype=np.int32)
            out[used] = 2 * ones - sizes[used, None]
        return out

    def signs(sums: np.ndarray) -> list[str]:
        return [row.tobytes().hex() for row in np.packbits(sums > 0, axis=1)]

    for batch in batches:
        found, held, n = [], [], 0
        for at in range(0, len(batch), _TEXTS_AT_ONCE):
            for text in batch.slice(at, _TEXTS_AT_ONCE).to_pylist():
                words = [w for w in _BLANK.split(text) if w]
                if len(words) > _WORDS_AT_ONCE:  # a very long text alone, in parts
                    if held:
                        found += signs(hashes(held))
                    found += signs(sum(hashes([words[i : i + _WORDS_AT_ONCE]]) for i in range(0, len(words), _WORDS_AT_ONCE)))
                    held, n = [], 0
                    continue
                held.append(words)
                n += len(words)
                if n >= _WORDS_AT_ONCE:
                    found += signs(hashes(held))
                    held, n = [], 0
        if held:
            found += signs(hashes(held))
        yield pa.array(found, pa.string())
