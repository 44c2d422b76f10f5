"""Tokenizer wrapper with an exact, bounded cache of context-free text pieces.

The tokenizer itself is never changed: pieces are cut only where the pre-tokenizer cuts whatever
stands around them, each distinct piece is encoded by the library, and its ids are reused.

Plain texts (ASCII without apostrophes and Latin letters of U+00C0..U+00FF, white space only as single
spaces and line breaks) are cut into runs of letters, digits, punctuation and white space by a few numpy
passes; pieces are known by 64-bit hash and their ids are gathered from one array. Other texts are cut at
spaces in Python; where even that cut cannot be proven (white space on both sides of a space, or a text that holds
one of the vocabulary's added tokens, which the library finds before all else), a text is encoded whole.
"""

from __future__ import annotations

import contextlib
import os
import re

import numpy as np

from .common import KEPT
from .textops import lower_ascii, rolling, span_hash

LETTER, DIGIT, MARK, BLANK = 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, MARK, np.uint8)
    kind[65:91] = kind[97:123] = kind[128:] = LETTER
    kind[48:58] = DIGIT
    kind[[32, 10]] = BLANK
    odd = np.zeros(256, bool)
    odd[:32] = odd[127] = odd[39] = True
    odd[10] = False
    odd[0xC0:] = True
    odd[0xC3] = False
    return kind, odd


_KIND, _ODD = _classes()
_LOOKS = re.compile(r" (?=\s|\Z)")
_UNSURE = re.compile(r"\s (?=\s|\Z)")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """kind 'byte': byte-level pre-tokenizer that keeps spaces; 'word': white space is dropped."""

    def __init__(self, path: str, kind: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind, self.limit = kind, limit
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.mark = np.zeros(self.tok.get_vocab_size() + 1, bool)  # ids that end (word) or begin (byte) a word
        for token, i in self.tok.get_vocab().items():
            self.mark[i] = token.endswith("</w>") if kind == "word" else token.startswith("\u0120")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self._forget()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_atoms(self, atoms: list[str]) -> list[bytes]:
        """Words of letters go to the library as one text and are told apart by the vocabulary's word marks."""
        words, rest = [], []
        for a in atoms:
            (words if a.strip(" ").isalpha() and (self.kind == "word" or a[0] == " ") else rest).append(a)
        out = dict(zip(rest, self._encode(rest), strict=True)) if rest else {}
        if words:
            joined = " ".join(words) if self.kind == "word" else "".join(words)
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            marks = np.flatnonzero(self.mark[ids])
            begin, end = (np.concatenate([[0], marks[:-1] + 1]), marks + 1) if self.kind == "word" else (marks, np.append(marks[1:], len(ids)))
            if len(marks) == len(words) and begin[0] == 0 and end[-1] == len(ids):
                raw, w = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
                out |= {a: raw[b * w : e * w] for a, b, e in zip(words, begin.tolist(), end.tolist(), strict=True)}
            else:
                out |= dict(zip(words, self._encode(words), strict=True))
        return [out[a] for a in atoms]

    def pieces(self, text: str) -> list[str] | None:
        if any(t in text for t in self.added):
            return None
        if self.kind == "word":
            with contextlib.suppress(UnicodeEncodeError):  # in Latin-1 lower case has no context and composition changes nothing
                text.encode("latin-1")
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        if _LOOKS.search(text) and _UNSURE.search(text):
            return None
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def atoms(self, piece: str) -> list[str]:
        """A piece cut further where a single line break, or punctuation after letters, surely ends a token."""
        head, brk, tail = piece.partition("\n")
        if brk and head.strip() and not head[-1].isspace() and tail and not tail[0].isspace():
            return [*self.atoms(head), brk, *self.atoms(tail)]
        core = piece.rstrip(",.;:!?")
        if core != piece and core.lstrip(" ").isalpha():
            return [core, piece[len(core) :]]
        return [piece]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are plain."""
        odd = _ODD[data]
        lead = data == 0xC3
        tail = (data & 0xC0) == 0x80
        odd[1:] |= tail[1:] & ~lead[:-1]
        odd[1:] |= lead[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:1] |= tail[:1]
        blank = (data == 32) | (data == 10)
        odd[1:] |= blank[1:] & blank[:-1]
        sums = np.concatenate([[0], np.cumsum(odd)])
        return sums[offsets[1:]] == sums[offsets[:-1]]

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces [start, end) of plain texts."""
        kind = _KIND[data]
        begin = np.ones(len(data), bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        blank = kind[start] == BLANK
        if self.kind == "word":
            return start[~blank], end[~blank]
        # A space belongs to the piece after it, unless it ends its text.
        last = np.zeros(len(data) + 1, bool)
        last[offsets[1:]] = True
        joins = blank & (data[start] == 32) & ~last[end]
        after = np.flatnonzero(joins) + 1
        start[after] -= 1
        return start[~joins], end[~joins]

    def encode_plain(self, raw: list[bytes]) -> list[np.ndarray | None]:
        """Ids of the plain texts among raw, None for the others."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        plain = self._plain(data, offsets)
        if not plain.all():
            keep = np.repeat(plain, np.diff(offsets))
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(np.diff(offsets)[plain])])
        if self.kind == "word":
            data = lower_ascii(data)
        start, end = self._runs(data, offsets)
        known, inverse = np.unique(span_hash(rolling(data), start, end), return_inverse=True)
        if len(self.slots) > self.limit:
            self._forget()
        slots = list(map(self.slots.get, known.tolist()))
        missing = [i for i, x in enumerate(slots) if x is None]
        if missing:
            first = np.empty(len(known), np.int64)
            first[inverse[::-1]] = np.arange(len(inverse))[::-1]
            text = data.tobytes()
            atoms = [text[a:b].decode() for a, b in zip(start[first[missing]].tolist(), end[first[missing]].tolist(), strict=True)]
            for i, slot in zip(missing, self._store(known[missing].tolist(), self._encode_atoms(atoms)), strict=True):
                slots[i] = slot
        slot = np.array(slots, np.int64)[inverse]
        sizes = self.slot_size[slot]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.slot_start[slot] - at[:-1], sizes) + np.arange(at[-1])]
        edge = at[np.searchsorted(start, offsets)].tolist()
        parts = iter([ids[a:b] for a, b in zip(edge, edge[1:], strict=False)])
        return [next(parts) if p else None for p in plain.tolist()]

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.slot_start, self.slot_size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = 0

    def _store(self, keys: list[int], ids: list[bytes]) -> range:
        """Slots of new pieces."""
        new = np.frombuffer(b"".join(ids), self.dtype)
        size = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        slots = range(len(self.slots), len(self.slots) + len(keys))
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(new), self.dtype)])
        if slots.stop > len(self.slot_start):
            self.slot_start, self.slot_size = (np.concatenate([x, np.zeros(len(x) + len(keys), np.int64)]) for x in (self.slot_start, self.slot_size))
        self.flat[self.used : self.used + len(new)] = new
        self.slot_start[slots.start : slots.stop] = self.used + np.cumsum(size) - size
        self.slot_size[slots.start : slots.stop] = size
        self.used += len(new)
        self.slots.update(zip(keys, slots, strict=True))
        return slots

    def _learn(self, missing: set[str]) -> None:
        """Put the ids of pieces that are not in the cache into it."""
        cache, older = self.cache, self.older
        parts = {}
        for piece in missing:
            if (ids := older.get(piece)) is not None:
                cache[piece] = ids
            else:
                parts[piece] = self.atoms(piece)
        new = []
        for atom in {a for x in parts.values() for a in x} - cache.keys():
            if (ids := older.get(atom)) is not None:
                cache[atom] = ids
            else:
                new.append(atom)
        if new:
            cache.update(zip(new, self._encode_atoms(new), strict=True))
        for piece, x in parts.items():
            if len(x) > 1:
                cache[piece] = b"".join([cache[a] for a in x])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, exactly as the library encodes the whole text without special tokens."""
        whole = [any(t in text for t in self.added) for text in texts]
        done = iter(self.encode_plain([t.encode() for t, w in zip(texts, whole, strict=True) if not w]) if texts else [])
        found = [None if w else next(done) for w in whole]
        rest = iter(self.encode_other([t for t, f in zip(texts, found, strict=True) if f is None]))
        return [next(rest) if f is None else f for f in found]

    def encode_other(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.limit:
            self.older, self.cache = self.cache, {"": b""}
        cut = [self.pieces(t) for t in texts]
        missing = set().union(*(x for x in cut if x)) - self.cache.keys()
        if missing:
            self._learn(missing)
        get = self.cache.__getitem__
        return [np.frombuffer(self._encode([text])[0] if pieces is None else b"".join(map(get, pieces)), self.dtype) for text, pieces in zip(texts, cut, strict=True)]


def tokenizer(path: str, kind: str) -> CachedTokenizer:
    """One tokenizer for each worker process."""
    if (path, kind) not in KEPT:
        KEPT[path, kind] = CachedTokenizer(path, kind)
    return KEPT[path, kind]
