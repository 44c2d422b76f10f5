"""TIFF media columns: walk image directories, decode strips and tiles, one row per page.

The reader takes both byte orders, compressions none, LZW, PackBits and deflate, 8-bit samples
(chunky), strips or tiles, and the horizontal predictor. `tiff_pages` gives one row per page of a
binary column; damaged files give one row with `error` set instead of failing a task.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: How many bytes a stored byte can become at most: a run of 128 in two bytes, a table entry of up to 3,838 bytes in nine bits, deflate's 1,032.
EXPANDS = {NONE: 1, LZW: 3838, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032}
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : m.start()])
        out += bytes((257 - len(m[0]), m[0][0]))
        at = m.end()
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, most: int = 1 << 40) -> bytes:
    out, i, size = [], 0, 0
    while i < len(data) and size < most:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
            continue
        size += len(out[-1])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, early change, clear code at the start and when the table is full."""
    codes = {bytes((i,)): i for i in range(256)}
    size, width, acc, bits, out, prefix = 258, 9, 256, 9, bytearray(), b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in codes:
            prefix = longer
            continue
        acc, bits = acc << width | codes[prefix], bits + width
        codes[longer] = size
        size += 1
        if size == 4095:
            acc, bits = acc << width | 256, bits + width
            codes, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif size in (512, 1024, 2048):
            width += 1
        prefix = data[i : i + 1]
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
    if prefix:
        acc, bits = acc << width | codes[prefix], bits + width
        size += 1
        if size in (512, 1024, 2048):
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, most: int = 1 << 40) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, width, acc, bits, out, last, size = base[:], 9, 0, 0, [], None, 0
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            entries, width, last = base[:], 9, None
            continue
        if last is None:
            entry = entries[code]
        else:
            entry = entries[code] if code < len(entries) else last + last[:1]
            entries.append(last + entry[:1])
            if len(entries) in (511, 1023, 2047):
                width += 1
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        last = entry
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    """At most `most` bytes, so a small strip cannot claim unbounded memory."""
    return zlib.decompressobj().decompress(data, most)


def _plain(data: bytes, most: int) -> bytes:
    return data[:most]


_DECODE = {NONE: _plain, LZW: lzw_decode, PACKBITS: packbits_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}
_ENCODE = {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: np.ndarray  # height x width x samples


@dataclass
class Layout:
    """How the writer stores a page; tile is (width, height), multiples of 16, or None for strips."""

    compression: int = DEFLATE
    predictor: int = 2
    tile: tuple[int, int] | None = None
    rows_per_strip: int = 64


def _difference(block: np.ndarray, predictor: int) -> bytes:
    if predictor == 2:
        block = block.copy()
        block[:, 1:] -= block[:, :-1].copy()
    return block.tobytes()


def write_tiff(pages: list[tuple[np.ndarray, Layout]]) -> bytes:
    """Little-endian TIFF of 8-bit pages (height x width, or x samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image, layout in pages:
        image = image.reshape(*image.shape[:2], -1)
        height, width, samples = image.shape
        blocks = []
        if layout.tile:
            tw, th = layout.tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            blocks = [image[y : y + layout.rows_per_strip] for y in range(0, height, layout.rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            packed = _ENCODE[layout.compression](_difference(block, layout.predictor))
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8] * samples), 259: (3, [layout.compression]), 262: (3, [2 if samples == 3 else 1]), 277: (3, [samples]), 284: (3, [1]), 317: (3, [layout.predictor])}
        if layout.tile:
            tags |= {322: (4, [layout.tile[0]]), 323: (4, [layout.tile[1]]), 324: (4, offsets), 325: (4, sizes)}
        else:
            tags |= {273: (4, offsets), 278: (4, [layout.rows_per_strip]), 279: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                body, place = struct.pack("<I", len(out)), body
                out += place + b"\0" * (len(place) % 2)
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def read_tiff(raw: bytes) -> Iterator[Page]:
    """Pages in directory order. Raises ValueError for what is not a TIFF of the supported kinds."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", raw[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a cycle")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            size = TYPE_SIZE.get(kind, 1) * count
            place = at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(order + "I", raw, place)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", raw, place)
        width, height = tags[256][0], tags[257][0]
        samples, compression, predictor = tags.get(277, (1,))[0], tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        if set(tags.get(258, (1,))) != {8} or tags.get(284, (1,))[0] != 1 or compression not in _DECODE or predictor not in (1, 2):
            raise ValueError("unsupported sample layout or compression")
        tiled = 322 in tags
        bw, bh = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
        if not (width and height and samples and bw and bh):
            raise ValueError("a page or its blocks have no size")
        offsets, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
        across, down = -(-width // bw), -(-height // bh)
        if len(offsets) != across * down or len(sizes) != len(offsets):
            raise ValueError("the blocks do not cover the page")
        if any(o + n > len(raw) for o, n in zip(offsets, sizes, strict=True)):
            raise ValueError("a block lies outside of the file")
        claimed = across * bw * (down * bh if tiled else height) * samples
        if claimed > EXPANDS[compression] * sum(sizes) + 64:
            raise ValueError("the blocks cannot hold as many samples as the page claims")
        image = np.zeros((height, width, samples), np.uint8)
        for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
            y, x = (k // across) * bh, (k % across) * bw
            rows = bh if tiled else min(bh, height - y)
            flat = np.frombuffer(_DECODE[compression](raw[offset : offset + size], rows * bw * samples), np.uint8)[: rows * bw * samples]
            block = flat.reshape(rows, bw, samples)
            if predictor == 2:
                block = np.add.accumulate(block, axis=1, dtype=np.uint8)
            part = block[: height - y, : width - x]
            image[y : y + part.shape[0], x : x + part.shape[1]] = part
        yield Page(width, height, samples, compression, predictor, tiled, image)
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, data binary, error string"


def tiff_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page: the id, PAGE_SCHEMA's columns. Null or damaged media: one row with error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for k, p in enumerate(read_tiff(raw or b"")):
                        rows.append((key, k, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.data.tobytes(), None))
                except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, TypeError, struct.error, zlib.error) as e:
                    rows.append((key, len(rows), None, None, None, None, None, None, None, str(e) or type(e).__name__))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
                types = [batch.schema.field(0).type, *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "data", "error"])

    out = df.select(id_col, media_col).mapInArrow(run, f"id {kind}, {PAGE_SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def payload_pages(payload: np.ndarray, side: int = 576, page_rows: int = 16) -> list[tuple[np.ndarray, Layout]]:
    """Rows of `side` bytes as pages, dealt over four layouts in turn; the number of rows says which comes first."""
    rows = payload.reshape(-1, side)
    layouts = (Layout(DEFLATE, 2, rows_per_strip=8), Layout(LZW, 1, rows_per_strip=8), Layout(DEFLATE, 2, (side // 2, 16)), Layout(PACKBITS, 1, rows_per_strip=8))
    return [(rows[y : y + page_rows], layouts[(k + len(rows)) % 4]) for k, y in enumerate(range(0, len(rows), page_rows))]


def media_digest(docs: DataFrame, side: int = 576) -> DataFrame:
    """Store every text's bytes as a multi-page TIFF, read the stored bytes back, digest what was read.

    A null text is empty; every text, however long, is stored whole. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    size = max(1, -(-len(raw) // side)) * side
                    media = write_tiff(payload_pages(np.frombuffer(raw.ljust(size, b"\xff"), np.uint8), side))
                    pages = list(read_tiff(media))
                    data = b"".join(p.data.tobytes() for p in pages)
                    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                    share = counts[counts > 0] / len(data)
                    mean = float((counts * np.arange(256)).sum() / len(data))
                    entropy = float(-(share * np.log2(share)).sum())
                    feature = f"pages={len(pages)};rows={sum(p.height for p in pages)};mean={mean:.4f};entropy={entropy:.4f};values={len(share)}"
                    digest = hashlib.sha256(data).hexdigest()
                    rows.append((doc_id, len(raw), len(data), digest, zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_DIGEST)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DIGEST = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op3_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


