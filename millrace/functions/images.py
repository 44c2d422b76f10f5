"""Image bytes in tasks: PNG files to and from pixels, orientation, gray values, resampling, and the difference hash of a file.

Python runs over Arrow batches, one image at a time; what it holds is one image. A file that cannot be read gives null.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: colour type to samples
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]  # fixed values: x, y, step x, step y of the interlace passes
MAX_PIXELS = 1 << 28


class NotAnImage(ValueError):
    pass


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if raw[:8] != _HEAD:
        raise NotAnImage("no PNG signature")
    at = 8
    while at + 12 <= len(raw):
        size = struct.unpack(">I", raw[at : at + 4])[0]
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size] or b"\0\0\0\0")[0]:
            raise NotAnImage(f"a damaged {kind!r} chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise NotAnImage("the end is missing")


def unfilter(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Scan lines with their filters undone. lines: rows of bytes; kinds: filter of each (none, sub, up, average, Paeth); step: bytes of a pixel."""
    out = np.zeros_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(kinds.tolist(), lines, strict=True)):
        row = out[y]
        if kind == 0:
            row[:] = line
        elif kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            row[:] = line + above
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            up, got, sent = above.tolist(), [0] * len(line), line.tolist()
            for i, v in enumerate(sent):
                c = i % step
                a, b = left[c], up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    d = corner[c]
                    pa_, pb, pc = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else d
                    corner[c] = b
                got[i] = left[c] = (v + guess) & 255
            row[:] = got
        else:
            raise NotAnImage(f"an unknown filter {kind}")
        above = row
    return out


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    if depth == 8:
        flat = lines[:, : width * channels]
    elif depth == 16:
        flat = lines[:, : 2 * width * channels : 2]  # the high byte
    else:
        bits = np.unpackbits(lines, axis=1)[:, : width * channels * depth].reshape(len(lines), -1, depth)
        flat = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return flat.reshape(len(lines), width, channels).astype(np.uint8)


def decode_png(raw: bytes) -> tuple[np.ndarray, int]:
    """(pixels as height x width x 1 (gray), 2 (gray, alpha), 3 (colour) or 4, orientation 1 to 8) of PNG bytes; all colour types, depths and both interlace methods."""
    head, data, palette, turn, clear = None, [], None, 1, b""
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"eXIf":
            turn = exif_orientation(body)
    if head is None:
        raise NotAnImage("no header")
    width, height, depth, colour, packing, filtering, interlace = head
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or packing or filtering or interlace > 1 or not 0 < width * height <= MAX_PIXELS:
        raise NotAnImage("a header of no known kind")
    channels = _CHANNELS[colour]
    step = max(1, channels * depth // 8)

    def need(w: int, h: int) -> int:
        return h * (1 + (w * channels * depth + 7) // 8) if w and h else 0

    parts = [(0, 0, 1, 1)] if not interlace else _PASSES
    sizes = [(-(-(width - x) // sx) if width > x else 0, -(-(height - y) // sy) if height > y else 0) for x, y, sx, sy in parts]
    total = sum(need(w, h) for w, h in sizes)
    try:
        flat = zlib.decompressobj().decompress(b"".join(data), total)
    except zlib.error as e:
        raise NotAnImage(str(e)) from e
    if len(flat) < total:
        raise NotAnImage("pixels are missing")
    out, at = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, sx, sy), (w, h) in zip(parts, sizes, strict=True):
        if w and h:
            block = np.frombuffer(flat, np.uint8, need(w, h), at).reshape(h, -1)
            out[y::sy, x::sx] = _samples(unfilter(block[:, 1:], block[:, 0], step), w, channels, depth)
            at += need(w, h)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise NotAnImage("a colour outside the palette")
        out = palette[out[..., 0]] if not clear else np.dstack([palette[out[..., 0]], np.frombuffer(clear.ljust(256, b"\xff"), np.uint8)[out[..., 0]]])
    elif depth < 8:
        out = (out.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return out, turn


def exif_orientation(body: bytes) -> int:
    """The orientation tag of an Exif block's first directory, 1 where it has none."""
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None or len(body) < 8:
        return 1
    at = struct.unpack(order + "I", body[4:8])[0]
    if at + 2 > len(body):
        return 1
    for i in range(struct.unpack(order + "H", body[at : at + 2])[0]):
        entry = body[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Pixels as they are meant to be seen under an orientation of 1 to 8."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of BT.601 in 16-bit fixed point; alpha is left aside."""
    if pixels.shape[2] < 3:
        return pixels[..., 0]
    c = pixels[..., :3].astype(np.int64)
    return ((c @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def cubic(x: float) -> float:
    """The Keys kernel with a = -0.5."""
    x = abs(x)
    return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0


def resample_weights(n: int, to: int) -> np.ndarray:
    """to x n weights of a bicubic resampling whose kernel widens when it shrinks, as whole numbers of 2**-22."""
    scale = n / to
    wide = max(scale, 1.0)
    out = np.zeros((to, n), np.int64)
    for i in range(to):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - 2 * wide + 0.5)), min(n, int(centre + 2 * wide + 0.5))
        w = [cubic((j - centre + 0.5) / wide) for j in range(lo, hi)]
        total = sum(w)
        out[i, lo:hi] = [int(math.copysign(0.5, x) + x / total * (1 << 22)) for x in w]
    return out


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Gray pixels resampled along rows, then along columns, each rounded to 8 bits."""
    def once(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.int64) @ w.T + (1 << 21)) >> 22, 0, 255)

    across = once(pixels, resample_weights(pixels.shape[1], width))
    return once(across.T, resample_weights(pixels.shape[0], height)).T.astype(np.uint8)


def dhash(raw: bytes, size: int = 8) -> str:
    """Difference hash of an image file's bytes as size * size / 4 hex characters."""
    pixels, turn = decode_png(raw)
    small = resized(gray(upright(pixels, turn)), size + 1, size)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def encode_png(pixels: np.ndarray, turn: int = 1, filters: Iterable[int] = (0,)) -> bytes:
    """8-bit PNG bytes of height x width x channels; filters are taken in turn, one for each line."""
    height, width, channels = pixels.shape
    kinds, colour = list(filters), {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    lines, above, out = pixels.reshape(height, -1).astype(np.int64), np.zeros(width * channels, np.int64), []
    for y, line in enumerate(lines):
        left, corner = (np.concatenate([np.zeros(channels, np.int64), x[:-channels]]) for x in (line, above))
        p = left + above - corner
        near = np.abs(np.stack([left, above, corner]) - p)
        paeth = np.choose(near.argmin(0), np.stack([left, above, corner]))
        kind = kinds[y % len(kinds)]
        guess = [np.zeros_like(line), left, above, (left + above) >> 1, paeth][kind]
        out.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    exif = b"" if turn == 1 else chunk(b"eXIf", b"MM\0\x2a\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01" + struct.pack(">HH", turn, 0) + b"\0\0\0\0")
    return _HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + exif + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


def file_hashes(rows: DataFrame, id_col: str, content: str, size: int = 8) -> DataFrame:
    """id, hash, problem: the difference hash of each row's image bytes, or why there is none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(1):
                try:
                    found.append((dhash(raw.as_py() or b"", size), None))
                except NotAnImage as e:
                    found.append((None, str(e)))
            hashes, problems = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string()), pa.array(problems, pa.string())], names=[id_col, "hash", "problem"])

    return rows.select(id_col, content).mapInArrow(run, f"`{id_col}` {kind}, hash string, problem string")
