"""PNG bytes against hand-made files, resampling against sums, table functions and limited walks."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import images
from millrace.operators import graph
from millrace.sources import files


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, colour, lines, interlace=0, extra=b""):
    return images._HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip_with_all_filters(channels):
    rng = np.random.default_rng(channels)
    for width, height in ((1, 1), (7, 11), (40, 9)):
        x = rng.integers(0, 256, (height, width, channels)).astype(np.uint8)
        x[height // 2 :] = x[0]
        for turn in (1, 6):
            back, found = images.decode_png(images.encode_png(x, turn, range(5)))
            assert (back == x).all() and found == turn
        for kind in range(5):
            assert (images.decode_png(images.encode_png(x, filters=[kind]))[0] == x).all()


def test_png_kinds():
    bits = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1], [0] * 9], np.uint8)
    got, _ = images.decode_png(png(9, 2, 1, 0, b"".join(b"\0" + np.packbits(r).tobytes() for r in bits)))
    assert (got[..., 0] == bits * 255).all()
    deep = (np.arange(12).reshape(2, 6) * 3000).astype(">u2")
    got, _ = images.decode_png(png(6, 2, 16, 0, b"".join(b"\0" + r.tobytes() for r in deep)))
    assert (got[..., 0] == deep >> 8).all()
    palette = bytes(range(30))
    got, _ = images.decode_png(png(4, 1, 4, 3, b"\0\x12\x30", extra=chunk(b"PLTE", palette) + chunk(b"tRNS", b"\x05")))
    assert got.tolist() == [[[3, 4, 5, 255], [6, 7, 8, 255], [9, 10, 11, 255], [0, 1, 2, 5]]]
    full = np.random.default_rng(3).integers(0, 256, (10, 13, 3)).astype(np.uint8)
    lines = b""
    for x, y, sx, sy in images._PASSES:
        part = full[y::sy, x::sx]
        if part.size:
            lines += b"".join(b"\0" + r.tobytes() for r in part)
    assert (images.decode_png(png(13, 10, 8, 2, lines, interlace=1))[0] == full).all()


def test_damaged_files_have_no_hash(spark):
    good = images.encode_png(np.zeros((3, 3, 1), np.uint8))
    flipped = bytearray(good)
    flipped[30] ^= 1
    bomb = png(60000, 60000, 8, 0, b"\0" * 10)
    rows = [(1, good), (2, None), (3, b""), (4, good[:40]), (5, bytes(flipped)), (6, b"\xff\xd8\xff"), (7, bomb), (8, png(5, 5, 8, 0, b"\0" * 7)), (9, png(5, 1, 8, 0, b"\x09" + b"\0" * 5))]
    got = {r.id: (r.hash, r.problem is None) for r in images.file_hashes(spark.createDataFrame(rows, "id long, content binary"), "id", "content").collect()}
    assert got == {1: ("0" * 16, True)} | {i: (None, False) for i in range(2, 10)}


def test_orientations():
    x = np.arange(6).reshape(2, 3, 1).astype(np.uint8)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for turn, rows in want.items():
        assert images.upright(x, turn)[..., 0].tolist() == rows
    assert images.exif_orientation(b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0") == 6
    assert images.exif_orientation(b"XX") == images.exif_orientation(b"MM\0\x2a\0\0\xff\xff") == 1


def test_resampling():
    flat = np.full((37, 53), 77, np.uint8)
    assert (images.resized(flat, 9, 8) == 77).all() and (images.resized(flat[:3, :2], 9, 8) == 77).all()
    ramp = np.tile(np.arange(0, 180, 2, dtype=np.uint8), (16, 1))
    small = images.resized(ramp, 9, 8)
    assert (np.diff(small[:, 1:-1].astype(int), axis=1) == 20).all() and (np.abs(images.resample_weights(90, 9).sum(1) - (1 << 22)) < 50).all()
    assert images.gray(np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0]]], np.uint8)).tolist() == [[255, 76, 150]]
    assert len(images.dhash(images.encode_png(ramp[..., None]), 16)) == 64 and images.dhash(images.encode_png(ramp[..., None])) == "0" * 16


def test_limited_walk_is_a_queue(spark):
    rng = random.Random(5)
    members = []
    for parent in range(12):
        listed = [(rng.randrange(1, 12), False) for _ in range(3)] + [(100 + rng.randrange(30), True) for _ in range(4)]
        rng.shuffle(listed)
        members += [(parent, at, child, leaf) for at, (child, leaf) in enumerate(listed)]
    df = spark.createDataFrame(members, "parent long, at long, child long, leaf boolean").repartition(3)
    for limit, depth in ((1, 3), (6, 0), (9, 3), (17, 2), (1000, 4)):
        queue, visited, found = [(0, 0)], set(), []
        while queue and len(found) < limit:
            node, level = queue.pop(0)
            if node in visited:
                continue
            visited.add(node)
            for _, _, child, leaf in sorted(m for m in members if m[0] == node):
                if leaf and child not in [f for f, _ in found]:
                    found.append((child, level))
                    if len(found) >= limit:
                        break
                elif not leaf and level < depth:
                    queue.append((child, level + 1))
        got = [(r.node, r.depth) for r in graph.first_reached(df, 0, depth, limit).orderBy("place").collect()]
        assert got == found


def test_label_lines_from_sql(spark):
    files.register_label_lines(spark)
    spark.createDataFrame([("a", "0 .5 .5 .2 .2\n\n1 2 .5 .2 .2"), ("a", "x"), ("b", None), ("c", "0 .5 .5 0 .2 9")], "sample string, text string").createOrReplaceTempView("label_texts")
    got = spark.sql("SELECT sample, count(*) AS n, count_if(ok) AS good, max(line_no) AS last FROM label_lines(TABLE(label_texts) PARTITION BY sample) GROUP BY sample")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3, 1, 3), ("c", 1, 0, 1)]


def test_roots_are_beginnings(spark):
    disk = spark.createDataFrame([("x", "/b/x"), ("x", "/c/a/x"), ("y", "/ab/y")], "name string, path string")
    got = {r.name: r.path for r in files.resolve_first_root(spark.createDataFrame([("x",), ("y",)], "name string"), disk, ["/a", "/b/"]).collect()}
    assert got == {"x": "/b/x", "y": None}
