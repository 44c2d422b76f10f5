"""Directories, label files, images headers and archives as tables."""

from __future__ import annotations

import contextlib
import hashlib
import io
import os
import re
import shutil
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import file_stem, safe_member_path
from millrace.sources.storage import arrow_path, cut, folder_uri

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over too."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all files below a folder: every level's folders are listed by tasks, so names do not pass through the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = arrow_path(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in fs.get_file_info(pafs.FileSelector(base + folder[len(root) :])) if not _hidden(f.base_name)]
                path, length, is_folder = [f"{folder}/{f.base_name}" for f in found], [f.size or 0 for f in found], [f.type == pafs.FileType.Directory for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(is_folder, pa.bool_())], names=["path", "length", "folder"])

    front, found = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = cut(front.mapInArrow(run, "path string, length long, folder boolean"))
        here = level.where("not folder").drop("folder")
        found = here if found is None else found.unionAll(here)
        front = level.where("folder").select("path")
        if front.isEmpty():
            return found
        front = front.repartition("path")


def _contents(listed: DataFrame, root: str) -> DataFrame:
    """path, length with the content; a task reads a few files at once."""

    def packed(out: list[tuple]) -> pa.RecordBatch:
        path, length, content = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(content, pa.binary())], names=["path", "length", "content"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_path(root)
        for batch in batches:
            out, size = [], 0
            for path, length in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with fs.open_input_stream(base + path[len(root) :], compression=None) as f:
                    out.append((path, length, f.read()))
                size += length
                if size >= 1 << 24 or len(out) == 1000:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    return listed.repartition("path").mapInArrow(run, "path string, length long, content binary")


def inventory(spark: SparkSession, root: str, suffixes: Sequence[str] | None = None, *, content: bool = False, exclude: Sequence[str] = ()) -> DataFrame:
    """path, name, stem, parent, suffix, length (and content, sha256) of all files under root, listed and read by tasks."""
    root = folder_uri(spark, root)
    df = _listing(spark, root)
    if suffixes:
        df = df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    for part in exclude:
        df = df.where(~F.col("path").contains(f"/{part}/"))
    if content:
        df = _contents(df, root)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), file_stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "length", *(["content", F.sha2("content", 256).alias("sha256")] if content else []))


def storage_rollup(files: DataFrame, depth_root: str) -> DataFrame:
    """Files and bytes per first directory under a root, which is given as it stands in the paths."""
    child = F.regexp_extract("path", re.escape(depth_root.rstrip("/")) + r"/([^/]+)(?:/|$)", 1)
    return files.groupBy(child.alias("directory")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def map_folders(names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """names (folder) -> folder, label by a case-insensitive prefix; raises unless each matches exactly one."""
    hits = F.filter(F.array(*[F.when(F.startswith(F.lower("folder"), F.lit(p.lower())), F.lit(label)) for p, label in prefixes.items()]), lambda x: x.isNotNull())
    mapped = names.distinct().withColumn("labels", hits)
    bad = mapped.where(F.size("labels") != 1).take(3)
    if bad:
        raise ValueError(f"folders without exactly one label: {bad}")
    return mapped.select("folder", F.get("labels", F.lit(0)).alias("label"))


def class_folders(files: DataFrame) -> DataFrame:
    """split and label from .../split/label/name."""
    return files.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("split", F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1))


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and label files by stem; raises when one side misses the other."""
    both = images.select("stem", F.col("path").alias("image")).join(labels.select("stem", F.col("path").alias("label")), "stem", "full_outer")
    bad = both.where("image is null or label is null").take(3)
    if bad:
        raise ValueError(f"unpaired samples: {bad}")
    return both


def box_lines(lines: DataFrame) -> DataFrame:
    """lines (sample, line) -> sample, class_id, cx, cy, w, h, ok: class and four shares, inside the frame, with an area."""
    t = F.split(F.trim("line"), r"\s+")
    num = [F.get(t, F.lit(i)).try_cast("double") for i in range(1, 5)]
    out = lines.where(F.trim("line") != "").select("sample", F.get(t, F.lit(0)).try_cast("int").alias("class_id"), *[n.alias(c) for n, c in zip(num, ("cx", "cy", "w", "h"), strict=True)], F.size(t).alias("n"))
    inside = F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & (F.col("w") > 0) & (F.col("w") <= 1) & (F.col("h") > 0) & (F.col("h") <= 1)
    return out.withColumn("ok", F.coalesce((F.col("n") == 5) & (F.col("class_id") >= 0) & inside, F.lit(False))).drop("n")


@F.udtf(returnType="sample string, line_no long, class_id int, cx double, cy double, w double, h double, ok boolean")
class LabelLines:
    """Table function: rows of a table (sample, text) to one row for each label line that is not blank, numbered from 1 through a partition.

    In SQL: FROM label_lines(TABLE(texts) PARTITION BY sample), once register_label_lines() has been called.
    """

    def __init__(self):
        self.n = 0

    def eval(self, row):
        for line in (row["text"] or "").split("\n"):
            parts = line.split()
            if not parts:
                continue
            self.n += 1
            numbers = [self._number(x) for x in [*parts[1:5], *[""] * 4][:4]]
            kind = int(parts[0]) if parts[0].isascii() and parts[0].isdigit() else None
            cx, cy, w, h = numbers
            ok = len(parts) == 5 and kind is not None and None not in numbers and 0 <= cx <= 1 and 0 <= cy <= 1 and 0 < w <= 1 and 0 < h <= 1
            yield row["sample"], self.n, kind, cx, cy, w, h, ok

    @staticmethod
    def _number(text: str) -> float | None:
        try:
            return float(text)
        except ValueError:
            return None


def register_label_lines(spark: SparkSession, name: str = "label_lines") -> None:
    spark.udtf.register(name, LabelLines)


def resolve_exactly_one(wanted: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    """wanted (key) joined to the only file of that name; `matches` tells how many there were."""
    found = files.groupBy(key).agg(F.count("*").alias("matches"), F.min("path").alias("path"), F.countDistinct("sha256").alias("contents") if "sha256" in files.columns else F.lit(None).cast("long").alias("contents"))
    return wanted.join(found, key, "left").select(*wanted.columns, F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("path")).alias("path"), "contents")


def resolve_first_root(wanted: DataFrame, files: DataFrame, roots: Sequence[str], key: str = "name") -> DataFrame:
    """The file in the earliest root that holds the name; a root is the beginning of a path, as whole folders."""
    rank = F.coalesce(*[F.when(F.col("path").startswith(r.rstrip("/") + "/"), F.lit(i)) for i, r in enumerate(roots)])
    best = files.withColumn("rank", rank).where("rank is not null").groupBy(key).agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(best, key, "left")


def png_size(content: Column) -> Column:
    """struct(width, height) of PNG bytes, else null."""
    head = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(head, F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header of JPEG bytes; bytes between segments that are no marker are skipped."""
    if raw[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := raw.find(b"\xff", at)) >= 0 and at + 9 <= len(raw):
        kind = raw[at + 1]
        if kind == 0xFF:  # fill byte
            at += 1
        elif kind == 0 or kind == 0x01 or 0xD0 <= kind <= 0xD9:  # stuffed byte, or a marker without a segment
            at += 2
        else:
            size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if size < 2 or at + 2 + size > len(raw):
                return None
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, format, width, height; null where the header cannot be read."""

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                size = jpeg_size(bytes(raw))
                rows.append((path, "jpeg" if size else None, *(size or (None, None))))
            yield pd.DataFrame(rows, columns=["path", "format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    png = files.select("path", "content", png_size(F.col("content")).alias("s"))
    native = png.where("s is not null").select("path", F.lit("png").alias("format"), "s.width", "s.height")
    other = png.where("s is null").select("path", "content").mapInPandas(walk, "path string, format string, width int, height int")
    return native.unionAll(other)


def tar_members(spark: SparkSession, path: str, pattern: str, per_label: int) -> DataFrame:
    """archive, name, label, number, size of safe members whose name matches (label, number), first `per_label` each.

    An archive is walked as a stream, so only its members' headers are held.
    """

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["path"]:
                fs, at = arrow_path(archive)
                rows = []
                with fs.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append((archive, m.name, m.size))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["archive", "name", "size"])
                            rows = []
                yield pd.DataFrame(rows, columns=["archive", "name", "size"])

    members = spark.read.format("binaryFile").load(path).select("path").mapInPandas(walk, "archive string, name string, size long")
    parsed = members.where(safe_member_path(F.col("name"))).select("*", F.regexp_extract("name", pattern, 1).alias("label"), F.regexp_extract("name", pattern, 2).try_cast("int").alias("number")).where("number is not null")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("number", "name", "archive"))
    return parsed.withColumn("nth", nth).where(F.col("nth") <= per_label).select("archive", "name", "label", "number", "size")


def _place(fs, path: str, write) -> None:
    """write(open file) to a name of its own, then renamed, so a reader never sees half a file and a task may run twice."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    try:
        fs.move(part, path)
    except OSError:  # a file system that does not replace: the other attempt's file has the same content
        fs.delete_file(part)


def write_contents(rows: DataFrame, root: str) -> DataFrame:
    """rows (name, content binary) written as files under root; gives name, length, sha256 of what stands there."""

    def put(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = arrow_path(root)
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                data = bytes(content)
                _place(fs, f"{base}/{name}", lambda f, d=data: f.write(d))
                out.append((name, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(out, columns=["name", "length", "sha256"])

    return cut(rows.select("name", "content").mapInPandas(put, "name string, length long, sha256 string"))


def materialize(rows: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """rows (source, target, sha256) brought to a folder all executors share: link or copy, verified, idempotent.

    Returns target, method (kept, link, copy or missing) and ok. A target that stands is left as it is and verified.
    Any file system that pyarrow knows will do; links are made between local folders only.
    """

    def copy(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        (fs, base), (there, top) = arrow_path(source_root), arrow_path(target_root)
        local = isinstance(fs, pafs.LocalFileSystem) and isinstance(there, pafs.LocalFileSystem)
        for pdf in batches:
            out = []
            for source, target, digest in zip(pdf["source"], pdf["target"], pdf["sha256"], strict=True):
                src, dst = f"{base}/{source}", f"{top}/{target}"
                method = "kept"
                if there.get_file_info(dst).type != pafs.FileType.File:
                    if fs.get_file_info(src).type != pafs.FileType.File:
                        out.append((target, "missing", False))
                        continue
                    method = "copy"
                    if local:
                        there.create_dir(dst.rsplit("/", 1)[0], recursive=True)
                        with contextlib.suppress(OSError):
                            os.link(src, part := f"{dst}.{uuid.uuid4().hex}.part")
                            os.replace(part, dst)
                            method = "link"
                    if method == "copy":
                        with fs.open_input_stream(src, compression=None) as f:
                            _place(there, dst, lambda o, f=f: shutil.copyfileobj(f, o, 1 << 20))
                h = hashlib.sha256()
                with there.open_input_stream(dst, compression=None) as f:
                    while chunk := f.read(1 << 20):
                        h.update(chunk)
                out.append((target, method, h.hexdigest() == digest))
            yield pd.DataFrame(out, columns=["target", "method", "ok"])

    return rows.select("source", "target", "sha256").mapInPandas(copy, "target string, method string, ok boolean")


def hash_mismatches(files: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """Files whose content is not the expected one: key, sha256, expected."""
    return files.select(key, "sha256").join(expected.select(key, F.col("sha256").alias("expected")), key).where("sha256 <> expected")


def write_zips(rows: DataFrame, root: str) -> DataFrame:
    """rows (archive, name, content) as reproducible ZIP files under root: members by name, fixed times and attributes.

    Gives archive, members, bytes, sha256: the same digest for the same members, whenever it is written. One archive is
    written by one task, which holds its members' contents.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for name, content in sorted(zip(pdf["name"], pdf["content"], strict=True)):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
                z.writestr(info, bytes(content), compresslevel=6)
        fs, base = arrow_path(root)
        _place(fs, f"{base}/{pdf['archive'].iloc[0]}", lambda f: f.write(out.getvalue()))
        return pd.DataFrame([(pdf["archive"].iloc[0], len(pdf), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())], columns=["archive", "members", "bytes", "sha256"])

    return cut(rows.select("archive", "name", "content").groupBy("archive").applyInPandas(pack, "archive string, members long, bytes long, sha256 string"))


def zip_inventory(spark: SparkSession, root: str) -> DataFrame:
    """archive, name, bytes, sha256 of every member of the ZIP files under root."""

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, at = arrow_path(path)
                rows = []
                with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                    for m in z.infolist():
                        h = hashlib.sha256()
                        with z.open(m) as f:
                            while chunk := f.read(1 << 20):
                                h.update(chunk)
                        rows.append((path.rsplit("/", 1)[-1], m.filename, m.file_size, h.hexdigest()))
                yield pd.DataFrame(rows, columns=["archive", "name", "bytes", "sha256"])

    return spark.read.format("binaryFile").load(root).select("path").mapInPandas(walk, "archive string, name string, bytes long, sha256 string")


def unexpected_files(found: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    return found.join(expected.select(key), key, "left_anti")
