"""Token-ID output: independent zstandard frames, a trailing seek table and per-frame checksums.

File layout: one zstandard frame per document holding its ids as little-endian unsigned integers;
a skippable frame with a directory (sorted doc ids, id counts, width of an id); and the seek table of
the public seekable format, whose entries carry the low 32 bits of XXH64 over each frame's content.
Any zstandard decoder can read the frames; `TokenFile` reads only the ones asked for.

Scale: one range shuffle of the texts by doc_id (the order is part of the contract); shards are
written under a name of their own by every attempt of a task, and the manifest names the attempt that
ended well, so a task that runs twice never meets its own file. Only one manifest row per shard reaches the driver.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, partitions, table
from .tokens import tokenizer, vocabulary

# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
LIMIT_SEEK_FRAMES = 0x8000000


class TokenFileWriter:
    """Streams documents into one file. add() order is the file's order."""

    def __init__(self, sink, width: int, level: int = 3):
        self.sink, self.width = sink, width
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(self.entries) >= LIMIT_SEEK_FRAMES:
            raise ValueError("a shard holds more documents than a seek table; use more partitions")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.packer.compress(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append(doc_id)
        self.n_tokens += len(ids)

    def finish(self) -> None:
        known = np.array([x is not None for x in self.docs], np.uint8)
        ids = np.array([x if x is not None else 0 for x in self.docs], "<i8")
        directory = struct.pack("<BQ", self.width, len(ids)) + self.packer.compress(ids.tobytes() + known.tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(directory)) + directory)
        table_ = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(table_) + 9) + table_ + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC))


class TokenFile:
    """Random access to a token file; only the frames asked for are read and decompressed."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        begin = size - 9 - 12 * count - 8
        source.seek(begin)
        if struct.unpack("<II", source.read(8)) != (SEEK_TABLE, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.checks = entries[:, 0], entries[:, 1], entries[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.reader = zstandard.ZstdDecompressor()
        source.seek(int(self.at[-1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE:
            raise ValueError("the directory is missing")
        body = source.read(length)
        self.width, n = struct.unpack("<BQ", body[:9])
        raw = self.reader.decompress(body[9:]) if n else b""
        ids, known = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n :], np.uint8)
        self.doc_ids: list[int | None] = [int(i) if k else None for i, k in zip(ids, known, strict=True)]

    def frame(self, k: int) -> np.ndarray:
        self.source.seek(int(self.at[k]))
        raw = self.reader.decompress(self.source.read(int(self.sizes[k])), max_output_size=max(1, int(self.raw_sizes[k])))
        if len(raw) != self.raw_sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"checksum mismatch in frame {k}")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Frames of the documents with that id; the directory is sorted, null ids first."""
        nulls = bisect.bisect_left(self.doc_ids, True, key=lambda x: x is not None)
        lo = bisect.bisect_left(self.doc_ids, doc_id, nulls)
        return list(range(lo, bisect.bisect_right(self.doc_ids, doc_id, lo)))

    def document(self, doc_id: int) -> np.ndarray:
        """Ids of the first document with that id."""
        found = self.find(doc_id)
        if not found:
            raise KeyError(doc_id)
        return self.frame(found[0])

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k, doc_id in enumerate(self.doc_ids):
            yield doc_id, self.frame(k)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_files(docs: DataFrame, out_dir: str, vocab: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1, n_shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Write documents (doc_id, text) in ascending doc_id order; returns (shard, path, n_docs, n_tokens).

    Null texts are empty documents (only the end id). Null ids come first; rows that share an id are
    ordered by text. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = vocabulary(vocab)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        shard = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}")
        tok = tokenizer(path, kind)
        end = np.array([end_id], np.int64)
        width = max(tok.dtype.itemsize, 2 if end_id < 1 << 16 else 4)
        target = f"{base}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.zst"
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.encode(texts), strict=True):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        sink = fs.open_output_stream(target, compression=None)
                        writer = TokenFileWriter(sink, width)
                    writer.add(doc_id, np.concatenate([ids.astype(np.int64), end]))
        if writer is not None:
            writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [target], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens]})

    ordered = docs.select("doc_id", "text").repartitionByRange(n_shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long").collect()
    return sorted(tuple(r) for r in rows)


def read_token_files(spark: SparkSession, manifest: list[tuple[int, str, int, int]], out_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    rows, base = [], 0
    for k, (_, path, _, n_tokens) in enumerate(manifest):
        rows.append((k, path, base))
        base += n_tokens
    uri = out_dir

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                out: list[tuple] = []
                with fs.open_input_file(path) as source:
                    for doc_id, ids in TokenFile(source, source.size()):
                        out.append((doc_id, at, len(ids), crc_of_ids(ids)))
                        at += len(ids)
                        if len(out) >= 8192:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "k int, path string, base long").repartitionById(max(1, len(rows)), F.col("k"))  # a task for each file
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = fresh_path(spark, "op10")
    manifest = write_token_files(table(spark, sf_dir, "documents"), out_dir)
    return read_token_files(spark, manifest, out_dir)
