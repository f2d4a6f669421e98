"""Operator 9: token ids in binary files of independent zstandard frames with a trailing seek table.

File layout (the zstandard seekable format, so any zstandard reader can
decompress a whole file):

    frame*          ids, little-endian, about ``frame_ids`` per frame, each frame
                    with its own content checksum
    skippable frame the index: ids' width and, per document, id, first id, number
                    of ids (an Arrow table)
    skippable frame the seek table: per frame the compressed size, the size, and
                    the low 32 bits of the content's XXH64; then the number of
                    frames, a descriptor byte and the magic number

A reader takes the seek table from the end of the file, the index from the
entry before it, and then decompresses only the frames that hold the ids
asked for, checking each one's checksum.

Writing: documents are range-partitioned and sorted by id (ties split by a
salt, so a hot id spreads over files); every task writes one file under a
name of its attempt and renames it when it is complete, so a lost or repeated
attempt leaves no half file under the final name.  Documents are encoded with
the tokenizer library; words that were encoded before come from a bounded
cache, which is exact because no token reaches across their borders.  ``start`` counts the ids of all documents
before, by a running sum over the table of files (one row per file).

Files go to ``out_dir``, by default a new folder in the shared folder of
``spark.checkpoint.dir``; tasks open it through ``pyarrow.fs``
(``shared_files.open_fs`` names the schemes).

A null text is an empty text and has the end id alone; a null id sorts first;
repeated rows are written each.  An empty table writes no file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import materialise, text_or_empty
from wattlane.llm.piece_codec import slices
from wattlane.llm.shared_files import open_fs
from wattlane.llm.word_cache import CachedTokenizer
from wattlane.session import scratch_table_path, ship_package

#: Fixed values of the zstandard seekable format.
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX, CHECKSUM_FLAG = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80


_ENCODERS: dict[str, CachedTokenizer] = {}


# ---------------------------------------------------------------------- one file

class FrameWriter:
    """Writes one file: documents one after another, frames as they fill."""

    def __init__(self, sink, id_type: pa.DataType, frame_ids: int = 1 << 16, level: int = 3, width: int = 4):
        import zstandard

        self.sink, self.frame_ids, self.width = sink, frame_ids, width
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.id_type, self.ids, self.counts = id_type, [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        ids = ids.astype(f"<u{self.width}")
        while len(ids):
            part = ids[:self.frame_ids - self.n_pending]
            self.pending.append(part)
            self.n_pending += len(part)
            ids = ids[len(part):]
            if self.n_pending == self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        import xxhash

        if self.n_pending:
            raw = np.concatenate(self.pending).tobytes()
            self._put(self.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            self.pending, self.n_pending = [], 0

    def _put(self, data: bytes, size: int, checksum: int) -> None:
        self.sink.write(data)
        self.entries.append((len(data), size, checksum))

    def close(self) -> None:
        import xxhash

        self._flush()
        out = pa.BufferOutputStream()
        index = pa.table({"id": pa.array(self.ids, self.id_type), "count": pa.array(self.counts, pa.int64())})
        index = index.replace_schema_metadata({"width": str(self.width), "frame_ids": str(self.frame_ids)})
        with pa.ipc.new_stream(out, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(index)
        data = out.getvalue().to_pybytes()
        self._put(struct.pack("<II", SKIP_INDEX, len(data)) + data, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        foot = struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(table) + len(foot)) + table + foot)


class FrameReader:
    """Random access to one file: frames are read and decompressed when asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self.at = np.r_[0, np.cumsum(table[:, 0])]
        source.seek(int(self.at[n - 1]) + 8)
        self.index = pa.ipc.open_stream(source.read(int(table[-1, 0]) - 8)).read_all()
        meta = self.index.schema.metadata
        self.width, self.frame_ids = int(meta[b"width"]), int(meta[b"frame_ids"])
        self.counts = self.index.column("count").to_numpy()
        self.starts = np.cumsum(self.counts) - self.counts
        self.frames_read = 0
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if self._held[0] != k:
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.sizes[k])), int(self.raw[k]))
            if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: wrong checksum")
            self._held = (k, np.frombuffer(raw, f"<u{self.width}"))
            self.frames_read += 1
        return self._held[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        a, b = int(self.starts[i]), int(self.starts[i] + self.counts[i])
        f = self.frame_ids
        parts = [self.frame(k)[max(a - k * f, 0):b - k * f] for k in range(a // f, -(-b // f))]
        return np.concatenate(parts) if parts else np.empty(0, f"<u{self.width}")


# ---------------------------------------------------------------------- tables

def write_token_files(docs: DataFrame, tokenizer_file: str, out_dir: str | None = None, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
                      frame_ids: int = 1 << 16) -> DataFrame:
    """Write the ids of every row of ``docs``; returns the table of files.

    Rows (file, path, n_docs, n_ids, start): ``start`` is the number of ids in
    the files before.  ``files``: number of range partitions, by default
    ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out_dir = out_dir or scratch_table_path(spark, "token-files")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("salt"))
    ranged = base.repartitionByRange(files, "id", "salt").sortWithinPartitions("id", "salt").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = _ENCODERS.setdefault(tokenizer_file, None) or CachedTokenizer(tokenizer_file)
        _ENCODERS[tokenizer_file] = encoder
        fs, folder = open_fs(out_dir)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        tail = np.uint32(end_id)
        writer = sink = None
        part = f"{folder}/.{task.partitionId():07d}-{task.taskAttemptId()}"
        for batch in batches:
            for a, b, texts in slices((x.as_py() for x in batch.column("text")), 8_000_000):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(part)
                    writer = FrameWriter(sink, batch.schema.field("id").type, frame_ids, width=width)
                for i, ids in zip(batch.column("id").slice(a, b - a).to_pylist(), encoder.encode(texts)):
                    writer.add(i, np.append(ids, tail))
        if writer is None:
            return
        writer.close()
        sink.close()
        path = f"{folder}/part-{task.partitionId():07d}.ids.zst"
        fs.move(part, path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int64()), pa.array([f"{out_dir}/{os.path.basename(path)}"]),
             pa.array([len(writer.ids)], pa.int64()), pa.array([writer.n_ids], pa.int64())],
            ["file", "path", "n_docs", "n_ids"])

    written = materialise(ranged.mapInArrow(run, "file long, path string, n_docs long, n_ids long"), "token-file-table")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32[, ids]) of every document in the files of ``write_token_files``."""
    spark = files.sparkSession
    ship_package(spark)
    n = files.count()
    wide = ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["path"])
                with fs.open_input_file(path) as f:
                    reader = FrameReader(f, f.size())
                    for a in range(0, len(reader.counts), 2000):
                        docs = [reader.document(i).astype("<u4") for i in range(a, min(a + 2000, len(reader.counts)))]
                        cols = [reader.index.column("id").slice(a, len(docs)).combine_chunks(),
                                pa.array(reader.starts[a:a + len(docs)] + row["start"], pa.int64()),
                                pa.array([len(d) for d in docs], pa.int64()),
                                pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                        names = ["id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names)

    return (files.select("path", "start").repartition(max(n, 1))
            .mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long{wide}"))


def read_documents(files: DataFrame, wanted: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rows (id, ids) of the documents whose id is in column ``id`` of ``wanted``, frames read on demand.

    The files' indexes give (path, position, id); they are joined with ``wanted``
    and each file is opened once for its positions.
    """
    spark = files.sparkSession
    ship_package(spark)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    ids = FrameReader(f, f.size()).index.column("id").combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([path] * len(ids)), pa.array(range(len(ids)), pa.int64())], ["id", "path", "at"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, p = open_fs(row["path"])
                with fs.open_input_file(p) as f:
                    reader = FrameReader(f, f.size())
                    for a in sorted(row["ats"]):
                        yield pa.RecordBatch.from_arrays(
                            [reader.index.column("id").slice(a, 1).combine_chunks(),
                             pa.array([reader.document(a).astype(np.int64)], pa.list_(pa.int64()))], ["id", "ids"])

    where = files.select("path").repartition(max(files.count(), 1)).mapInArrow(index, f"id {id_type}, path string, at long")
    where = where.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("path").agg(
        F.collect_list("at").alias("ats"))
    return where.mapInArrow(fetch, f"id {id_type}, ids array<long>")
