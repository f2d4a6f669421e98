"""Operator 13: WARC archives written from, and read back into, a chunked record table.

*Chunked record table.*  A payload is rows (rid, chunk_no) of at most
``chunk_bytes`` bytes; each row carries the SHA-1 digest and the length of the
payload up to its end, so the last chunk's are the payload's.  Chunks are cut
in the JVM by one expression; the digest runs from row to row of the stream.
The table is written once to the shared folder.

*Revisits.*  Of the records with equal payloads (equal SHA-1 and length) of at
least ``min_bytes`` the one with the largest id is the response, the others are
revisits of it; equal ids are told apart by the record number.  Only the list
of revisits is joined with the chunks; it is broadcast within a limit of measured
bytes.  A revisit needs no payload, so its chunks but the last are left out.

*Writing.*  Records of one chunk stay where they are; records of several chunks
are brought together by record number and sorted by chunk.  A task streams
chunk rows into one archive: WARC 1.1, one gzip member per record, compressed
as the chunks pass.  The header needs the length and digest of the whole
payload: every chunk of a long record gets them by a join with its last chunk's,
which carry no payload.  A file gets its name when it is complete.

*Reading.*  Archives are read in pieces: members are decompressed and records
cut into chunk rows again as the bytes pass.  The digest runs along and is
compared with the header's at the end of a response; a difference is an error.

No step holds more than one chunk and one read buffer of a record, apart from
the row that the caller's table itself holds.  A null payload is empty; a null
id is written as an empty one and is smaller than any other; a null URL is
empty; repeated rows are records of their own.  An empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import BROADCAST_BYTES, materialise, small_batches, steps
from wattlane.llm.shared_files import open_fs
from wattlane.session import scratch_table_path, ship_package

#: Fixed values of the archive format.
VERSION, CRLF, DIGEST_PREFIX = b"WARC/1.1", b"\r\n", "sha1:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
#: Date of records whose table has none.
EPOCH = "1970-01-01T00:00:00Z"
#: Bytes read from an archive at once, and decompressed bytes taken at once.
_READ, _PLAIN = 1 << 16, 1 << 20
_BATCH_ROWS = 32


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---------------------------------------------------------------------- chunk rows

def chunk_records(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
                  chunk_bytes: int = 1 << 18) -> DataFrame:
    """Rows (rid, id, url, chunk_no, last, data, sha1, upto) of all payloads, written to the shared folder."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")).withColumn(
                         "rid", F.monotonically_increasing_id())
    n = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)), F.lit(1)).cast("int")
    cut = F.transform(steps(0, n - 1), lambda i: F.substring(F.col("payload"), i * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes)))
    chunks = rows.select("rid", "id", "url", n.alias("n"), F.posexplode(cut).alias("chunk_no", "data"))
    chunks = chunks.select("rid", "id", "url", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, upto = hashlib.sha1(), 0
        for batch in batches:
            digests, lengths = [], []
            for data, last in zip(batch.column("data"), batch.column("last").to_pylist()):
                piece = data.as_buffer()
                sha.update(piece)
                upto += piece.size
                digests.append(sha.digest())
                lengths.append(upto)
                if last:
                    sha, upto = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(lengths, pa.int64())],
                                             [*batch.schema.names, "sha1", "upto"])

    with small_batches(spark, _BATCH_ROWS):
        return materialise(chunks.mapInArrow(
            run, "rid long, id long, url string, chunk_no int, last boolean, data binary, sha1 binary, upto long"), "warc-chunks")


def revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (rid, target_id, target_rid) of the records that repeat another one's payload."""
    ends = chunks.where("last").where(F.col("upto") >= min_bytes).select("rid", "id", "sha1", "upto")
    first = ends.groupBy("sha1", "upto").agg(
        F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "rid")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ends.join(first.select("sha1", "upto", F.col("best.id").alias("target_id"), F.col("best.rid").alias("target_rid")),
                     ["sha1", "upto"]).where("rid <> target_rid").select("rid", "target_id", "target_rid")


# ---------------------------------------------------------------------- writing

def _urn(record_id: int | None, rid: int) -> str:
    return f"<{RECORD_URN}{'' if record_id is None else record_id}:{rid}>"


def _urn_id(urn: str) -> int | None:
    text = urn[len(RECORD_URN) + 1:].split(":", 1)[0]
    return int(text) if text else None


def _uri(url: str) -> str:
    """A URL as a header value: white space and control characters escaped."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class ArchiveWriter:
    """One archive; a record is begun, given its payload in pieces and ended."""

    def __init__(self, sink, level: int = 6):
        self.sink, self.level, self.written = sink, level, 0

    def begin(self, headers: list[tuple[str, str]], http: bytes, payload_bytes: int) -> None:
        self.z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        head = [*headers, ("Content-Length", str(len(http) + payload_bytes))]
        self._put(VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head) + CRLF + http)
        self.left = payload_bytes

    def _put(self, data) -> None:
        out = self.z.compress(data)
        if out:
            self.sink.write(out)
            self.written += len(out)

    def piece(self, data) -> None:
        self._put(data)
        self.left -= len(data)

    def end(self) -> None:
        if self.left:
            raise ValueError(f"payload differs from its announced length by {self.left} bytes")
        self._put(CRLF + CRLF)
        out = self.z.flush()
        self.sink.write(out)
        self.written += len(out)


def _begin(w: ArchiveWriter, r: dict, content_type: str) -> None:
    repeat = r["target_rid"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {r['total']}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if repeat else "response"), ("WARC-Record-ID", _urn(r["id"], r["rid"])), ("WARC-Date", EPOCH),
               ("WARC-Target-URI", _uri(r["url"])), ("WARC-Payload-Digest", DIGEST_PREFIX + base32(r["digest"])),
               ("Content-Type", "application/http; msgtype=response")]
    if repeat:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(r["target_id"], r["target_rid"]))]
    w.begin(headers, http, 0 if repeat else r["total"])


def write_archives(chunks: DataFrame, out_dir: str | None = None, min_bytes: int = 0, content_type: str = "text/html; charset=utf-8",
                   level: int = 6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write the records of ``chunk_records`` as archives; rows (path, n_records, n_bytes), one per file."""
    spark = chunks.sparkSession
    ship_package(spark)
    out_dir = out_dir or scratch_table_path(spark, "warc")
    again = materialise(revisits(chunks, min_bytes), "warc-revisits")
    small = again.count() * 24 <= broadcast_bytes           # three longs a row
    again = F.broadcast(again) if small else again

    long_ends = chunks.where("chunk_no > 0 and last").select("rid", F.col("sha1").alias("digest"), F.col("upto").alias("total"))
    short = chunks.where("chunk_no = 0 and last").withColumns({"digest": F.col("sha1"), "total": F.col("upto")})
    pieces = chunks.where("not (chunk_no = 0 and last)").join(long_ends, "rid")
    short, pieces = (d.join(again, "rid", "left").where("target_rid is null or last")
                     .withColumn("data", F.when(F.col("target_rid").isNull(), F.col("data")))
                     .select("rid", "id", "url", "chunk_no", "last", "data", "digest", "total", "target_id", "target_rid") for d in (short, pieces))
    pieces = pieces.repartition("rid").sortWithinPartitions("rid", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fs, folder = TaskContext.get(), *open_fs(out_dir)
        name = f"{task.stageId():05d}-{task.partitionId():07d}"
        part = f"{folder}/.{name}-{task.taskAttemptId()}"
        writer = sink = open_rid = None
        n = 0
        for batch in batches:
            payloads = batch.column("data")
            for i, r in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(part, compression=None)
                    writer = ArchiveWriter(sink, level)
                    info = b"software: wattlane\r\nformat: WARC File Format 1.1\r\n"
                    writer.begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", EPOCH),
                                  ("Content-Type", "application/warc-fields")], info, 0)
                    writer.end()
                if open_rid != r["rid"]:
                    _begin(writer, r, content_type)
                    open_rid = r["rid"]
                if r["target_rid"] is None:
                    writer.piece(payloads[i].as_buffer())
                if r["last"]:
                    writer.end()
                    open_rid, n = None, n + 1
        if writer is None:
            return
        sink.close()
        path = f"{folder}/part-{name}.warc.gz"
        fs.move(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([f"{out_dir}/{os.path.basename(path)}"]), pa.array([n], pa.int64()),
                                          pa.array([writer.written], pa.int64())], ["path", "n_records", "n_bytes"])

    files = "path string, n_records long, n_bytes long"
    with small_batches(spark, _BATCH_ROWS):
        return materialise(short.mapInArrow(run, files).union(pieces.mapInArrow(run, files)), "warc-files")


# ---------------------------------------------------------------------- reading

def _plain(source) -> Iterator[bytes]:
    """The decompressed bytes of an archive, in bounded pieces; members follow one another."""
    z, data, begun, full = zlib.decompressobj(31), b"", False, False
    while True:
        if not data and not full:
            data = source.read(_READ)
            if not data:
                if begun:
                    raise ValueError("archive ends inside a member")
                return
        out = z.decompress(data, _PLAIN)
        begun, full = True, len(out) == _PLAIN       # full: there may be more without further input
        data = z.unused_data if z.eof else z.unconsumed_tail
        if out:
            yield out
        if z.eof:
            z, begun, full = zlib.decompressobj(31), False, False


class ArchiveReader:
    """Records of an archive one after another: headers, then the block in pieces."""

    def __init__(self, source):
        self.pieces, self.held = _plain(source), b""

    def _more(self) -> bool:
        got = next(self.pieces, None)
        if got is None:
            return False
        self.held += got
        return True

    def _until(self, mark: bytes, limit: int = 1 << 20) -> bytes | None:
        """Bytes before ``mark``, which is passed over; None at the end of the archive."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > limit:
                raise ValueError("header too long")
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a header")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def _take(self, n: int, size: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of ``size`` (the last may be shorter)."""
        while n:
            want = min(n, size)
            while len(self.held) < want:
                if not self._more():
                    raise ValueError("archive ends inside a record")
            yield self.held[:want]
            self.held = self.held[want:]
            n -= want

    @staticmethod
    def _fields(lines: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}

    def records(self, chunk_bytes: int) -> Iterator[tuple[dict, dict, Iterator[bytes]]]:
        """(headers, headers of the HTTP response, payload in chunks); the chunks are to be used up."""
        while (head := self._until(CRLF + CRLF)) is not None:
            if not head.startswith(b"WARC/1."):
                raise ValueError("no record where one is expected")
            fields, http, left = self._fields(head), {}, 0
            left = int(fields["content-length"])
            if fields["content-type"].startswith("application/http"):
                block = self._until(CRLF + CRLF)
                http, left = self._fields(block), left - len(block) - 4
            yield fields, http, self._take(left, chunk_bytes)
            if b"".join(self._take(4, 4)) != CRLF + CRLF:
                raise ValueError("record is longer than its length")


def read_archives(files: DataFrame, chunk_bytes: int = 1 << 18, with_data: bool = True) -> DataFrame:
    """Chunk rows (id, url, record_type, refers_to, chunk_no, last, upto, digest[, data]) of the archives in ``files``.

    ``upto``: payload bytes up to the chunk's end, ``digest``: their SHA-1 in
    base32; a revisit is one row with the length and digest of the payload it
    stands for.
    """
    spark = files.sparkSession
    ship_package(spark)
    names = ["id", "url", "record_type", "refers_to", "chunk_no", "last", "upto", "digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
    if with_data:
        names, types = [*names, "data"], [*types, pa.binary()]

    def rows(path: str) -> Iterator[tuple]:
        fs, p = open_fs(path)
        with fs.open_input_stream(p, compression=None) as source:
            for head, http, payload in ArchiveReader(source).records(chunk_bytes):
                kind = head["warc-type"]
                if kind not in ("response", "revisit"):
                    for _ in payload:
                        pass
                    continue
                told = head["warc-payload-digest"].removeprefix(DIGEST_PREFIX)
                same = _urn_id(head["warc-record-id"]), head["warc-target-uri"], kind
                if kind == "revisit":
                    yield (*same, _urn_id(head["warc-refers-to"]), 0, True, int(http["content-length"]), told, b"")
                    continue
                sha, upto, no, total = hashlib.sha1(), 0, 0, int(http["content-length"])
                if not total:
                    yield (*same, None, 0, True, 0, base32(sha.digest()), b"")
                for data in payload:
                    sha.update(data)
                    upto += len(data)
                    yield (*same, None, no, upto == total, upto, base32(sha.digest()), data)
                    no += 1
                if base32(sha.digest()) != told or upto != total:
                    raise ValueError(f"{path}: payload of {head['warc-record-id']} differs from its header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r[:len(names)])
                    size += 200 + (len(r[8]) if with_data else 0)
                    if size > 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    schema = "id long, url string, record_type string, refers_to long, chunk_no int, last boolean, upto long, digest string"
    return files.select("path").repartition(max(files.count(), 1)).mapInArrow(run, schema + (", data binary" if with_data else ""))
