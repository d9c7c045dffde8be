"""WARC archives: a writer of record-per-member gzip files and a splittable reader.

Reading tasks get byte ranges. Each scans its range for the gzip magic, validates a candidate by decoding its first bytes,
and then reads record after record; a task owns the records that start inside its range, wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialise

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n"
RECORD = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def _base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: dict[str, object]) -> bytes:
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END + END


def _record(kind: str, name: object, url: str | None, payload: bytes, length: int, digest: str, refers_to: object, date: str, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(_head(fields | {"Content-Length": len(block)}) + block + END + END) + packer.flush()


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _put(store: FileSystem, hidden: str, name: str) -> None:
    """Renames a finished archive; one that an earlier run of the task has left is replaced, also in stores that don't rename onto a file."""
    try:
        store.move(hidden, name)
    except OSError:
        store.delete_file(name)
        store.move(hidden, name)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes a record for each row and returns the archives as a table of (path, bytes, records).

    Of rows with equal payloads of at least least_bytes bytes the one with the smallest id becomes a response and the others
    revisit it; repeated rows that tie for the smallest id are all responses, and so are smaller payloads and rows with null
    ids where no other has the payload. A null payload is empty; a null url is left out. Other columns aren't
    written. folder must be one that pyarrow can open and all executors share; each task writes under a name of its own and then renames,
    so a task that runs again replaces its own archive.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = materialise(keyed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first")).where(F.col("first").isNotNull()), "first-payloads")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    rows = keyed.join(firsts, "digest", "left").select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").alias("length"), F.col("digest"), F.when(revisit, F.col("first")).alias("refers_to"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        part = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        hidden, size, n = f"{root}/.{part}.{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(hidden) as out:
            for batch in parts:
                for name, url, body, length, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    kind = "response" if body is not None else "revisit"
                    made = _record(kind, name, url, body or b"", length, base64.b32encode(digest).decode(), refers_to, date, level)
                    out.write(made)
                    size += len(made)
                    n += 1
        if n:
            _put(store, hidden, f"{root}/{part}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{part}"]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])
        else:
            store.delete_file(hidden)

    return materialise(rows.mapInArrow(write, "path string, bytes bigint, records bigint"), "archives")


class _Source:
    """A file read from any place in steps, of which only the last step stays in memory."""

    def __init__(self, path: str, step: int = 1 << 20):
        store, name = _opened(path)
        self.file, self.step, self.at, self.held = store.open_input_file(name), step, 0, b""
        self.size = self.file.size()

    def read(self, at: int) -> bytes:
        """Some bytes from a place on, none at the end of the file."""
        if not self.at <= at < self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(self.step, max(0, self.size - at)), at)
        return self.held[at - self.at :]


def _looks_right(source: _Source, at: int) -> bool:
    unpacker, out = zlib.decompressobj(31), b""
    try:
        while len(out) < 5 and not unpacker.eof and (data := source.read(at)[:4096]):
            out += unpacker.decompress(data, 64)
            at += len(data)
    except zlib.error:
        return False
    return out.startswith(b"WARC/")


def _next_start(source: _Source, at: int, end: int) -> int | None:
    """The first validated member that starts at or after a place and before end."""
    while at < end:
        data = source.read(at)
        if len(data) < len(MAGIC):
            data += source.file.read_at(min(len(MAGIC), source.size - at - len(data)), at + len(data))
        found = data.find(MAGIC)
        if found < 0:
            if len(data) <= len(MAGIC) or at + len(data) >= source.size:
                return None
            at += len(data) - len(MAGIC) + 1
        elif at + found < end and _looks_right(source, at + found):
            return at + found
        else:
            at += found + 1
    return None


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The content of the member at a place and where it ends; None if it is broken."""
    unpacker, parts = zlib.decompressobj(31), []
    try:
        while not unpacker.eof:
            data = source.read(at)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            at += len(data) - len(unpacker.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), at


def _parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(END + END)
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    n = fields.get("content-length", "")
    return fields, rest[: int(n)] if n.isdigit() else rest


def read_range(path: str, start: int, end: int) -> Iterator[tuple]:
    """The records that start in a range of bytes, in the order of RECORD's columns; broken members are passed over."""
    source = _Source(path)
    at = _next_start(source, start, end)
    while at is not None:
        found = _member(source, at)
        if found is None or not found[0].startswith(b"WARC/"):
            at = _next_start(source, at + 1, end)
            continue
        fields, block = _parsed(found[0])
        kind = fields.get("warc-type")
        http, payload = {}, block
        if "application/http" in fields.get("content-type", ""):
            head, _, payload = block.partition(END + END)
            http = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]))
        if kind == "revisit":
            length, digest, payload = int(http.get("content-length") or 0), fields.get("warc-payload-digest", "").partition(":")[2], None
        else:
            length, digest = len(payload), _base32(payload)
        yield path, at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), length, digest, payload
        at = _next_start(source, found[1], end)


#: Bytes of a range that one task reads.
SPLIT = 128 << 20


def read_archives(archives: DataFrame, split_bytes: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, bytes): one row each, in RECORD's columns; payload is null for revisits or without with_payload.

    For responses payload_bytes and payload_digest (bare base32 SHA-1) come from the payload read, for revisits from the headers. Archives that are
    empty give no rows. Ranges are put in order and dealt one to a task whatever their archive, so a large archive is read by many tasks and none by two.
    """
    schema = RECORD

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for row in read_range(path, start, end):
                    rows.append(row if with_payload else (*row[:-1], None))
                    held += len(row[-1] or b"") if with_payload else 100
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    ranges = archives.where(F.col("bytes") > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")).select("path", "start", (F.col("start") + split_bytes).alias("end"))
    return deal(ranges).mapInArrow(read, schema)


def deal(ranges: DataFrame) -> DataFrame:
    """Rows (path, start, ...) of different places in partitions of one row each: by order, as hashes would put several into one."""
    return ranges.repartitionByRange(max(1, ranges.count()), "path", "start")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def list_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A table of (path, bytes) for archives that are already there."""
    rows = []
    for path in paths:
        store, name = _opened(path)
        rows.append((path, store.get_file_info(name).size))
    return spark.createDataFrame(rows, "path string, bytes bigint")


def page_ids(records: DataFrame) -> DataFrame:
    """What write_archives() was told about each record that read_archives() gives back."""

    def number(c: str) -> Column:
        return F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")

    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
