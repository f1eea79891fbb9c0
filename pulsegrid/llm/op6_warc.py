"""WARC archives: writer with revisit records, and a splittable reader.

*Writer.*  Payload digests are taken in the engine; the smallest id per digest is
an aggregate, combined on the map side.  A page that is not the smallest of its
digest refers to it.  Each task writes archives of about ``ARCHIVE_BYTES`` with
one gzip member per record, under names that no other attempt uses; the table of
the files of successful attempts is the archive's index, so the files of lost or
repeated attempts are never read.

*Reader.*  Files are cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate as a member only if it inflates to a WARC header, owns the
records that start inside the range, and reads past its end to finish the last
one.  From a valid member it goes on at that member's end.

*Damage.*  Bytes between the end of a record and the next valid one, or before a
file's first, belong to no record.  The task of the record before them (of the
file's start) finds how far they reach, past its range if need be, so each stretch is
met once: it is an error, or one row of type ``damaged`` with its place and length.
A file shorter than its index says is an error.

*Foreign records.*  Any record type and id is read.  ``page_id`` is null unless the
id is one of the writer's; payloads of types other than response and revisit are
their blocks, and a missing digest is computed.

Archives lie in the shared folder and are opened by URI through Arrow's file
systems, in tasks only.

Edge cases: a null payload is empty.  Rows that repeat an id and payload are
all responses if theirs is the smallest id.  A null id is larger than any
other; it is written as an empty name and read back as null.  Payloads are UTF-8 and of any length;
a record larger than a range is owned by the range it starts in.  An empty table
gives an empty archive and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_dir
from .rows import table, written

MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
CHUNK = 1 << 18
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, size long, records long"


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member; a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<{NAME}{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def with_references(pages: DataFrame, payload: str, id_col: str, url: str | None, min_bytes: int) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)``."""
    body = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(
        pages[id_col].cast("long").alias("page_id"), (pages[url].cast("string") if url else F.lit(None).cast("string")).alias("url"), body.alias("payload")
    )
    narrow = keyed.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # only pages that revisit another one, one row per id and digest
    again = (
        narrow.join(first, "digest").where("first is not null and (page_id is null or page_id <> first)")
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    )
    again = written(again, "revisits")
    match = keyed["page_id"].eqNullSafe(again["p"]) & (F.unhex(F.sha1(keyed["payload"])) == again["d"])
    return keyed.join(again, match, "left").select("page_id", "url", "payload", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))


def write_archives(
    pages: DataFrame, folder: str, payload: str = "html", id_col: str = "page_id", url: str | None = "url",
    min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes the archives below ``folder`` and returns their index, a written table ``(path, size, records)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                member = record(*(batch.column(c)[i].as_py() for c in range(5)))
                if out is None:
                    path, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            cols = list(zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p in cols[0]]), pa.array(cols[1]), pa.array(cols[2])], names=["path", "size", "records"])

    return written(with_references(pages, payload, id_col, url, min_revisit_bytes).mapInArrow(run, INDEX), "warc-index")


def byte_ranges(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, size, start, stop)``; every byte of every archive lies in one range."""
    starts = index.where("size > 0").select("path", "size", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return starts.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))


class Window:
    """Bytes of a file from a moving position, read in chunks."""

    def __init__(self, file, at: int, size: int):
        self.file, self.size, self.base, self.data = file, size, at, b""

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        got = self.file.read(min(CHUNK, self.size - at))
        if not got:
            raise ValueError(f"the archive ends at {at}, its index says {self.size}")
        self.data += got
        return True

    def drop(self, upto: int) -> None:
        if upto > self.base:
            self.data, self.base = self.data[upto - self.base :], max(upto, self.base)

    def find_magic(self, at: int, stop: int) -> int | None:
        """First place of the magic from ``at`` that begins before ``stop``."""
        while True:
            hit = self.data.find(MAGIC, at - self.base)
            if hit >= 0:
                return self.base + hit if self.base + hit < stop else None
            at = max(at, self.base + len(self.data) - len(MAGIC) + 1)
            if at >= stop or not self.more():
                return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The inflated member at ``at`` and its end; None unless it is a whole member with a WARC header."""
        inflate, parts, pos, checked = zlib.decompressobj(31), [], at, False
        while not inflate.eof:
            if pos >= self.base + len(self.data) and not self.more():
                return None
            chunk = self.data[pos - self.base : pos - self.base + CHUNK]
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error:
                return None
            pos += len(chunk)
            if not checked and (inflate.eof or sum(map(len, parts)) >= 6):
                checked = True
                if not b"".join(parts).startswith(b"WARC/1"):
                    return None
        return b"".join(parts), pos - len(inflate.unused_data)


    def next_member(self, at: int, stop: int) -> tuple[int, bytes, int] | None:
        """Start, content and end of the first valid member from ``at`` that begins before ``stop``."""
        while (hit := self.find_magic(at, stop)) is not None:
            found = self.member(hit)
            if found is not None:
                return hit, *found
            at = hit + 1
        return None


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes
    full: int  # bytes of the payload, also where a revisit leaves it out


def parse(member: bytes) -> Record:
    """Lower-cased WARC headers and the payload of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, colon, value in lines if colon}
    block = rest[: int(fields.get("content-length", len(rest)))]
    if fields.get("warc-type") not in ("response", "revisit") or not fields.get("content-type", "").startswith("application/http"):
        return Record(fields, block, len(block))
    http, _, payload = block.partition(b"\r\n\r\n")
    named = re.search(rb"(?mi)^content-length:\s*([0-9]+)\s*$", http)
    return Record(fields, payload, int(named.group(1)) if named else len(payload))


def read_archives(index: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False, damaged: str = "fail") -> DataFrame:
    """One row per record: ids, type, payload length and digest, what it refers to, its place[, the payload].

    ``damaged``: ``"fail"`` raises on bytes that belong to no record, ``"rows"``
    reports each stretch as a row of type ``damaged``, whose length is ``payload_bytes``.
    """
    if damaged not in ("fail", "rows"):
        raise ValueError(f"damaged is 'fail' or 'rows', not {damaged!r}")
    schema = (
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, path string, at long"
        + (", payload binary" if payloads else "")
    )
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def number(name: str | None) -> int | None:
        own = (name or "").strip("<>")
        found = own.removeprefix(NAME) if own.startswith(NAME) else ""
        return int(found) if found.removeprefix("-").isdigit() else None

    def row(path: str, at: int, content: bytes) -> tuple:
        r = parse(content)
        digest, kind = r.fields.get("warc-payload-digest", "").removeprefix("sha1:"), r.fields.get("warc-type", "")
        own = r.fields.get("warc-record-id", "").strip("<>").startswith(NAME)
        if own and kind == "response" and (len(r.payload) != r.full or payload_digest(r.payload) != digest):
            raise ValueError(f"{path} at {at}: payload differs from its digest")
        full = r.full if kind == "revisit" else len(r.payload)
        return (
            number(r.fields.get("warc-record-id")), r.fields.get("warc-target-uri"), kind, full, digest or payload_digest(r.payload),
            number(r.fields.get("warc-refers-to")), r.fields.get("warc-record-id"), path, at, r.payload,
        )

    def gap(path: str, at: int, end: int) -> tuple:
        if damaged == "fail":
            raise ValueError(f"{path}: {end - at} bytes at {at} belong to no record")
        return None, None, "damaged", end - at, None, None, None, path, at, None

    def rows_of(path: str, size: int, start: int, stop: int) -> Iterator[tuple]:
        fs, name = located(path)
        with fs.open_input_file(name) as file:
            window = Window(file, start, size)
            after = 0 if start == 0 else None  # where the next record must begin, once that is known
            at = start
            while (found := window.next_member(at, stop)) is not None:
                hit, content, end = found
                if after is not None and hit > after:
                    yield gap(path, after, hit)
                yield row(path, hit, content)
                at = after = end
                window.drop(at)
            # the next record begins right there, in this range or behind it, or else the stretch is damaged
            if after is not None and after < size and (after < stop or window.member(after) is None):
                beyond = window.next_member(max(after, stop), size)
                if beyond is None or beyond[0] > after:
                    yield gap(path, after, beyond[0] if beyond else size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows: list[tuple] = []
                held = 0
                for r in rows_of(*source):
                    rows.append(r[: len(arrow)])
                    held += len(r[-1] or b"") if payloads else 0
                    if len(rows) >= 4096 or held > CHUNK * 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    ranges = byte_ranges(index, range_bytes)
    tasks = max(1, ranges.count())
    spread = ranges.repartitionByRange(min(tasks, max(index.sparkSession.sparkContext.defaultParallelism * 4, 64)), "path", "start")
    return spread.mapInArrow(run, schema)


def record_counts(index: DataFrame, records: DataFrame) -> DataFrame:
    """``(path, records, found)`` of the archives whose index says another number of records than were read."""
    found = records.where("record_type <> 'damaged'").groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    return index.join(found, "path", "left").select("path", "records", F.coalesce("found", F.lit(0)).alias("found")).where("records <> found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
