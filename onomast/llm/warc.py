"""WARC archives and their chunked record table.

``write`` appends a record per page to gzip archives (a member per record) in the
shared folder: a ``response`` with the page as HTTP payload, or a ``revisit`` of
the page with the largest id among equal payloads of at least ``least`` bytes.
``chunks`` reads archives as a table of record and chunk numbers: a record's
payload streams through a buffer of ``chunk_bytes``, each chunk is a row with the
SHA-1 of the payload up to its end, and no task ever holds a whole record.

Defined results: a null page is an empty payload; a null url is left out of the
record; pages with the same largest id and payload are all responses; where no
page of equal payloads has an id, all are responses; an empty table writes no
record; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm.files import create, dealt, stream
from onomast.sources.scratch import drop, scratch, written

_DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROLL = 256 << 20
_FLUSH = 8 << 20
_STEP = 1 << 20


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _head(page_id, url, size: int, digest: str, refers_to) -> bytes:
    """The WARC and HTTP header lines of a record; the payload follows."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _packed(head: bytes, payload: memoryview):
    """A record as pieces of one gzip member."""
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    yield packer.compress(head)
    for at in range(0, len(payload), _STEP):
        yield packer.compress(payload[at : at + _STEP])
    yield packer.compress(b"\r\n\r\n")
    yield packer.flush()


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, folder: str | None = None) -> DataFrame:
    """Write all pages to ``folder`` (in the shared folder if it is not given); returns the
    archives: (path, records)."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest")
    )
    # Revisits are told on ids and digests alone; pages meet them by id and digest, so a payload
    # that very many pages share is no hot key of whole pages.
    slim = written(rows.where(F.octet_length("html") >= least).select("page_id", "digest"), "digests", "slim")
    equal = slim.groupBy(F.col("digest").alias("equal")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = slim.join(equal, F.col("digest") == F.col("equal")).where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    revisits = written(revisits.select(F.col("page_id").alias("again"), "equal", "first").distinct(), "revisits")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("equal")), "left")
    folder = folder or scratch(spark, "warc")

    def run(batches):
        # One file an attempt and roll; only the rows of the attempt that counts name it.
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = create(path), 0, 0
                page_id, url, digest, refers_to = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                payload = memoryview(batch.column(2)[i].as_buffer() or b"")
                for part in _packed(_head(page_id, url, len(payload), digest, refers_to), payload if refers_to is None else payload[:0]):
                    out.write(part)
                    size += len(part)
                records += 1
                if size >= _ROLL:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

    out = rows.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to")).mapInArrow(run, "path string, records long")
    # Written as it comes: a shuffle of names that a rerun makes anew could lose some.
    return written(out, "archives", "all")


_CHUNK_FIELDS = [
    ("path", pa.string()),
    ("record_no", pa.int64()),
    ("record_id", pa.string()),
    ("record_type", pa.string()),
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("refers_to_id", pa.string()),
    ("refers_to", pa.int64()),
    ("declared_digest", pa.string()),
    ("chunk_no", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("data", pa.binary()),
    ("digest", pa.string()),
    ("last", pa.bool_()),
]
_CHUNK_SQL = (
    "path string, record_no long, record_id string, record_type string, page_id long, url string, refers_to_id string, "
    "refers_to long, declared_digest string, chunk_no long, start long, length long, data binary, digest string, last boolean"
)


def _fields(source) -> dict[str, str] | None:
    """Header lines up to the empty line; None at the end of the archive."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    fields = {"": line.rstrip().decode()}
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def read_chunks(path: str, chunk_bytes: int, with_data: bool = True):
    """Rows of the chunk table of one archive, in order; ``data`` is null if it is not wanted."""
    with stream(path) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
        number = 0
        while (head := _fields(unpacked)) is not None:
            left = int(head["content-length"])
            if head.get("content-type", "").startswith("application/http"):
                while left > 0:
                    line = unpacked.readline(left)
                    left -= len(line)
                    if line in (b"\r\n", b"\n", b""):
                        break
            number_of = lambda k: int(head[k]) if k in head else None
            common = (
                path, number, head.get("warc-record-id"), head.get("warc-type"), number_of("x-page-id"), head.get("warc-target-uri"),
                head.get("warc-refers-to"), number_of("x-refers-to-page"), head.get("warc-payload-digest", "").removeprefix("sha1:"),
            )
            digest, chunk_no, start = hashlib.sha1(), 0, 0
            while True:
                data = unpacked.read(min(chunk_bytes, left))
                if left and not data:
                    raise EOFError(f"{path} ends inside record {number}")
                left -= len(data)
                digest.update(data)
                yield (*common, chunk_no, start, len(data), data if with_data else None, digest.hexdigest(), left == 0)
                start += len(data)
                chunk_no += 1
                if not left:
                    break
            number += 1


def chunks(archives: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The record table of the archives in column ``path``: one row per chunk."""

    def table(rows) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _CHUNK_FIELDS, strict=True)], names=[n for n, _ in _CHUNK_FIELDS])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in read_chunks(path, chunk_bytes, with_data):
                    rows.append(row)
                    size += len(row[12] or b"") + 500
                    if size >= _FLUSH:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return dealt(archives.select("path")).mapInArrow(run, _CHUNK_SQL)


def records(archives: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row per record with size and digest of the full payload; a revisit takes
    them from the record it refers to."""
    ends = chunks(archives, chunk_bytes, False).where("last").select(
        "record_id", "record_type", "page_id", "url", "refers_to_id", "refers_to", "declared_digest",
        (F.col("start") + F.col("length")).alias("size"), "digest",
    )
    ends = written(ends, "records", "slim")
    full = ends.where("record_type = 'response'").groupBy(F.col("record_id").alias("origin"))
    full = full.agg(F.max("size").alias("full_size"), F.max("digest").alias("full_digest"))
    revisits = ends.where("record_type = 'revisit'").join(full, F.col("refers_to_id") == F.col("origin"), "left")
    columns = ["record_id", "record_type", "page_id", "url", "refers_to"]
    same = [F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), (F.col("digest") == F.col("declared_digest")).alias("intact")]
    other = [
        F.col("full_size").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"),
        F.coalesce(F.col("full_digest") == F.col("declared_digest"), F.lit(False)).alias("intact"),
    ]
    return ends.where("record_type <> 'revisit'").select(*columns, *same).unionByName(revisits.select(*columns, *other))


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Write the pages and read their records back; the archives go once they are read."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    found = records(write(pages, folder=folder, **kw))
    drop(spark, folder)
    return found
