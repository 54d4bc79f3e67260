"""WARC archives: writing captures, reading records, assembling transactions.

Writing: each capture gives a request, a response (or a revisit, if an equal
payload is archived already) and a metadata record, tied by WARC-Concurrent-To.
Which captures are revisits is found by a grouped minimum over payload digests,
reduced before it is shuffled; only digests that repeat are joined back, so pages
aren't shuffled where few repeat (Spark broadcasts that table if it is small, and
else splits skewed partitions of the join). The text sink writes the records with
the format's own record end as line separator.

A record's id follows from its page and payload, so that a revisit can name the
response that it refers to, wherever that is written.

Reading: archive files are parsed by Content-Length and each response's payload
digest is verified. Assembly joins the records by concurrent-to identifiers and
gives one nested row for each capture.

Cases: null html is an empty payload; null urls get a URN; repeated rows are
captured as often as they occur (of one page with one payload, all are
responses, under the same record ids); a payload of 2 GB or more is no value of
a row in Spark; an empty table gives no rows; further columns are ignored; a record
that is cut off, or whose digest is wrong, raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import arrow_schema, record_batch, text_or_empty
from fieldglass.store import stored

#: Fixed values of the format (WARC 1.1).
VERSION, LINE, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE, FILE_BYTES = 30_000, 64 << 20
PIECE = 1 << 20
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, digest string, payload_bytes bigint, http_headers string, payload binary, fields string"


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block.encode())}"]
    return LINE.join(lines) + RECORD_END + block


def _safe_uri(url: str | None, page: int | None) -> str:
    """The url with white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def capture_id(page: int | None, digest: str) -> str:
    """The id of the capture of a page with a payload of that digest."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}"


def capture_records(page: int | None, url: str | None, html: str, first: int | None) -> Iterator[str]:
    """The three records of one capture; ``first`` is the page whose response it revisits, if any."""
    uri, payload = _safe_uri(url, page), html.encode()
    digest = digest_of(payload)
    capture = capture_id(page, digest)
    about = ("WARC-Concurrent-To", f"<{capture}>")
    head = LINE.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}")) + RECORD_END
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        yield _record("response", capture, common, head + html)
    else:
        yield _record("revisit", capture, [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{capture_id(first, digest)}>")], head)
    path = re.sub(r"^[a-z]+://[^/]*", "", uri) or "/"
    yield _record("request", f"{capture}-q", [("WARC-Target-URI", uri), about, ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1{RECORD_END}")
    yield _record("metadata", f"{capture}-m", [("WARC-Target-URI", uri), about, ("Content-Type", "application/warc-fields")], f"page: {'' if page is None else page}{LINE}")


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """digest (hex) and smallest page_id of every payload that more than one row has."""
    html = text_or_empty("html").cast("binary")
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html).alias("hex"), F.octet_length(html).alias("size"))
    groups = keyed.filter(F.col("size") >= least_bytes).groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return groups.filter(F.col("n") > 1).select("hex", "first")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int | None = None, compression: str = "gzip") -> None:
    """Write the captures of ``pages`` (page_id, url, html) as WARC files under ``path``.

    Payloads of at least ``least_bytes`` bytes that occur before (in order of
    page_id) become revisits. A file holds at most ``records_per_file`` records, by
    default as many as have FILE_BYTES at the mean size of a page.
    """
    html = text_or_empty("html")
    if records_per_file is None:
        mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 0
        records_per_file = max(3, min(RECORDS_PER_FILE, int(3 * FILE_BYTES / (mean + 1000))))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("hex"))
    repeats = stored(first_pages(pages, least_bytes), "repeats")
    joined = rows.join(repeats, "hex", "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                out += capture_records(*row)
                size += len(row[2])
                if size >= PIECE:
                    yield record_batch({"value": out}, "value string")
                    out, size = [], 0
            yield record_batch({"value": out}, "value string")

    joined.mapInArrow(run, "value string").write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"WARC: no record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            name, colon, value = line.decode().partition(":")
            if not colon:
                raise ValueError(f"WARC: no header: {line[:40]!r}")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) < size:
            raise ValueError("WARC: the last record is cut off")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    name = lambda key: headers[key].strip("<>") if key in headers else None
    kind, digest, size, http, payload, fields = headers["warc-type"], None, None, None, None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        digest = headers["warc-payload-digest"].partition(":")[2]
        if kind == "response":
            size = len(payload)
            if digest_of(payload) != digest:
                raise ValueError(f"WARC: the payload of {headers['warc-record-id']} has another digest")
        else:
            size, payload = int(re.search(r"(?im)^content-length:\s*(\d+)", http)[1]), None
        payload = payload if with_payload else None
    elif kind == "request":
        http = block.decode("utf-8", "replace")
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    return (name("warc-record-id"), kind, name("warc-concurrent-to"), name("warc-refers-to"), headers.get("warc-target-uri"), digest, size, http, payload, fields)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the WARC files (plain or gzip) under ``path``.

    Without ``with_payload`` payloads are verified and then left out.
    """
    names = arrow_schema(RECORD).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                stream = io.BytesIO(raw)
                if bytes(raw[:2]) == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
                rows, size = [], 0
                for headers, block in parse_records(stream):
                    rows.append(_row(headers, block, with_payload))
                    size += 500 + len(block) * with_payload
                    if size >= PIECE:
                        yield record_batch(dict(zip(names, zip(*rows, strict=True), strict=True)), RECORD)
                        rows, size = [], 0
                if rows:
                    yield record_batch(dict(zip(names, zip(*rows, strict=True), strict=True)), RECORD)

    return spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: its response or revisit with its request and metadata nested.

    Requests and metadata belong to the record that their concurrent-to names; a
    capture without any of them has nulls there, and of several the one with the
    smallest record id counts.
    """
    side = F.struct("record_id", "target_uri", "http_headers", "fields")
    about = (
        records.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("capture_id"))
        .agg(F.min(F.when(F.col("record_type") == "request", side)).alias("request"), F.min(F.when(F.col("record_type") == "metadata", side)).alias("metadata"))
    )
    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "record_type", "target_uri", "refers_to", F.struct("digest", "payload_bytes", "http_headers", "payload").alias("response")
    )
    return captures.join(about, "capture_id", "left")
