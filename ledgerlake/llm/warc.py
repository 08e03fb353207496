"""WARC archives: write pages as records, read archives, reassemble segments.

Writing. Each page makes one record. Of pages with equal payloads of
``min_revisit`` bytes or more, the one with the smallest ``page_id`` is the
response and the others are revisit records that refer to it. A response's
block is an HTTP message whose body has chunked transfer framing; a block
of more than ``segment_bytes`` is cut into a first record and continuation
records. Spark's text writer makes gzip files of at most ``records_per_file``
records; its line separator is the blank line pair that ends a WARC record.

Reading. A file is read by one task, as gzip files must be, and parsed as a
stream by Content-Length: one record is held at a time. Continuation
records are grouped by their origin's identifier, ordered by segment number
and checked (numbers without gaps, total length as declared) before the
chunked framing is decoded and the payload's digest verified. Only
segmented records are shuffled.

Defined results: a null html is an empty payload; a null url leaves out the
target header, and control characters in a url are dropped; rows with the
same ``page_id`` make a record each (if their payload is a repeated one and
theirs is the smallest id, each is a response); a null ``page_id`` is never
the smallest; an empty table makes an empty archive, which reads as no
records; other columns are not archived. A record cut short or with missing
segments comes back with ``complete`` false and what there is of its payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_arrow
from ledgerlake.session import ensure_checkpoint_dir

MIN_REVISIT = 100
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 10_000
#: Archives carry a fixed date: equal inputs make equal records.
RECORD_DATE = "2024-01-01T00:00:00Z"

VERSION = b"WARC/1.1"
RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, "
    "origin_id string, segment_number long, total_length long, framed boolean, block binary"
)
PAYLOAD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload binary, "
    "payload_bytes long, payload_digest string, complete boolean"
)


def _pieces(data: Column, size: int) -> Column:
    """Binary ``data`` in pieces of ``size`` bytes (one empty piece for none)."""
    last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / size)
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(data, (i * size + 1).cast("int"), F.lit(size)))


def _as_text(data: Column) -> Column:
    """The same bytes as a string; pieces may end inside a character."""
    return data.cast("string")


def _framed(html: Column) -> Column:
    """An HTTP message with ``html`` as a chunked body."""

    def chunk(piece: Column) -> Column:
        return F.concat(F.lower(F.hex(F.octet_length(piece))), F.lit("\r\n"), _as_text(piece), F.lit("\r\n"))

    body = F.when(html == "", F.lit("")).otherwise(
        F.array_join(F.transform(_pieces(html.cast("binary"), CHUNK_BYTES), chunk), "")
    )
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    return F.concat(F.lit(head), body, F.lit("0\r\n\r\n"))


def _record_id(page_id: Column, content: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.hex(content), F.lit(">"))


def page_id_of(record_id: Column) -> Column:
    """The page id inside a record id of ``write_warc`` (null if none)."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:([^:]*):", 1), F.lit("")).cast("long")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def warc_records(
    pages: DataFrame, min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """One row, ``value``, for each record of ``pages`` (``page_id``,
    ``url``, ``html``): headers, blank line and block."""
    ensure_checkpoint_dir(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest")).withColumn(
        "content", F.xxhash64("url", "digest")
    )
    candidate = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "content"))
    groups = (
        page.where(F.octet_length("html") >= min_revisit)
        .groupBy("digest")
        .agg(F.min(candidate).alias("first"), F.count(F.lit(1)).alias("n"))
    )
    # Written to the shared folder, so that both sides of the join are plain
    # exchanges and Spark can split a payload that very many pages share.
    repeated = groups.where("n > 1 AND first IS NOT NULL").select("digest", "first").checkpoint()
    known = page.join(repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    # Of a revisit only its headers are archived: its payload is the response's.
    seen = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
    block = F.when(
        revisit, F.concat(F.lit(seen), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    ).otherwise(_framed(F.col("html")))
    cut = known.select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
        _record_id(F.col("page_id"), F.col("content")).alias("id"),
        F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.content"))).alias("target"),
        F.regexp_replace("url", r"[\x00-\x1F\x7F]", "").alias("url"),
        "digest",
        block.cast("binary").alias("block"),
    ).select("*", F.octet_length("block").alias("total"), F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("at", "piece"))
    number = (F.col("at") + 1).cast("string")
    segmented = F.col("total") > segment_bytes
    last = (F.col("at") + 1) * segment_bytes >= F.col("total")
    head = F.col("at") == 0
    return cut.select(
        F.concat(
            F.lit(VERSION.decode() + "\r\n"),
            _header("WARC-Type", F.when(head, F.col("kind")).otherwise(F.lit("continuation"))),
            _header("WARC-Record-ID", F.when(head, F.col("id")).otherwise(F.concat(F.rtrim(F.col("id"), F.lit(">")), F.lit(":"), number, F.lit(">")))),
            _header("WARC-Date", F.lit(RECORD_DATE)),
            _header("WARC-Target-URI", F.when(head, F.col("url"))),
            _header("WARC-Refers-To", F.when(head, F.col("target"))),
            _header("WARC-Profile", F.when(head & (F.col("kind") == "revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            _header("WARC-Payload-Digest", F.when(head, F.concat(F.lit("sha256:"), F.col("digest")))),
            _header("WARC-Segment-Number", F.when(segmented, number)),
            _header("WARC-Segment-Origin-ID", F.when(segmented & ~head, F.col("id"))),
            _header("WARC-Segment-Total-Length", F.when(segmented & last, F.col("total").cast("string"))),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            _header("Content-Length", F.octet_length("piece").cast("string")),
            F.lit("\r\n"),
            _as_text(F.col("piece")),
        ).alias("value")
    )


def write_warc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    """Archive ``pages`` as gzip files in the folder ``path``, which must be
    one that all executors reach."""
    (
        warc_records(pages, **options)
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes, bool]]:
    """(headers by lower-case name, block, whether it has its full length)
    of each record; a record cut off by the end of the stream comes last."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get(b"content-length", b"0"))
        block = stream.read(length)
        yield headers, block, len(block) == length


def _read_file(content: bytes) -> Iterator[dict]:
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    for headers, block, full in parse_records(stream):
        text = {k: v.decode("utf-8", "replace") for k, v in headers.items()}
        number = text.get(b"warc-segment-number")
        total = text.get(b"warc-segment-total-length")
        yield {
            "record_id": text.get(b"warc-record-id"),
            "record_type": text.get(b"warc-type"),
            "target_uri": text.get(b"warc-target-uri"),
            "refers_to": text.get(b"warc-refers-to"),
            "declared_digest": text.get(b"warc-payload-digest"),
            "origin_id": text.get(b"warc-segment-origin-id"),
            "segment_number": int(number) if number else None,
            "total_length": int(total) if total else None,
            "framed": full,
            "block": block,
        }


def _batched(rows: Iterator[dict], size, schema: pa.Schema, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if held_bytes >= limit or len(held) >= 5_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records, segments apart, of the archives in the folder ``path``."""
    bounded_arrow(spark)
    schema = _arrow_schema(RECORD_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for content in b.column(0) for row in _read_file(content.as_py()))
        yield from _batched(rows, lambda r: len(r["block"]), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their continuations joined to them: the same columns
    without the segment ones, plus ``complete``."""
    kept = ["record_id", "record_type", "target_uri", "refers_to", "declared_digest"]
    whole = records.where("segment_number IS NULL").select(*kept, "block", F.col("framed").alias("complete"))
    heads = records.where("segment_number = 1").select(*kept, "block", "framed")
    rest = (
        records.where("segment_number > 1")
        .groupBy(F.col("origin_id").alias("record_id"))
        .agg(F.array_sort(F.collect_list(F.struct("segment_number", "block", "total_length", "framed"))).alias("parts"))
        # Repeated pages have the same segments under the same identifier.
        .withColumn(
            "parts",
            F.filter("parts", lambda p, i: (i == 0) | (p["segment_number"] != F.col("parts")[F.greatest(i - 1, F.lit(0))]["segment_number"])),
        )
    )
    parts = F.coalesce(F.col("parts"), F.array().cast("array<struct<segment_number:bigint,block:binary,total_length:bigint,framed:boolean>>"))
    joined = F.aggregate(parts, F.col("block"), lambda acc, p: F.concat(acc, p["block"]))
    numbers = F.transform(parts, lambda p: p["segment_number"])
    ordered = numbers == F.when(F.size(parts) > 0, F.sequence(F.lit(2).cast("long"), F.size(parts).cast("long") + 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    declared = F.element_at(F.transform(parts, lambda p: p["total_length"]), -1)
    framed = F.col("framed") & F.forall(parts, lambda p: p["framed"])
    complete = F.when(F.size(parts) == 0, F.lit(False)).otherwise(
        F.coalesce(ordered & (F.octet_length(joined) == declared) & framed, F.lit(False))
    )
    segmented = heads.join(rest, "record_id", "left").select(*kept, joined.alias("block"), complete.alias("complete"))
    return whole.unionByName(segmented)


def dechunk(body: bytes) -> tuple[bytes, bool]:
    """The payload in a chunked body, and whether the framing was whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return b"".join(out), False
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out), False
        if size == 0:
            return b"".join(out), True
        piece = body[end + 2 : end + 2 + size]
        out.append(piece)
        at = end + 2 + size + 2
        if len(piece) < size or body[at - 2 : at] != b"\r\n":
            return b"".join(out), False


def decode_http(block: bytes) -> tuple[bytes, dict[bytes, bytes], bool]:
    """Payload, headers by lower-case name, and whether it is whole. A
    block that is no HTTP message is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block, {}, True
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower()] = value.strip()
    if headers.get(b"transfer-encoding", b"").lower() == b"chunked":
        payload, whole = dechunk(body)
        return payload, headers, whole
    return body, headers, True


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Reassembled and decoded records of the archives in ``path``.

    A revisit has no payload; its length and digest are the declared ones.
    ``complete`` is false for a record whose segments, framing or digest
    are not whole."""
    schema = _arrow_schema(PAYLOAD_SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                payload, headers, whole = decode_http(r["block"])
                declared = (r["declared_digest"] or "").removeprefix("sha256:")
                out = {k: r[k] for k in ("record_id", "record_type", "target_uri", "refers_to")}
                if r["record_type"] == "revisit":
                    length = headers.get(b"content-length", b"")
                    out |= {"payload": None, "payload_bytes": int(length) if length.isdigit() else None,
                            "payload_digest": declared, "complete": r["complete"]}
                else:
                    digest = hashlib.sha256(payload).hexdigest()
                    out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest,
                            "complete": r["complete"] and whole and declared in ("", digest)}
                yield out

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches), lambda r: len(r["payload"] or b""), schema)

    return reassemble(read_records(spark, path)).mapInArrow(decode, PAYLOAD_SCHEMA)
