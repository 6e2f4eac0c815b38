"""WARC archives as a chunked record table.

A page becomes one WARC record, or, where its payload is longer than a chunk, a
segmented one: rows of record identifier and segment number, each with a piece of the
payload and the digest of all pieces so far, so no task holds a whole record's archive
form. Spark's text writer makes real WARC files of these rows in any file system, and
its text reader, parting at the version line, reads them back; a payload that holds the
version line is cut inside it, so the line stands before records only. Pages with equal
payloads are stored once; the others become revisit records that name the record they refer to.
Record identifiers are made of page and payload, so a task that runs again writes the same.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import by_bytes, join_bounded, scratch, stored

VERSION = b"WARC/1.1\r\n"
#: Bytes of payload in one segment; shorter payloads than LEAST are never revisits.
CHUNK, LEAST = 1 << 16, 100
#: The date that all records bear, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def pieces(payload: memoryview, chunk: int = CHUNK) -> Iterator[bytes]:
    """The payload in pieces of `chunk` bytes at most, none of which holds the version line. An empty payload has one empty piece."""
    start, n = 0, len(payload)
    while True:
        piece = bytes(payload[start : start + chunk])
        # A version line may also begin at the piece's end and go on behind it.
        at = bytes(payload[start : start + chunk + len(VERSION) - 1]).find(VERSION)
        if at >= 0:
            piece = piece[: at + 1]
        yield piece
        start += len(piece)
        if start >= n:
            return


def record_id(*parts: object) -> str:
    """The identifier of a record, the same for the same parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _writer(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "html", "refers_to", "digest", "copy", "named"]
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, refers_to, digest, copy, named in zip(*(batch.column(c) for c in names), strict=True):
                page_id, refers_to, digest, copy = page_id.as_py(), refers_to.as_py(), digest.as_py(), copy.as_py()
                origin = record_id("page", page_id, digest, copy)
                target = " ".join((url.as_py() or "").split())
                head = f"WARC-Target-URI: {target}\r\nWARC-Date: {DATE}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n"
                if refers_to is not None:
                    origin = record_id("revisit", page_id, digest, copy)
                    of = f"WARC-Refers-To: {record_id('page', refers_to, digest, 0)}\r\nWARC-Refers-To-Date: {DATE}\r\n" if named.as_py() else ""
                    out.append(VERSION + f"WARC-Type: revisit\r\nWARC-Record-ID: {origin}\r\n{head}WARC-Payload-Digest: sha256:{digest}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n{of}X-Refers-To-Page: {refers_to}\r\nContent-Length: 0\r\n\r\n".encode())
                    continue
                payload, so_far, number, sent, blocks = memoryview(html.as_buffer() or b""), hashlib.sha256(), 0, 0, 0
                for piece in pieces(payload, chunk):
                    number += 1
                    so_far.update(piece)
                    sent += len(piece)
                    block = HTTP + piece if number == 1 else piece
                    blocks += len(block)
                    lines = ""
                    if number > 1 or sent < len(payload):  # a record of one piece is not a segmented one
                        lines = f"WARC-Segment-Number: {number}\r\nX-Running-Digest: sha256:{so_far.hexdigest()}\r\n"
                    if number == 1:
                        lines = f"WARC-Type: response\r\nWARC-Record-ID: {origin}\r\n{head}WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http; msgtype=response\r\n{lines}"
                    else:
                        last = f"WARC-Segment-Total-Length: {blocks}\r\n" if sent == len(payload) else ""
                        lines = f"WARC-Type: continuation\r\nWARC-Record-ID: {record_id('segment', page_id, digest, copy, number)}\r\nWARC-Segment-Origin-ID: {origin}\r\n{head}{lines}{last}"
                    out.append(VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block)
                    size += len(out[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write WARC files of pages(page_id, url, html) to the folder `path`.

    Of pages with equal payloads of at least `least` bytes, that with the smallest
    page_id is the response. A null html is empty; a null page_id is a response. Rows
    that repeat a page_id together with its payload are responses all.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    light = rows.where(F.octet_length("html") >= least).where("page_id is not null").select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = light.join(first, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # Rows that repeat page and payload are rare; they are told apart by where they stand.
    key = F.concat_ws("/", F.col("digest"), F.col("page_id").cast("string"))
    repeated = stored(rows.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", F.lit(True).alias("repeats")), "repeated")
    of = join_bounded(again.withColumn("_key", F.concat_ws("/", F.col("digest"), F.col("refers_to").cast("string"))), repeated, ["_key"])
    again = stored(of.select("page_id", "digest", "refers_to", F.col("repeats").isNull().alias("named")), "revisits")
    numbered = join_bounded(rows.withColumn("_key", key), repeated, ["_key"]).withColumn("copy", F.when(F.col("repeats"), F.monotonically_increasing_id() + 1).otherwise(0))
    named = join_bounded(numbered, again, ["page_id", "digest"])
    # A revisit's payload is not sent to the writer.
    html = F.when(F.col("refers_to").isNull(), F.col("html"))
    records = named.select("page_id", "url", html.alias("html"), "refers_to", "digest", "copy", F.coalesce("named", F.lit(False)).alias("named")).mapInArrow(_writer(chunk), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "value"):
        out = []
        for v in batch.column("value"):
            record = v.as_py()
            if record.startswith(VERSION):  # the first of a file
                record = record[len(VERSION) :]
            head, _, block = record.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
            size = int(fields["Content-Length"])
            if len(block) < size or block[size:].strip(b"\r\n"):
                raise ValueError(f"a record of another length than it states: {fields}")
            block, kind = block[:size], fields["WARC-Type"]
            if kind == "response":
                block = block.partition(b"\r\n\r\n")[2]
            number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
            out.append((fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"), size, number("X-Page-Id"), fields.get("WARC-Target-URI"), kind, number("X-Refers-To-Page"), fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, fields.get("X-Running-Digest", "").removeprefix("sha256:") or None, block))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


_FIELDS = [("record_id", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block_bytes", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("stated", pa.string()), ("running", pa.string()), ("data", pa.binary())]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of WARC files: record_id, segment (null where there is one alone), total (bytes of all content blocks, on the last), block_bytes, page_id, url, kind, refers_to, stated and running digests, data.

    Fields that a record's head lacks are null; records that repeat are read each; a folder of empty files gives no rows; a record
    of another length than it states is an error.
    """
    lines = spark.read.schema("value string").option("lineSep", "\n" + VERSION.decode()).text(path)
    schema = "record_id string, segment long, total long, block_bytes long, page_id long, url string, kind string, refers_to long, stated string, running string, data binary"
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, schema)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and digests of responses whose segments come one after the other; the state is one record's digest."""
    at, so_far, size, blocks, number, page, stated = None, hashlib.sha256(), 0, 0, 0, None, None
    for batch in batches:
        heads = batch.select(["record_id", "segment", "total", "block_bytes", "running", "stated", "page_id"]).to_pylist()
        done = []
        for r, d in zip(heads, batch.column("data"), strict=True):
            if r["record_id"] != at or r["segment"] is None:
                at, so_far, size, blocks, number, page, stated = r["record_id"], hashlib.sha256(), 0, 0, 0, r["page_id"], r["stated"]
            number += 1
            so_far.update(d.as_buffer())
            size += len(d.as_buffer())
            blocks += r["block_bytes"]
            if r["segment"] is not None and (r["segment"] != number or so_far.hexdigest() != r["running"]):
                raise ValueError(f"segment {number} of {at} is missing or damaged")
            if r["segment"] is None or r["total"] is not None:
                if (r["total"] or blocks) != blocks or stated != so_far.hexdigest():
                    raise ValueError(f"{at} isn't what its headers state")
                done.append((page, size, so_far.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest"])


def read_records(segments: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests are measured on the bytes read, and checked against the headers;
    a revisit has those of the record that it refers to. Only records of several
    segments are dealt out by their identifier. A null page_id stays null; records that
    repeat give a row each; a revisit of a record that is not there has null payload_bytes; without segments there are no rows.
    """
    measured = "page_id long, payload_bytes long, payload_digest string"
    held = segments.where("kind <> 'revisit'")
    short = held.where("segment is null")
    parts = held.where("segment is not null").repartition("record_id").sortWithinPartitions("record_id", "segment")
    responses = stored(short.mapInArrow(_measure, measured).union(parts.mapInArrow(_measure, measured)), "responses")
    revisits = segments.where("kind = 'revisit'").select("page_id", "refers_to", "stated")
    of = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), "payload_bytes").distinct()
    again = revisits.join(of, ["refers_to", "stated"], "left").select("page_id", "payload_bytes", F.col("stated").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def archive(pages: DataFrame, path: str | None = None, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write pages to WARC files and read the files back: the rows of read_records(). An empty table gives no rows."""
    spark = pages.sparkSession
    path = path or f"{scratch(spark)}/meridia/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, chunk, least)
    return read_records(read_segments(spark, path))


WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f"""
