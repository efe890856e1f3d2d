"""Operator 4, WARC: write one record per page, one gzip member per record, and read archives back by byte ranges.

Reading is splittable without an index. A task owns the records that start inside its byte range: it scans for
the gzip magic, takes a candidate as a member only if it decodes to a WARC header (and, on reading on, to its
checksum), and then goes from member to member until one starts at or beyond the range's end. A damaged member
is stepped over by scanning on for the next one. Memory: one record and a read buffer.

Records: a page's payload is its html in UTF-8 (null: empty). Of records with equal payloads of at least
`least` bytes the one with the largest page_id is the response, the others are revisits that refer to it and
carry no payload; rows that repeat that largest page_id are responses too. A null page_id is below all others
(rows with no other copy are responses). A null url gives no target header. A very long page is one record like
others and is held whole by the task that writes or reads it. An empty table gives no archive and no rows. Only
page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm.common import filesystem, slices, work_dir

LEAST = 1000
RANGE_BYTES = 16 << 20
CHUNK = 256 << 10
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit's block ends after the HTTP header."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    lines.append(f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> list[tuple[str, int]]:
    """Write (page_id, url, html) rows as archives, one per task; returns (file, bytes). A file whose task is run again is not listed."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # Short payloads have no copies to look for: they stay out of the join, where they would all share one key.
    short = rows.where(F.octet_length("html") < least).withColumn("refers_to", F.lit(None).cast("bigint"))
    rows = rows.where(F.octet_length("html") >= least).withColumn("digest", F.sha1("html"))
    copies = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(copies, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"))
    joined = joined.unionByName(short)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, size = None, "", 0
        for part in slices(batches, "html"):
            if sink is None:
                store, path = filesystem(folder)
                store.create_dir(path, recursive=True)
                name = f"pages-{uuid.uuid4().hex}.warc.gz"
                sink = store.open_output_stream(f"{path}/{name}", compression=None)
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url, html.encode(), refers_to, date)) + pack.flush()
                sink.write(member)
                size += len(member)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "size": [size]})

    return [(r["file"], r["size"]) for r in joined.mapInArrow(write, "file string, size bigint").collect()]


def members(source, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each gzip member with a WARC record that starts in [begin, end)."""
    at: int | None = begin
    size = source.size()
    while at is not None and at < min(end, size):
        found = _member(source, at, size)
        if found is None:  # not at a member, or at a damaged one: scan on
            at = _next_magic(source, at + 1, end, size)
        else:
            yield at, found[0]
            at = found[1]


def _next_magic(source, at: int, end: int, size: int) -> int | None:
    """Place of the next gzip magic that starts in [at, end)."""
    while at < end:
        source.seek(at)
        data = source.read(min(CHUNK, size - at))
        k = data.find(MAGIC)
        if k >= 0:
            return at + k if at + k < end else None
        if len(data) < CHUNK:
            return None
        at += len(data) - 2
    return None


def _member(source, at: int, size: int) -> tuple[bytes, int] | None:
    """Decode the member at a place: (content, place behind it); None if it isn't a WARC record's."""
    source.seek(at)
    unpack = zlib.decompressobj(31)
    out, seen, place = [], b"", at
    try:
        while not unpack.eof:
            data = source.read(min(CHUNK, size - place))
            if not data or (place == at and not data.startswith(MAGIC)):
                return None
            place += len(data)
            got = unpack.decompress(data)
            if len(seen) < 7:
                seen += got[:7]
                if not b"WARC/1."[: len(seen)] == seen[:7]:
                    return None
            out.append(got)
    except zlib.error:
        return None
    return (b"".join(out), place - len(unpack.unused_data)) if len(seen) >= 7 else None


def parse(content: bytes) -> dict | None:
    """A record's fields; None for other record types. Checks the payload of a response against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)content-length: (\d+)", http)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload in {fields.get('WARC-Record-ID')}")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload_digest": digest,
        "payload_bytes": int(said[1]) if said else len(payload),
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, folder: str, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Read archives by byte ranges of about `range_bytes`; the payload comes along if asked for."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for batch in batches:
            for name, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    rows: list[dict] = []
                    for _, content in members(source, begin, begin + range_bytes):
                        if (row := parse(content)) is not None:
                            rows.append(row)
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=False))))
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=False))))

    schema = SCHEMA if with_payload else SCHEMA.removesuffix(", payload binary")
    if not files:
        return spark.createDataFrame([], schema)
    tasks = sum(-(-size // range_bytes) for _, size in files)
    starts = spark.createDataFrame(files, "file string, size bigint").select("file", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("begin"))
    return starts.repartition(max(1, tasks)).mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = LEAST, with_payload: bool = False) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{work_dir(spark)}/warc"
    return read_archives(spark, folder, write_archives(pages, folder, least), with_payload=with_payload)
