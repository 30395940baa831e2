"""WARC archives: one gzip member per record, written through Spark's own sinks and read back sequentially.

Archives are written with the text sink from ready-made bytes, so they land on whatever file system the folder names.
That sink ends each value with a separator, for which the last byte of a gzip member serves: the top byte of its
length field, which is zero for every member below 16 MiB. Larger payloads are cut into continuation segments.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
SEGMENT_BYTES = 8 << 20
INFLATE_BYTES = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"


def label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member holding one record."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: {label(block)}",
             f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def clean_url(url: str | None) -> str:
    """A header value on one line: control characters and white space are percent-encoded."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def members(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> list[bytes]:
    """The members of one page: a response (in segments if large), or a revisit that carries no payload.

    A null page_id is an empty header.
    """
    common = [("WARC-Target-URI", clean_url(url)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("X-Page-Id", "" if page_id is None else str(page_id)),
              ("WARC-Payload-Digest", label(payload)), ("X-Payload-Length", str(len(payload)))]
    http = HTTP % len(payload)
    if refers_to is not None:
        return [member([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), *common,
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)),
                        ("Content-Type", "application/http; msgtype=response")], http)]
    block = http + payload
    cuts = range(0, len(block), SEGMENT_BYTES)
    if len(cuts) == 1:
        return [member([("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), *common,
                        ("Content-Type", "application/http; msgtype=response")], block)]
    out = []
    for number, at in enumerate(cuts, 1):
        kind = [("WARC-Type", "response" if number == 1 else "continuation"),
                ("WARC-Record-ID", record_id(page_id) if number == 1 else f"{record_id(page_id)[:-1]}-{number}>"),
                ("WARC-Segment-Number", str(number))]
        if number > 1:
            kind.append(("WARC-Segment-Origin-ID", record_id(page_id)))
        if at == cuts[-1]:
            kind.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(member([*kind, *common, ("Content-Type", "application/http; msgtype=response")],
                          block[at:at + SEGMENT_BYTES]))
    return out


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class Reader:
    """Reads records one after another; at most one of them is held inflated."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)

    def inflated(self) -> Iterator[bytearray]:
        """The content of each gzip member, inflated piece by piece."""
        at = 0
        while at < len(self.data):
            engine, out = zlib.decompressobj(31), bytearray()
            while not engine.eof:
                chunk = self.data[at:at + INFLATE_BYTES]
                if not len(chunk):
                    raise ValueError("archive ends inside a record")
                out += engine.decompress(chunk)
                at += len(chunk)
            at -= len(engine.unused_data)
            yield out

    def __iter__(self) -> Iterator[Record]:
        for raw in self.inflated():
            head, found, _ = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not found or not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            begin, size = len(head) + 4, int(headers["Content-Length"])
            block = bytes(raw[begin:begin + size])
            if len(block) != size or raw[begin + size:] != b"\r\n\r\n":
                raise ValueError("content length does not frame the record")
            if label(block) != headers["WARC-Block-Digest"]:
                raise ValueError("block digest differs")
            yield Record(headers, block)


def pages_of(records: Iterator[Record]) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) per page; segments are joined.

    The payload digest of every response is checked; a revisit has no payload of its own.
    """
    held: list[Record] = []
    for record in records:
        held.append(record)
        h = record.headers
        if "WARC-Segment-Number" in h and "WARC-Segment-Total-Length" not in h:
            continue
        first, block = held[0].headers, b"".join([r.block for r in held])
        held = []
        if "WARC-Segment-Total-Length" in h and int(h["WARC-Segment-Total-Length"]) != len(block):
            raise ValueError("segments are missing")
        payload = block.partition(b"\r\n\r\n")[2]
        number, kind = first["X-Page-Id"], first["WARC-Type"]
        page = int(number) if number else None
        if kind == "response" and (label(payload) != first["WARC-Payload-Digest"] or len(payload) != int(first["X-Payload-Length"])):
            raise ValueError("payload digest differs")
        refers = int(first["X-Refers-To-Page"]) if kind == "revisit" else None
        yield (page, int(first["X-Payload-Length"]), hex_digest(first["WARC-Payload-Digest"]), kind, refers,
               first["WARC-Target-URI"], payload if kind == "response" else None)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and refers_to: the page that holds the payload, null for responses.

    Of equal payloads of at least MIN_REVISIT_BYTES, the largest page_id is kept. Only digests are shuffled to find
    it, folded in each task first; repeated page_ids are all written. A null page_id is never referred to and always a
    response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= MIN_REVISIT_BYTES
    digests = rows.where(large).groupBy(F.sha2("html", 256).alias("_digest")).agg(
        F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # Small payloads have keys of their own, so that they do not meet in one task.
    keyed = rows.withColumn("_key", F.when(large, F.sha2("html", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id"))))
    joined = keyed.join(digests, keyed["_key"] == digests["_digest"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("_kept") != F.col("page_id"), F.col("_kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes a record for each row, one archive for each task of the join that finds the revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = []
                for page_id, url, html, refers in zip(*[c.to_pylist() for c in part.columns]):
                    made += members(page_id, url, (html or "").encode(), refers)
                # The sink's separator is the last byte of each member.
                yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], ["value"])

    packed = with_revisits(pages).mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Reads every archive of a folder, verifying lengths and digests; a damaged record stops the read.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and on request the payload of
    responses. An empty folder gives no rows.
    """
    fields = [pa.field("page_id", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string()),
              pa.field("record_type", pa.string()), pa.field("refers_to", pa.int64()), pa.field("url", pa.string()),
              pa.field("payload", pa.binary())]
    kept = fields if payloads else fields[:-1]
    target = pa.schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for row in pages_of(iter(Reader(content.as_buffer()))):
                    rows.append(row[:len(kept)])
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kept)], schema=target)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kept)], schema=target)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, schema + (", payload binary" if payloads else ""))
