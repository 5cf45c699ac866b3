"""Web archives with revisit records.

Headers (id, URL, payload digest, payload size) are shuffled by digest; of equal payloads
the one with the largest page_id is the response and the others revisit it. Pages are then
written as WARC 1.1 records with fresh headers by Spark's text writer, so that a lost
executor's attempt leaves nothing behind: a response holds the payload, a revisit names the
response. ``read_archives`` parses the files again, one record at a time.

A null html is an empty payload. A null page_id is the smallest and is written as an empty
id. Rows that repeat page_id and payload are one capture seen again: the first is what the
group decides and each further one revisits the response (itself, for the response's own).
Payloads below ``least_bytes`` are all responses. A null URL is written as empty.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import bounded_batches, in_batches, rows_of

#: Bytes of payload in one archive file, about.
FILE_BYTES = 48 << 20
#: The date of every record; a rerun writes the same archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: What a record begins with.
VERSION = "WARC/1.1"


def base32_of_hex(digest: Column) -> Column:
    """A SHA-1 in base 32: five hex digits are four of these."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page_id and payload: how often it comes, and the response it revisits."""
    html = F.coalesce("html", F.lit(""))
    headers = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.unhex(F.sha1(html.cast("binary"))).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.coalesce("url", F.lit("")).alias("url"),
    )
    rows = headers.groupBy("page_id", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"), F.min("url").alias("url"))
    last = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"))
    small = rows.where(F.col("bytes") < least_bytes).select("*", F.lit(None).cast("struct<page_id:bigint,url:string>").alias("last"))
    large = rows.where(F.col("bytes") >= least_bytes).join(last, "digest").select(*rows.columns, "last")
    return large.unionByName(small)


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}/{copy}"))


def write_record(page_id, url, html, refers_to, refers_url, response, copy) -> str:
    """A record without its last line break, which the text writer adds."""
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = HTTP.format(len(payload))
    block = http.encode() + payload if response else http.encode()
    lines = [
        VERSION,
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest, copy)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quoted(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if not response:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest, 0)}>",
            f"WARC-Refers-To-Target-URI: {quoted(refers_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode() + "\r\n"


def quoted(url: str | None) -> str:
    """A URL on one line of a header."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for page_id, url, html, copy, copies, last, least in rows_of(batches):
            refers_to, refers_url = (last["page_id"], last["url"]) if last else (None, None)
            response = last is None or (page_id == refers_to and copy == 0)
            yield (write_record(page_id, url, html, refers_to, refers_url, response, copy),)

    return in_batches(rows(), pa.schema([("value", pa.string())]), size=64)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write every row of ``pages`` (page_id, url, html) as a record below ``path``."""
    bounded_batches(pages.sparkSession)
    decided = decide(pages, least_bytes).select("page_id", "digest", "copies", "last")
    # A null id finds its decision like any other.
    key = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)))
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))
    joined = keyed.join(decided, (key("id") == key("page_id")) & (F.col("sha") == F.col("digest")) & F.col("id").eqNullSafe(F.col("page_id")))
    again = Window.partitionBy("id", "sha").orderBy("url")
    # Only rows that repeat need numbers; the others never meet in a window.
    once = joined.where("copies = 1").select("*", F.lit(0).alias("copy"))
    repeated = decided.where("copies > 1")
    rows = once
    if not repeated.isEmpty():
        rows = once.unionByName(joined.where("copies > 1").withColumn("copy", F.row_number().over(again) - 1))
    total = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes")).first()
    each = max(1, int(FILE_BYTES // max(1.0, (total["bytes"] or 0) / max(1, total["n"]))))
    records = rows.select("id", "url", "html", F.col("copy").cast("int"), "copies", "last", F.lit(least_bytes)).mapInArrow(_records, "value string")
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a byte stream, however it is cut."""
    buffer = b""

    def fill(enough) -> bool:
        nonlocal buffer
        more = [buffer]
        while not enough(more):
            piece = next(pieces, None)
            if piece is None:
                buffer = b"".join(more)
                return False
            more.append(piece)
        buffer = b"".join(more)
        return True

    def headed(parts: list[bytes]) -> bool:
        if len(parts) > 1:
            parts[:] = [b"".join(parts)]
        return b"\r\n\r\n" in parts[0]

    while fill(headed):
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"a record begins with {version[:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        length = int(headers["Content-Length"]) + 4
        if not fill(lambda parts: sum(map(len, parts)) >= length):
            raise ValueError("an archive ends inside a record")
        block, buffer = buffer[: length - 4], buffer[length:]
        yield headers, block


def _gunzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    while content:
        unzip = zlib.decompressobj(31)
        left = content
        while left and not unzip.eof:
            yield unzip.decompress(left, step)
            left = unzip.unconsumed_tail
        tail = unzip.flush()
        if tail:
            yield tail
        content = unzip.unused_data


READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string())]
    + [("refers_to", pa.int64()), ("refers_id", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())]
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x else None

    def rows():
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse_records(_gunzipped(content.as_py())):
                    payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} has another digest")
                    url = headers["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    yield (
                        number(headers["X-Page-Id"]), url, headers["WARC-Type"], digest, number(headers.get("X-Refers-To-Page-Id")),
                        headers.get("WARC-Refers-To"), headers["WARC-Record-ID"], payload,
                    )

    return in_batches(rows(), READ, size=64)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; payload is null for revisits."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(
        _parsed,
        "page_id long, url string, record_type string, payload_digest string, refers_to long, refers_id string, record_id string, payload binary",
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with the size of its payload; a revisit takes that of its response."""
    sized = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    responses = sized.where("record_type = 'response'")
    original = responses.select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("original_bytes"))
    revisits = sized.where("record_type = 'revisit'").join(original, "refers_id", "left")
    revisits = revisits.withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes")
    return responses.unionByName(revisits)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to a new folder of the shared one, read them back and resolve."""
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, least_bytes)
    return resolve_revisits(read_archives(pages.sparkSession, path))
