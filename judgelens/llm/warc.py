"""WARC archives with revisit records: payloads are stored once.

``write_archives`` reads the payload digests, shuffles these headers by digest, and writes each
payload of a group of equal ones once, as a response record; the others become revisit records that
refer to it, all with fresh headers. ``read_archives`` parses the files by Content-Length;
``resolve_revisits`` joins revisit records to their original responses.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.llm.common import batched, text_rows

#: Payloads below this many bytes are always stored.
MIN_PAYLOAD = 100
#: Bytes of records in one archive file, about.
FILE_BYTES = 16 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
RECORD_END = CRLF + CRLF


def payload_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest): the headers that are shuffled in place of payloads."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha2(payload, 256).alias("payload_digest"))


def originals(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_url) of the rows that revisit an earlier page.

    The smallest id of each digest is a grouped minimum, combined before the shuffle. Headers of a
    digest that many pages share meet it in a join, whose skewed side Spark splits."""
    big = headers.filter(F.col("payload_bytes") >= min_payload)
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("least")
    first = (big.groupBy("payload_digest").agg(least, F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("payload_digest", F.col("least.page_id").alias("refers_to"), F.col("least.url").alias("refers_url")))
    return (big.select("page_id", "payload_digest").join(first, "payload_digest")
            .filter("page_id > refers_to").select("page_id", "payload_digest", "refers_to", "refers_url").distinct())


def records(pages: DataFrame, revisits: DataFrame, date: str, partitions: int, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html") -> DataFrame:
    """(record): the text of one record per page, without the end mark, in ``partitions`` partitions."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    # page_id is the row's own key, so this join, the only one that moves payloads, has no skew;
    # its partitions are the archive files
    joined = rows.repartition(partitions, "page_id", "payload_digest").join(revisits.withColumnRenamed("page_id", "_id").withColumnRenamed("payload_digest", "_digest"),
                       (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    length = F.octet_length(F.col("payload").cast("binary"))
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                    length.cast("string"), F.lit(RECORD_END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    # control characters in a URL would end the header line
    plain = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7F]", "_")
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id("page_id", "payload_digest")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", plain("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(revisit, record_id("refers_to", "payload_digest"))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, plain("refers_url"))), line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        line("X-Page-Id", F.col("page_id").cast("string")), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block.cast("binary")).cast("string")))
    return joined.select(F.concat(head, F.lit(CRLF), block).alias("record"))


def record_id(page_id: str, digest: str):
    """A urn:uuid made from the page and its payload: fresh, and the same on a rerun."""
    h = F.md5(F.concat(F.coalesce(F.col(page_id).cast("string"), F.lit("-")), F.lit(" "), F.col(digest)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str | None = None, min_payload: int = MIN_PAYLOAD,
                   file_bytes: int = FILE_BYTES) -> None:
    """Write the pages' records as gzip-compressed archives under ``path`` through Spark's writer, in
    files of about ``file_bytes`` before compression (a single larger record has its file alone or not).

    All records carry ``date``, by default the time of the call. Spark's text writer makes one gzip member of
    a file and names it ``.txt.gz``. A null payload is empty; a null URL or id has no header line. Rows with equal id and payload are
    of one type. An empty table writes no record."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = payload_headers(pages)
    total = headers.agg(F.sum(F.col("payload_bytes") + 600)).first()[0] or 0
    n_files = max(1, math.ceil(total / file_bytes))
    rows = records(pages, originals(headers, min_payload), date, n_files)
    rows.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def gunzip(data: bytes) -> bytes:
    """All gzip members of a file, be it one for the file or one for each record."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record: the block is as long as Content-Length says, whatever it holds."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, data[start:stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers: page_id, url, record_type, payload_digest, refers_to, stored_bytes, stored_digest.

    stored_bytes and stored_digest are measured on the payload that the record holds (null for a
    revisit). One file is read at a time; ``write_archives`` bounds its size."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("stored_bytes", pa.int64()), ("stored_digest", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (content,) in text_rows(batches, "content"):
                for head, block in parse_archive(gunzip(content)):
                    body = block[re.search(rb"\r\n\r\n", block).end():]
                    kind = head["WARC-Type"]
                    number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
                    yield (number("X-Page-Id"), head.get("WARC-Target-URI"), kind, head["WARC-Payload-Digest"].removeprefix("sha256:"),
                           number("X-Refers-To-Page-Id"), *((len(body), hashlib.sha256(body).hexdigest()) if kind == "response" else (None, None)))

        yield from batched(rows(), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(
        scan, "page_id long, url string, record_type string, payload_digest string, refers_to long, stored_bytes long, stored_digest string")


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to.

    A revisit takes length and digest from the response that it refers to, found by a join on
    page and digest; a revisit without its response has a null length."""
    responses = read.filter("record_type = 'response'")
    revisits = read.filter("record_type = 'revisit'")
    stored = responses.select(F.col("page_id").alias("_id"), F.col("stored_digest").alias("_digest"), F.col("stored_bytes").alias("_bytes")).distinct()
    wanted = stored.join(revisits.select(F.col("refers_to").alias("_id"), F.col("payload_digest").alias("_digest")).distinct(),
                         ["_id", "_digest"], "left_semi")
    found = revisits.join(wanted, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return (responses.select("page_id", F.col("stored_bytes").alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to")
            .unionByName(found.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("payload_digest"), "record_type", "refers_to")
                         .select(*columns)).select(*columns))
