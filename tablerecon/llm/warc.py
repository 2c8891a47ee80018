"""Operator 6: write pages as WARC records, storing each payload once.

Headers are grouped by payload digest.  The page with the largest id of a
digest keeps its payload as ``response``; every other one becomes a
``revisit`` that names it.  Digests of several pages are written first, so
that Spark knows how many there are: as long as they are few it joins them
where the pages are read, and no payload is shuffled.  Records are written
through Spark's text sink, whose line separator is the blank lines that end a
WARC record, and read back by their Content-Length, one at a time.

Defined cases: a null payload is an empty one; rows that share the largest id
of a payload are all responses; a null id ranks below all others; null or
unprintable parts of a url are left out of its header; repeated rows give
repeated records; no rows give no records.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS_PER_FILE = 2000
#: Payload that a reader hands on at once.
BATCH_BYTES = 16 << 20


def base32(hexed: Column) -> Column:
    """40 hex digits in base 32: five of them make four letters."""

    def letter(i: Column) -> Column:
        value = F.conv(F.substr(hexed, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        digit = F.floor(value / F.pow(F.lit(32), 3 - i % 4)).cast("int") % 32
        return F.substr(F.lit(BASE32), digit + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), digest))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.concat(F.lit(f"{name}: "), value)


def resolve(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Decide for each page whether it is a response or revisits another page.

    Only digests and ids are grouped, combined in the map tasks.  The second
    key of the join lets adaptive execution split a digest that many pages have.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    heads = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")
    ).select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    several = heads.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    several = stored(several.where("n > 1").select("sha1", "original"), "digests")
    several = several.select(F.col("sha1").alias("_sha1"), F.xxhash64("sha1").alias("_hash"), "original")
    joined = heads.withColumn("hash", F.xxhash64("sha1")).join(
        several, (F.col("sha1") == F.col("_sha1")) & (F.col("hash") == F.col("_hash")), "left"
    )
    joined = joined.withColumn("digest", base32(F.col("sha1")))
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "payload", "bytes", "digest", F.when(revisit, F.col("original")).alias("refers_to"))


def records(resolved: DataFrame, written_at: str) -> DataFrame:
    """One text per record, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        _header("WARC-Date", F.lit(written_at)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), _record_id(F.col("refers_to"), F.col("digest")), F.lit(">")))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        _header("Content-Length", F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(head, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, *, written_at: str, records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    """Write gzipped archives of bounded size under ``folder``."""
    (
        records(resolve(pages, **options), written_at)
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(folder)
    )


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, found by Content-Length; no more than one is held."""
    while version := stream.readline():
        if version.rstrip(b"\r\n").decode() != VERSION:
            raise ValueError("no WARC record where one should begin")
        head: dict[str, str] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != END.encode():
            raise ValueError("a record does not end where its length says")
        yield head, block


def read_archives(spark, folder: str, *, payload: bool = True) -> DataFrame:
    """One row per record; size and digest are taken from the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                size = 0
                for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(data.as_py()))):
                    whole = head["WARC-Type"] == "response"
                    body = block[block.index(b"\r\n\r\n") + 4 :] if whole else None
                    page = head.get("X-Page-Id")
                    rows.append(
                        {
                            "record_id": head["WARC-Record-ID"].strip("<>"),
                            "record_type": head["WARC-Type"],
                            "page_id": None if page is None else int(page),
                            "url": head.get("WARC-Target-URI"),
                            "refers_to_id": head["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in head else None,
                            "header_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "payload_bytes": len(body) if whole else None,
                            "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None,
                            "payload": body if payload else None,
                        }
                    )
                    size += len(block) if payload else 200
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    schema = (
        "record_id string, record_type string, page_id long, url string, refers_to_id string, header_digest string, "
        "payload_bytes long, payload_digest string, payload binary"
    )
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, schema)


def resolved_records(archive: DataFrame) -> DataFrame:
    """Join revisit records to the responses they name."""
    own = archive.select("record_id", "record_type", "page_id", "url", "refers_to_id", "payload_bytes", "payload_digest")
    originals = (
        archive.where("record_type = 'response'")
        .groupBy("record_id")
        .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
        .select(F.col("record_id").alias("_id"), F.xxhash64("record_id").alias("_hash"), "refers_to", "_bytes", "_digest")
    )
    joined = own.withColumn("hash", F.xxhash64("refers_to_id")).join(
        originals, (F.col("refers_to_id") == F.col("_id")) & (F.col("hash") == F.col("_hash")), "left"
    )
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
