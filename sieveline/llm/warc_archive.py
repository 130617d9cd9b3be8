"""Content-addressed WARC archive (operator 2).

Every page becomes one WARC record. Of the pages with equal payloads, that with the largest
``page_id`` is a ``response`` and holds the bytes; the others are ``revisit`` records that refer to
it. Spark's text writer lays the records down: a record ends with an empty line, which is the
writer's line separator, so the files are plain (compressed) WARC.

Reading frames records by ``Content-Length`` only, so no payload can fake a record border. What is
read is split in two relations: exact record headers, and a payload store with the bytes once under
their SHA-256, which is recomputed from the bytes and compared with the header's. A join of the two
reconstructs each original record, revisits included.

Pages with equal payloads are found by SHA-256 with partial aggregation; a payload that a third of
all pages share is one row for each task then. The joins on the digest are plain equi-joins, whose
skewed partitions Spark splits.

Edge cases: a null html is an empty payload, and empty payloads are deduplicated like others; a null
url is an empty target; a line break in a url is percent-encoded; a null ``page_id`` is archived as ``-`` and comes back as null; rows that
repeat a ``page_id`` are archived one by one; an empty table gives an empty archive; further columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch_path, written

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # archives carry no clock: equal input, equal bytes
FILE_RECORDS_BYTES = 16 << 20
BROADCAST_DIGESTS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits are four groups of 40, each eight digits of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, ``header`` (its exact lines) and ``payload`` (empty for revisits)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    page = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    page = page.withColumns({"key": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    first = (
        page.filter(F.col("n") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("response_id"), F.count("*").alias("pages"))
        .filter("pages > 1").select("key", "response_id")
    )
    # digests only: few enough are broadcast, so that the payloads stay where they are; beyond that Spark shuffles
    first = written(first, "warc-responses")
    page = page.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "key", "left")
    revisit = F.coalesce(F.col("response_id") != F.coalesce("page_id", F.col("response_id") - 1), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.concat(F.lit("X-Payload-SHA256: "), F.col("key")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("response_id")))),
        F.when(revisit, f"WARC-Profile: {PROFILE}"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
    ]
    return page.select(
        "page_id", F.concat_ws(CRLF, *lines, F.lit("")).alias("header"), F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload")
    )


def write_archive(pages: DataFrame, out: str, min_bytes: int = 0) -> None:
    """Writes WARC files, gzip-compressed, under ``out``: about ``FILE_RECORDS_BYTES`` of average records each."""
    record = F.concat(F.col("header"), F.lit(CRLF), F.decode("payload", "UTF-8"))
    lines = records(pages, min_bytes).select(record.alias("value"))
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    per_file = max(1, FILE_RECORDS_BYTES * n // max(1, (size or 0) + 512 * n))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(out)


def parse(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, payload) of each record of one file's bytes, framed by Content-Length."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 2
        header = raw[at:end].decode()
        length = int(re.search(r"\r\nContent-Length: (\d+)\r\n", header)[1])
        yield header, raw[end + 2 : end + 2 + length]
        at = end + 2 + length + 4


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["header", "payload"])

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for header, payload in parse(zlib.decompress(content.as_py(), 47)):
                rows.append((header, payload))
                size += len(header) + len(payload)
                if size > 8 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """``header`` and ``payload`` of every record in the files under ``out``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    return files.select("content").mapInArrow(_parse_batches, "header string, payload binary")


def field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def split_archive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (with the payload's key) and the payload store (each payload once, under its verified key)."""
    keyed = records.withColumn("key", field("X-Payload-SHA256"))
    held = keyed.filter(field("WARC-Type") == "response")
    true_key = F.sha2("payload", 256)
    checked = F.when(true_key == F.col("key"), true_key).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")))
    store = held.select(checked.alias("key"), "payload")
    return keyed.select("header", "key"), store


def page_digests(records: DataFrame) -> DataFrame:
    """One row per page from the records read back; figures of the full payload come through the store.

    A revisit takes length and digest from its stored payload by a join on the key; a response has
    its payload at hand.
    """
    number = lambda c: F.try_to_number(F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1), F.lit("S9999999999999999999")).cast("long")
    headers, store = split_archive(records)
    facts = store.select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    facts = facts.groupBy("key").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    rows = headers.select(
        number(field("WARC-Record-ID")).alias("page_id"), "key", field("WARC-Type").alias("record_type"), number(field("WARC-Refers-To")).alias("refers_to")
    )
    return rows.join(facts, "key").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct(records: DataFrame) -> DataFrame:
    """page header and full payload of every archived record, revisits filled from the payload store."""
    headers, store = split_archive(records)
    return headers.join(store.dropDuplicates(["key"]), "key").select("header", "payload")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), out)
    return page_digests(read_archive(spark, out))


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
g AS (SELECT *, [('0x' || substr(h, 1 + 10 * i, 10))::ubigint for i in range(4)] AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + i // 8] >> (35 - 5 * (i % 8))::ubigint) & 31::ubigint)::int, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""

QUERIES = {"op2_warc_archive": op2_warc_archive}
ORACLE_SQL = {"op2_warc_archive": _SQL}
