"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables.  ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256; ``records`` holds each record's exact
header bytes and the digest it refers to.  Reading joins the two and gives the
original record bytes back; every digest is computed anew from the stored bytes.

Defined results: a NULL payload is empty; of equal payloads of ``min_bytes`` or more
the smallest ``page_id`` is the response and the others revisit it, smaller ones are
all responses; rows that repeat the smallest ``page_id`` are responses too; a NULL
``page_id`` sorts last; a NULL url leaves the target line out; white space and
control characters of a url are written as ``%20``; an empty table gives an empty
archive; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import salted_join
from tidemark.session import cut_lineage, shared_dir

MIN_BYTES = 100
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


def new_archive(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col("bytes") + len(HTTP_HEAD))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:>"))),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Refers-To", _urn(F.col("refers_to"))),
        _line("WARC-Profile", F.when(revisit, profile)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(f"{CRLF}{HTTP_HEAD}"),
    )


def write_archive(
    pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write one record per row of ``pages`` (page_id, url, html).

    Only ids and digests are grouped and joined; the bytes are shuffled once, to
    store equal ones once, and equal ones are combined before that shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    stored = pages.select(
        F.sha2(payload, 256).alias("digest"), payload.alias("payload")
    ).dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    light = cut_lineage(
        pages.select(
            "page_id", "url", F.sha2(payload, 256).alias("digest"),
            F.octet_length(payload).cast("long").alias("bytes"),
        )
    )
    first = light.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("digest", "first_id")
    linked = light.join(first, "digest", "left").withColumn(
        "refers_to",
        F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()),
               F.col("first_id")),
    )
    records = linked.select(F.encode(_header(date), "UTF-8").alias("header"), "digest")
    records.write.option("compression", "zstd").parquet(f"{folder}/records")


def _field(name: str) -> Column:
    """Value of a header line; NULL where the line is missing."""
    found = F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: parsed fields, its header, block payload and whole bytes.

    A response's payload length and digest are those of the record rebuilt by the join,
    behind its header; a revisit's block is empty, and its figures are those of the stored
    payload that it refers to.  Fails where stored bytes don't have the digest they are
    stored under.  The records of a payload with very many copies are spread.
    """
    stored = spark.read.parquet(f"{folder}/payloads").select(
        "digest", "payload",
        F.octet_length("payload").cast("long").alias("_bytes"),
        F.sha2("payload", 256).alias("_found"),
    ).withColumn(
        "_found",
        F.when(F.col("digest") == F.col("_found"), F.col("_found")).otherwise(
            F.raise_error(F.concat(F.lit("broken payload "), F.col("digest")))
        ),
    )
    records = spark.read.parquet(f"{folder}/records").withColumn("head", F.decode("header", "UTF-8"))
    number = lambda name: F.regexp_extract(_field(name), "^<urn:page:(-?[0-9]+)>$", 1)
    parsed = records.select(
        "header", "digest",
        F.expr("try_cast(nullif(regexp_extract(head, '\\r\\nWARC-Record-ID: <urn:page:(-?[0-9]+)>', 1), '') as bigint)")
        .alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").try_cast("long").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
    )
    end = F.lit(CRLF * 2).cast("binary")
    joined = salted_join(parsed, stored, "digest", ["page_id", "url"], "inner")
    response = F.col("record_type") == "response"
    rebuilt = joined.withColumn("record", F.concat("header", F.when(response, F.col("payload")).otherwise(F.lit(b"")), end))
    size = F.octet_length("record") - F.octet_length("header") - len(CRLF * 2)
    block = F.substr("record", F.octet_length("header") + 1, size)
    return rebuilt.withColumn(
        "payload_bytes", F.when(response, size.cast("long")).otherwise(F.col("_bytes"))
    ).withColumn("payload_digest", F.when(response, F.sha2(block, 256)).otherwise(F.col("_found"))).select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
        "header", "payload", "record",
    )
