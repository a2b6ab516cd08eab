"""Scans, bulk reads, replication and log export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.operators.chunking import verify_chunks
from tidemark.operators.integrity import alive
from tidemark.operators.skew import broadcast_if_small
from tidemark.schemas import DEFAULT_ALG, LOG_LEVELS
from tidemark.session import cut_lineage
from tidemark.sources import files


def removed(df: DataFrame) -> Column:
    """Removed from its store: ``_deleted`` where the table has it, else ``deleted``."""
    name = "_deleted" if "_deleted" in df.columns else "deleted"
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def scan_docs(
    docs: DataFrame,
    prefix: str | None = None,
    keys: DataFrame | None = None,
    limit: int | None = None,
    include_docs: bool = True,
) -> DataFrame:
    """Rows of one kind ordered by ``_id``.  ``keys`` (``_id``) omits absent ids;
    the limit applies after ordering (top-n per task, then merged)."""
    out = docs
    if prefix is not None:
        out = out.filter(F.col("_id").startswith(prefix))
    if not include_docs:
        out = out.select("_id")
    if keys is not None:
        out = out.join(broadcast_if_small(keys.select("_id").distinct()), "_id", "left_semi")
    out = out.orderBy("_id")
    return out if limit is None else out.limit(limit)


def list_ids(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.select("_id").filter(F.col("_id").startswith(prefix))


def changes_since(
    docs: DataFrame, since: int, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows, cursor)``: rows after ``since`` in sequence order, and ``last_seq``:
    the largest sequence among the rows given out, or ``since`` without any."""
    rows = docs.filter(F.col("_local_seq") > since).orderBy("_local_seq", "_id")
    if limit is not None:
        rows = rows.limit(limit)
    cursor = rows.agg(
        F.coalesce(F.max("_local_seq"), F.lit(since)).cast("bigint").alias("last_seq")
    )
    return rows, cursor


def bulk_get(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents by id; absent and deleted ones are dropped."""
    return docs.filter(~removed(docs)).join(
        broadcast_if_small(wanted.select("_id").distinct()), "_id", "left_semi"
    )


def docs_under_folder(docs: DataFrame, folder: str) -> DataFrame:
    """Alive file docs strictly inside a folder; the slash is part of the prefix."""
    return docs.filter(F.col("_id").startswith(f"file:{folder.rstrip('/')}/") & alive())


def read_disk(spark: SparkSession, root: str, path_glob: str | None = None) -> DataFrame:
    """``(path, mtime, ctime, size, content)`` of all files under ``root``, paths
    relative to it.  Stat-only queries never open the files.

    Spark's file source reads all it does not pass over: files of a length, under names
    that start with neither a dot nor an underscore.  Those it passes over come from a
    listing of their own.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    # The root as the file system writes it stands in front of every path, and only
    # there is it taken off: a folder inside may repeat its name.
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    base = system.makeQualified(where).toString().rstrip("/") + "/"
    mtime = F.unix_millis("modificationTime")
    read = reader.load(root).select(
        F.substring("path", F.lit(len(base) + 1), F.length("path")).alias("path"),
        mtime.alias("mtime"),
        mtime.alias("ctime"),
        F.col("length").alias("size"),
        "content",
    )
    rest = files.list_files(spark, root).filter(files.left_out(F.col("path")) | (F.col("size") == 0))
    if path_glob:
        rest = rest.filter(files.matches_name(F.col("path"), path_glob))
    passed_over = files.with_content(rest, root).withColumn("ctime", F.col("mtime"))
    return read.unionByName(passed_over.select(*read.columns))


@dataclass
class Written:
    docs: DataFrame
    chunks: DataFrame
    conflicts: DataFrame


def apply_batch(
    docs: DataFrame,
    chunks: DataFrame,
    new_docs: DataFrame,
    new_chunks: DataFrame,
    deletes: DataFrame | None = None,
    seq: int | None = None,
) -> Written:
    """One atomic batch on ``docs`` and ``chunks``.

    ``new_docs`` carries ``expected_vclock``; NULL means "do not check".  When
    any stored clock differs, ``conflicts`` names the offenders and the whole
    batch is rejected: docs and chunks are returned as they were.  The single
    driver check is whether conflicts is empty.  New docs get ``_version + 1``
    and share one new ``_local_seq``; chunks are put only if absent.  A caller that
    passes parts of the tables also passes ``seq``.
    """
    stored = docs.select("_id", F.col("vclock").alias("_vc"), F.col("_version").alias("_v"))
    facing = new_docs.join(
        stored.join(broadcast_if_small(new_docs.select("_id")), "_id", "left_semi"), "_id", "left"
    )
    conflicts = facing.filter(
        F.col("expected_vclock").isNotNull() & (clocks.relation("_vc", "expected_vclock") != "equal")
    ).select("_id", clocks.clock_text("_vc").alias("stored"), clocks.clock_text("expected_vclock").alias("expected"))
    if not conflicts.isEmpty():
        return Written(docs, chunks, conflicts)
    if seq is None:
        seq = docs.agg(F.coalesce(F.max("_local_seq"), F.lit(0)) + 1).first()[0]
    columns = [c for c in docs.columns if c not in ("_version", "_local_seq")]
    fresh = facing.select(
        *columns,
        (F.coalesce("_v", F.lit(0)) + 1).cast(docs.schema["_version"].dataType).alias("_version"),
        F.lit(seq).cast(docs.schema["_local_seq"].dataType).alias("_local_seq"),
    )
    gone = new_docs.select("_id")
    if deletes is not None:
        gone = gone.unionAll(deletes.select("_id"))
        fresh = fresh.join(deletes.select("_id"), "_id", "left_anti")
    next_docs = docs.join(broadcast_if_small(gone), "_id", "left_anti").unionByName(fresh)
    next_chunks = chunks
    if deletes is not None:
        next_chunks = next_chunks.join(broadcast_if_small(deletes.select("_id")), "_id", "left_anti")
    put = new_chunks.select("_id", "content").dropDuplicates(["_id"])
    absent = put.join(next_chunks.select("_id"), "_id", "left_anti")
    return Written(next_docs, next_chunks.select("_id", "content").unionByName(absent), conflicts)


@dataclass
class Replica:
    docs: DataFrame
    chunks: DataFrame
    dropped: DataFrame


def replicate_all(docs: DataFrame, chunks: DataFrame, alg=DEFAULT_ALG) -> Replica:
    """Full clone: live docs, chunks whose bytes hash to their id, and the ids of
    the chunks that were dropped with the reason (never written empty)."""
    # Every body is hashed and written once; the verdicts are read without it.
    checked = cut_lineage(verify_chunks(chunks, alg))
    return Replica(
        strip_store_columns(docs.filter(~removed(docs))),
        checked.filter("verdict = 'ok'").drop("verdict"),
        checked.filter("verdict <> 'ok'").select("_id", "verdict"),
    )


def strip_store_columns(docs: DataFrame) -> DataFrame:
    return docs.drop("_rev", "_version", "_local_seq")


def delete_remote(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tombstones for the ids that exist and are not deleted yet."""
    return bulk_get(docs, wanted).withColumn("deleted", F.lit(True))


def pull_by_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """Live docs under a prefix, the store's revision column stripped."""
    return docs.filter(F.col("_id").startswith(prefix) & ~removed(docs)).drop("_rev")


def list_remote_by_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.filter(F.col("_id").startswith(prefix) & ~removed(docs)).select("_id")


def delete_by_prefix(docs: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(remaining docs, deleted ids)``."""
    hit = F.col("_id").startswith(prefix)
    return docs.filter(~hit), docs.filter(hit).select("_id")


def iso_time(ms: Column | str) -> Column:
    """Epoch milliseconds as ``2024-01-01T00:00:00.000Z``."""
    c = F.col(ms) if isinstance(ms, str) else ms
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(c).cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def export_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, header)``: sorted text lines, and one row of counts and range.

    ``lines`` is globally sorted by range partitions, so it can be written with
    ``lines.select("line").write.text(...)`` in as many ordered parts as needed.
    """
    lines = logs.select(
        "timestamp",
        "id",
        F.concat(iso_time("timestamp"), F.lit(" ["), F.upper("level"), F.lit("] "), "message").alias("line"),
    ).orderBy("timestamp", "id")
    header = logs.agg(
        F.count(F.lit(1)).alias("log_count"),
        iso_time(F.min("timestamp")).alias("range_from"),
        iso_time(F.max("timestamp")).alias("range_to"),
        *[F.count_if(F.col("level") == v).alias(v) for v in LOG_LEVELS],
    )
    return lines, header
