"""Content-addressed chunking, dedup and chunk integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import content as contentf
from tidemark.functions import ids
from tidemark.operators.paths import MIB, with_path_key
from tidemark.operators.skew import HOT_ROWS, SMALL_ROWS, hot_keys, is_small, salted_join
from tidemark.schemas import DEFAULT_ALG, DEFAULT_MAX_FILE_MB, FILE_CHUNK_BYTES
from tidemark.session import cut_lineage


def split_into_chunks(
    files: DataFrame, chunk_bytes: int = FILE_CHUNK_BYTES, alg=DEFAULT_ALG, id_col: str = "_id"
) -> DataFrame:
    """One row per fixed-size piece: file columns, ``ord``, ``_id``, ``content``.

    Row-local: no shuffle, an empty file gives exactly one empty piece.
    """
    keep = [c for c in files.columns if c != "content"]
    ordinals = files.select(
        *keep,
        F.col("content").alias("_bytes"),
        F.explode(F.sequence(F.lit(0), contentf.piece_count("content", chunk_bytes) - 1)).alias("ord"),
    )
    pieces = ordinals.select(
        *keep, "ord", contentf.piece("_bytes", F.col("ord"), chunk_bytes).alias("content")
    )
    return pieces.withColumn(id_col, contentf.chunk_id("content", alg))


def dedup_chunks(pieces: DataFrame) -> DataFrame:
    """One row per chunk id; copies meet map-side before any body is shuffled."""
    return pieces.select("_id", "content").dropDuplicates(["_id"])


def file_fingerprints(
    files: DataFrame, chunk_bytes: int = FILE_CHUNK_BYTES, alg=DEFAULT_ALG
) -> DataFrame:
    """Ordered chunk-id list and size per file, without exploding or shuffling.

    Only Python hash functions need the exploded form, because a higher-order
    function cannot call them.
    """
    keep = [c for c in files.columns if c not in ("content", "size", "chunks")]
    if alg == DEFAULT_ALG:
        return files.select(
            *keep,
            contentf.chunk_list("content", chunk_bytes, alg).alias("chunks"),
            F.octet_length("content").cast("bigint").alias("size"),
        )
    pieces = split_into_chunks(files.select(*keep, "content"), chunk_bytes, alg, "_piece")
    return (
        pieces.groupBy(*keep)
        .agg(
            F.array_sort(F.collect_list(F.struct("ord", "_piece"))).alias("_p"),
            F.sum(F.octet_length("content")).alias("size"),
        )
        .select(*keep, F.transform("_p", lambda p: p["_piece"]).alias("chunks"), "size")
    )


def disk_fingerprints(
    disk: DataFrame,
    baselines: DataFrame,
    chunk_bytes: int = FILE_CHUNK_BYTES,
    max_broadcast: int = SMALL_ROWS,
    alg=DEFAULT_ALG,
) -> DataFrame:
    """Chunk list per disk file, reusing the baseline's when ``(mtime, size)``
    match and the baseline is whole and alive; adds ``reused``.

    Bodies never cross a shuffle.  When the files to hash are few (checked), only
    those rows are hashed; beyond that every row is hashed where it is read and
    the reuse decided on stat columns.
    """
    def keyed(df: DataFrame) -> DataFrame:
        # After the bodies are gone: the fold may call Python, which queues rows.
        return df if "path_key" in df.columns else with_path_key(df)

    full = baselines.filter(
        ~F.coalesce("deleted", F.lit(False)) & F.col("chunks").isNotNull() & F.col("mtime").isNotNull()
    ).select(
        "path_key",
        F.col("mtime").alias("_bm"),
        F.col("size").alias("_bs"),
        F.col("chunks").alias("_bc"),
    )
    same_stat = F.coalesce(
        (F.col("_bm") == F.col("mtime")) & (F.col("_bs") == F.col("size")), F.lit(False)
    )
    own = contentf.chunk_list("content", chunk_bytes, alg)
    bare = keyed(disk.drop("content"))
    columns = bare.columns
    stats = bare.join(full, "path_key", "left").withColumn("reused", same_stat)
    misses = cut_lineage(stats.filter(~F.col("reused")).select("path"))
    kept = [c for c in disk.columns if c != "content"]
    if is_small(misses, max_broadcast):
        hashed = keyed(
            disk.join(F.broadcast(misses), "path", "left_semi").select(
                *kept, own.alias("chunks"), F.lit(False).alias("reused")
            )
        )
        hits = stats.filter("reused").select(*columns, F.col("_bc").alias("chunks"), "reused")
        return hits.unionByName(hashed)
    hashed = keyed(disk.select(*kept, own.alias("_own")))
    return hashed.join(full, "path_key", "left").withColumn("reused", same_stat).select(
        *columns,
        F.when(F.col("reused"), F.col("_bc")).otherwise(F.col("_own")).alias("chunks"),
        "reused",
    )


def verify_chunks(chunks: DataFrame, alg=DEFAULT_ALG) -> DataFrame:
    """Adds ``verdict``: ok, hash-mismatch, alg-mismatch or content-missing."""
    tag = contentf.alg_tag(alg)
    verdict = (
        F.when(F.col("content").isNull(), "content-missing")
        .when(~ids.chunk_alg("_id").eqNullSafe(F.lit(tag)), "alg-mismatch")
        .when(contentf.digest("content", alg) == ids.chunk_hash("_id"), "ok")
        .otherwise("hash-mismatch")
    )
    return chunks.withColumn("verdict", verdict)


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("_id", F.octet_length("content").cast("bigint").alias("bytes"))


def reassemble(
    files: DataFrame,
    chunks: DataFrame,
    max_mb: float = DEFAULT_MAX_FILE_MB,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(_id, status, missing, size, content)`` per file.

    ``missing`` lists unusable ids in list order (status ``missing-chunks``);
    a file above the ceiling gets ``exceeds-max-size``.  Both are decided on
    lengths alone, so bodies travel only for files that will be written, and a
    chunk used by very many files is spread over several tasks.
    """
    refs = files.select("_id", F.posexplode("chunks").alias("ord", "chunk"))
    usable = chunks.filter(F.col("content").isNotNull()).select(
        F.col("_id").alias("chunk"), "content"
    )
    if "bytes" in chunks.columns:  # lengths kept beside the ids: no body is opened for them
        sizes = chunks.filter(F.col("bytes").isNotNull()).select(F.col("_id").alias("chunk"), "bytes")
    else:
        sizes = usable.select("chunk", F.octet_length("content").cast("bigint").alias("bytes"))
    hot = cut_lineage(hot_keys(refs, "chunk", hot_rows))
    measured = salted_join(refs, sizes, "chunk", ["_id", "ord"], "left", hot_rows, hot)
    verdicts = measured.groupBy("_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("bytes").isNull(), F.struct("ord", "chunk")))
        ).alias("_gaps"),
        F.sum("bytes").alias("size"),
    )
    status = (
        F.when(F.size("_gaps") > 0, "missing-chunks")
        .when(F.col("size") > F.lit(max_mb * MIB), "exceeds-max-size")
        .otherwise("ok")
    )
    judged = cut_lineage(
        files.select("_id")
        .join(verdicts, "_id", "left")
        .select(
            "_id",
            F.coalesce(status, F.lit("ok")).alias("status"),
            F.transform(F.coalesce("_gaps", F.array().cast("array<struct<ord:int,chunk:string>>")), lambda g: g["chunk"]).alias("missing"),
            F.coalesce("size", F.lit(0)).alias("size"),
        )
    )
    good = judged.filter(F.col("status") == "ok").select("_id")
    parts = salted_join(
        refs.join(good, "_id", "left_semi"), usable, "chunk", ["_id", "ord"], "inner", hot_rows, hot
    )
    bodies = parts.groupBy("_id").agg(
        # Joining as text copies each byte once; Spark strings are plain bytes.
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ord", "content"))),
                lambda p: p["content"].cast("string"),
            ),
            "",
        ).cast("binary").alias("content")
    )
    return judged.join(bodies, "_id", "left").withColumn(
        "content", F.when(F.col("status") == "ok", F.coalesce("content", F.lit(b"")))
    )


def at_rest_bytes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bytes over distinct referenced chunks, and logical size (one row)."""
    alive = files.filter(~F.coalesce("deleted", F.lit(False)))
    used = alive.select(F.explode("chunks").alias("_id")).distinct()
    stored = chunk_lengths(chunks).join(used, "_id", "left_semi").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("at_rest"), F.count(F.lit(1)).alias("chunks")
    )
    logical = alive.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("logical"))
    both = stored.withColumn("_one", F.lit(1)).join(logical.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "at_rest", "chunks", "logical",
        F.when(F.col("logical") > 0, F.round(F.col("at_rest") / F.col("logical"), 6)).alias("ratio"),
    )


def codec_report(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Stored blobs by header byte: mode, count and bytes."""
    return blobs.groupBy(contentf.codec_mode(content).alias("mode")).agg(
        F.count(F.lit(1)).alias("blobs"),
        F.sum(F.octet_length(content)).cast("bigint").alias("bytes"),
    )


def gzip_savings(chunks: DataFrame) -> DataFrame:
    """Bytes before and after gzip, keeping gzip only where it is smaller."""
    sized = chunks.filter(F.col("content").isNotNull()).select(
        F.octet_length("content").cast("bigint").alias("plain"),
        contentf.gzip_length("content").alias("packed"),
    )
    return sized.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("plain"), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.least("plain", "packed")), F.lit(0)).alias("bytes_after"),
        F.count_if(F.col("packed") < F.col("plain")).alias("packed_chunks"),
    )
