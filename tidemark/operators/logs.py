"""Store totals and log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.skew import newest_cut
from tidemark.schemas import DAY_MS, LOG_AVG_ENTRY_BYTES, LOG_ENTRY_OVERHEAD_BYTES, LOG_LEVELS


def store_totals(stores: DataFrame) -> DataFrame:
    """Number of stores, documents and bytes; unknown sizes count as 0."""
    return stores.agg(
        F.count(F.lit(1)).alias("stores"),
        F.coalesce(F.sum("doc_count"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def log_stats(logs: DataFrame) -> DataFrame:
    """Count, range, approximate bytes (48 + two per UTF-16 unit), per-level counts."""
    entry = F.lit(LOG_ENTRY_OVERHEAD_BYTES) + F.octet_length(F.encode("message", "UTF-16BE"))
    return logs.agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("timestamp").alias("oldest"),
        F.max("timestamp").alias("newest"),
        F.coalesce(F.sum(entry), F.lit(0)).cast("bigint").alias("approx_bytes"),
        *[F.count_if(F.col("level") == v).alias(v) for v in LOG_LEVELS],
    )


def log_range(logs: DataFrame, since: int) -> DataFrame:
    return logs.filter(F.col("timestamp") >= since).orderBy("timestamp", "id")


def log_retention(
    logs: DataFrame, now: int, days: int, max_mb: float = 0
) -> tuple[DataFrame, DataFrame]:
    """``(kept, counts)``: drop entries older than ``max(1, days)``, then keep the
    newest ``max(1, floor(MB / 200 bytes))``; 0 MB means no cap."""
    cutoff = now - max(1, int(days)) * DAY_MS
    recent = logs.filter(F.col("timestamp") >= cutoff)
    kept = recent
    if max_mb > 0:
        most = max(1, int(max_mb * 1024 * 1024 // LOG_AVG_ENTRY_BYTES))
        keep = newest_cut(recent, ["timestamp", "id"], most)
        if keep is not None:
            kept = recent.filter(keep)
    counts = logs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("timestamp") < cutoff).alias("removed_by_age")
    ).withColumn("k", F.lit(1)).join(
        kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("k", F.lit(1)), "k"
    ).select("removed_by_age", (F.col("n") - F.col("removed_by_age") - F.col("kept")).alias("removed_by_size"), "kept")
    return kept, counts


def log_tail(logs: DataFrame, n: int = 500) -> DataFrame:
    """Last ``n`` entries (a top-n per task, then merged)."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def truncate_sections(df: DataFrame, n: int = 50, section: str = "bucket", id_col: str = "id") -> DataFrame:
    """``(section, rank, line)``: first ``n`` ids per section and "... and k more".

    The rank filter is pushed below the shuffle, so each task ships at most
    ``n`` rows per section.
    """
    ranked = df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(section).orderBy(id_col))
    ).filter(F.col("rank") <= n)
    rest = df.groupBy(section).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n)
    return ranked.select(section, F.col("rank").cast("int").alias("rank"), F.col(id_col).alias("line")).unionAll(
        rest.select(
            section,
            F.lit(n + 1),
            F.concat(F.lit("... and "), (F.col("_n") - n).cast("string"), F.lit(" more")),
        )
    )


# --- fixed values: error kinds by status and message ---------------------------
ABORTED = r"(?i)operation was aborted|\baborted\b"
TIMEOUT = r"(?i)timed?[\s_-]?out|timeout"
NETWORK = (
    r"(?i)network|fetch|econn|enotfound|getaddrinfo|failed to fetch|load failed|dns|"
    r"unreachable|offline"
)
AUTH_STATUS = (401, 403)
NOT_FOUND_STATUS = 404
SERVER_STATUS = 500
# -------------------------------------------------------------------------------


def classify_errors(logs: DataFrame, status: str = "status", message: str = "message") -> DataFrame:
    """Adds ``error_kind``, by error name, status code, then message, in fixed priority.

    Optional columns: ``name`` (of the error), ``retriable`` (of an encryption error),
    ``non_retriable`` and ``encryption_paused``.
    """
    s, m = F.col(status), F.coalesce(F.col(message), F.lit("unknown"))
    known = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("non_retriable", "encryption_paused") if c in logs.columns}
    no = F.lit(False)
    name = F.coalesce(F.col("name"), F.lit("")) if "name" in logs.columns else F.lit("")
    final = no
    if "retriable" in logs.columns:  # trying again cannot help
        final = (name == "EncryptionError") & ~F.coalesce(F.col("retriable"), F.lit(True))
    return logs.withColumn(
        "error_kind",
        F.when(known.get("non_retriable", no) | final, "schema-mismatch")
        .when(known.get("encryption_paused", no), "encryption-paused")
        .when((name == "AbortError") | m.rlike(ABORTED), "aborted")
        .when(s.isin(*AUTH_STATUS), "auth")
        .when(s == NOT_FOUND_STATUS, "not-found")
        .when(s >= SERVER_STATUS, "server")
        .when(m.rlike(TIMEOUT), "timeout")
        .when(m.rlike(NETWORK), "network")
        .otherwise("unknown"),
    )
