"""Stored JSON rows: integration baselines and retry sets of older versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.paths import with_path_key
from tidemark.schemas import CLOCK

FULL = "struct<vclock:map<string,bigint>,chunks:array<string>,size:bigint,mtime:bigint,deleted:boolean>"


def upgrade_baselines(raw: DataFrame) -> DataFrame:
    """Baselines from ``(path, value)`` rows, ``value`` being JSON text.

    A row with a ``vclock`` member is a full one; any other object is a bare
    clock and becomes a legacy row (NULL chunks and size).  Keys are folded; when
    several rows fold to one key a full row wins, then the smaller raw path.
    """
    full = F.from_json("value", FULL)
    bare = F.from_json("value", CLOCK)
    is_full = F.get_json_object("value", "$.vclock").isNotNull()
    rows = with_path_key(raw).select(
        "path_key",
        "path",
        F.coalesce(F.when(is_full, full["vclock"]).otherwise(bare), F.create_map().cast(CLOCK)).alias("vclock"),
        F.when(is_full, full["chunks"]).alias("chunks"),
        F.when(is_full, full["size"]).alias("size"),
        F.when(is_full, full["mtime"]).alias("mtime"),
        F.coalesce(F.when(is_full, full["deleted"]), F.lit(False)).alias("deleted"),
    )
    legacy = F.col("chunks").isNull() | F.col("size").isNull()
    body = F.struct("vclock", "chunks", "size", "mtime", "deleted")
    return (
        rows.groupBy("path_key")
        .agg(F.min_by(body, F.struct(legacy, F.col("path"))).alias("b"))
        .select("path_key", "b.*")
    )


# --- fixed values: reasons and kinds of the retry sets ---------------------------
UNPUSHED_REASONS = ("race-stale", "divergent")
PENDING_APPLY_REASONS = ("missing-chunks", "pending-deletion")
PENDING_CONFLICT_KINDS = ("pull-delete-vs-edit", "local-delete-vs-remote-edit", "edit-vs-edit")
# ----------------------------------------------------------------------------------


def load_retry_rows(raw: DataFrame, allowed: tuple[str, ...], field: str = "reason") -> DataFrame:
    """``(id, reason, attempts, added_at)`` from JSON rows; malformed ones drop."""
    value = F.from_json("value", f"struct<{field}:string,attempts:int,addedAt:bigint>")
    return raw.select("id", value.alias("v")).filter(F.col(f"v.{field}").isin(*allowed)).select(
        "id",
        F.col(f"v.{field}").alias(field),
        F.coalesce("v.attempts", F.lit(0)).alias("attempts"),
        F.coalesce("v.addedAt", F.lit(0)).alias("added_at"),
    )
