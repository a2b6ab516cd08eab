"""Conflict resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.operators.classify import prefixed


def resolve_conflicts(
    conflicts: DataFrame, local: DataFrame, remote: DataFrame, choices: DataFrame, device: str
) -> DataFrame:
    """``(_id, decision, vclock, chunks, size, deleted)`` per conflicting id.

    ``conflicts``: ``_id`` and optional ``binary``; ``choices``: ``_id, choice``
    (keep-local, take-remote or defer).  keep-local writes the local version
    under the merged clock + 1; take-remote writes the remote version under its
    clock + 1, seeded from the merged clock when it is a deletion.  Binary
    content and settings docs keep local; without a choice the row is pending.
    """
    binary = (
        F.coalesce("binary", F.lit(False)) if "binary" in conflicts.columns else F.lit(False)
    )
    rows = (
        conflicts.select("_id", binary.alias("_binary"))
        .join(choices.select("_id", "choice"), "_id", "left")
        .join(prefixed(local, "l_", "_id"), "_id", "left")
        .join(prefixed(remote, "r_", "_id"), "_id", "left")
    )
    decision = (
        F.when(ids.is_config("_id") | F.col("_binary"), "keep-local")
        .when(F.col("choice").isin("keep-local", "take-remote"), F.col("choice"))
        .otherwise("pending")
    )
    keep = F.col("decision") == "keep-local"
    take = F.col("decision") == "take-remote"
    merged = clocks.merge("l_vclock", "r_vclock")
    seed = F.when(F.col("r_deleted"), merged).otherwise(F.col("r_vclock"))

    def pick(name: str):
        return F.when(keep, F.col(f"l_{name}")).when(take, F.col(f"r_{name}")).alias(name)

    return rows.withColumn("decision", decision).select(
        "_id",
        "decision",
        F.when(keep, clocks.increment(merged, device)).when(take, clocks.increment(seed, device)).alias("vclock"),
        pick("chunks"),
        pick("size"),
        pick("deleted"),
    )
