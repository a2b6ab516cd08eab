"""Vector-clock operators on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks
from tidemark.schemas import CLOCK


def with_vc_relation(df: DataFrame, a: str, b: str, out: str = "relation") -> DataFrame:
    return df.withColumn(out, clocks.relation(a, b))


def merge_vc(df: DataFrame, a: str, b: str, out: str = "merged") -> DataFrame:
    return df.withColumn(out, clocks.merge(a, b))


def increment_vc(df: DataFrame, device: str, vclock: str = "vclock") -> DataFrame:
    return df.withColumn(vclock, clocks.increment(vclock, device))


def with_latest_device(df: DataFrame, vclock: str = "vclock", out: str = "latest_device") -> DataFrame:
    return df.withColumn(out, clocks.latest_device(vclock))


def merge_vc_by(df: DataFrame, keys: Sequence[str], vclock: str = "vclock") -> DataFrame:
    """Per-key maximum of all clocks of a group; empty clocks keep their group.

    Both steps combine before the shuffle; the second one sees at most one row
    per (group, device).
    """
    keys = list(keys)
    per_device = (
        df.select(*keys, F.explode_outer(clocks.clock(vclock)).alias("_dev", "_n"))
        .groupBy(*keys, "_dev")
        .agg(F.max("_n").alias("_n"))
    )
    entry = F.when(F.col("_dev").isNotNull(), F.struct("_dev", "_n"))
    return per_device.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).cast(CLOCK).alias(vclock)
    )


def dominators(
    df: DataFrame, keys: Sequence[str], vclock: str = "vclock", id_col: str = "_id"
) -> DataFrame:
    """Per group ``dominator`` (its clock dominates or equals all others, ties to
    the smallest id, else NULL), ``smallest`` id and ``members``.

    A clock equals the group's merge exactly when its counters add up to the
    merge's total, so comparing totals replaces any pairwise comparison or
    join back to the rows.
    """
    keys = list(keys)
    best = F.struct((-clocks.total(vclock)).alias("neg"), F.col(id_col).alias("id"))
    ranked = df.select(
        *keys,
        F.col(id_col).alias("_id"),
        best.alias("_best"),
        F.when(~clocks.is_empty(vclock), F.map_entries(clocks.clock(vclock))).alias("_entries"),
    )
    rows = ranked.select(*keys, "_id", "_best", F.explode_outer("_entries").alias("_e"))
    per_device = rows.groupBy(*keys, F.col("_e.key").alias("_dev")).agg(
        F.max("_e.value").alias("_n"), F.min("_best").alias("_best"), F.min("_id").alias("_min")
    )
    grouped = per_device.groupBy(*keys).agg(
        F.sum(F.coalesce("_n", F.lit(0))).alias("_total"),
        F.min("_best").alias("_best"),
        F.min("_min").alias("smallest"),
    )
    return grouped.select(
        *keys,
        F.when(F.col("_total") == -F.col("_best.neg"), F.col("_best.id")).alias("dominator"),
        "smallest",
    )
