"""Push planning with a durable set of ids still to be pushed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.operators.classify import prefixed
from tidemark.operators.skew import HOT_ROWS, salted_join
from tidemark.plans.pull import only_ids
from tidemark.schemas import RACE_STALE_LIMIT
from tidemark.session import cut_lineage


def store_removed(df: DataFrame) -> Column:
    """Row removed from its store (``_deleted``), as opposed to a tombstone doc."""
    return F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in df.columns else F.lit(False)


def push_candidates(
    docs: DataFrame, since: int, pull_writes: DataFrame, unpushed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(candidates, zombies)``.

    Candidates (``_id, origin``) are replicated docs changed after ``since``
    that are no echo of a pull (``pull_writes``: ``id, seq``), and queued ids
    that still exist.  Queued ids that vanished are zombies.
    """
    fresh = docs.filter(
        (F.col("_local_seq") > since) & ~store_removed(docs) & ids.is_replicated("_id")
    ).select("_id", "_local_seq")
    written = pull_writes.groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_seq"))
    changed = (
        fresh.join(written, "_id", "left")
        .filter(F.col("_seq").isNull() | (F.col("_local_seq") > F.col("_seq")))
        .select("_id", F.lit("change").alias("origin"))
    )
    queued = unpushed.select(F.col("id").alias("_id"))
    there = only_ids(docs.filter(~store_removed(docs)).select("_id"), queued)
    alive = there.filter(ids.is_replicated("_id"))
    retried = alive.join(changed, "_id", "left_anti").select("_id", F.lit("retry").alias("origin"))
    zombies = queued.join(alive, "_id", "left_anti").select("_id")
    return changed.unionAll(retried), zombies


def _compare(candidates: DataFrame, remote: DataFrame) -> DataFrame:
    """Candidates beside the remote doc; only named remote rows are read on."""
    named = only_ids(remote, candidates)
    return (
        prefixed(candidates, "l_", "_id")
        .join(prefixed(named, "r_", "_id"), "_id", "left")
        .withColumn("relation", F.when(F.col("r_here").isNotNull(), clocks.relation("l_vclock", "r_vclock")))
        .withColumn(
            "same",
            F.col("l_chunks").eqNullSafe(F.col("r_chunks")) & (F.col("l_deleted") == F.col("r_deleted")),
        )
    )


def push_plan(candidates: DataFrame, remote: DataFrame, unpushed: DataFrame) -> DataFrame:
    """``(_id, action, relation, attempts)`` per candidate doc.

    push, skip (remote already equal), divergent, or drop (kinds that are never
    pushed).  ``attempts`` is the queued counter.  A race-stale id that already
    failed three times is surfaced as divergent instead of pushed again.
    """
    queue = unpushed.select(F.col("id").alias("_id"), "reason", "attempts")
    rows = _compare(candidates, remote).join(queue, "_id", "left")
    rel, same = F.col("relation"), F.col("same")
    worn_out = (F.col("reason") == "race-stale") & (F.col("attempts") >= RACE_STALE_LIMIT)
    to_push = F.when(worn_out, "divergent").otherwise("push")
    file_action = (
        F.when(rel.isNull(), to_push)
        .when(rel.isin("equal", "dominates") & same, "skip")
        .when(rel == "dominates", to_push)
        .otherwise("divergent")
    )
    action = (
        F.when(ids.is_file("_id"), file_action).when(ids.is_chunk("_id"), "push").otherwise("drop")
    )
    return rows.select(
        "_id",
        action.alias("action"),
        rel.alias("relation"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.col("l_chunks").alias("chunks"),
    )


def gate_files_on_chunks(
    plan: DataFrame, chunk_results: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``withheld``: a pushed file that uses a chunk whose push failed.

    ``chunk_results``: ``(id, error)``; a conflict on a chunk is success.
    """
    plan = cut_lineage(plan)
    failed = (
        chunk_results.filter(F.col("error").isNotNull() & (F.col("error") != "conflict"))
        .select(F.col("id").alias("chunk"))
        .distinct()
    )
    files = plan.filter(ids.is_file("_id") & (F.col("action") == "push"))
    refs = files.select("_id", F.explode("chunks").alias("chunk"))
    blocked = (
        salted_join(refs, failed, "chunk", ["_id"], "left_semi", hot_rows)
        .select("_id")
        .distinct()
        .withColumn("withheld", F.lit(True))
    )
    return plan.join(blocked, "_id", "left").withColumn(
        "withheld", F.coalesce("withheld", F.lit(False))
    )


def apply_push_results(
    unpushed: DataFrame,
    plan: DataFrame,
    results: DataFrame,
    zombies: DataFrame,
    now: int = 0,
) -> DataFrame:
    """Next ``unpushed`` set.

    ``results`` (``id, error``): NULL pushed, ``conflict`` raced; a withheld
    file counts as raced.  Pushed, equal and vanished ids leave; divergent and
    raced ids enter with attempts + 1; entering wins over leaving.
    """
    withheld = F.col("withheld") if "withheld" in plan.columns else F.lit(False)
    outcome = (
        plan.join(results.select(F.col("id").alias("_id"), "error", F.lit(True).alias("_done")), "_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("action") == "divergent", "divergent").when(
                ids.is_file("_id") & (withheld | (F.col("error") == "conflict")), "race-stale"
            ),
        )
        .withColumn(
            "leaves",
            (F.col("action") == "skip") | (F.coalesce("_done", F.lit(False)) & F.col("error").isNull() & ~withheld),
        )
    )
    added = outcome.filter(F.col("reason").isNotNull()).select(
        F.col("_id").alias("id"), "reason", (F.col("attempts") + 1).cast("int").alias("attempts"),
        F.lit(now).cast("bigint").alias("added_at"),
    )
    leaving = (
        outcome.filter("leaves").select(F.col("_id").alias("id"))
        .unionAll(zombies.select(F.col("_id").alias("id")))
        .unionAll(added.select("id"))
    )
    kept = unpushed.join(leaving, "id", "left_anti").select("id", "reason", "attempts", "added_at")
    return kept.unionByName(added)


def warmup_unpushed(unpushed: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The queue without ids that vanished or that the remote already equals."""
    named = only_ids(local, unpushed.select(F.col("id").alias("_id"))).filter(ids.is_file("_id"))
    rows = _compare(named, remote)
    converged = F.coalesce(F.col("relation").isin("equal", "dominates") & F.col("same"), F.lit(False))
    stay = rows.filter(~converged).select(F.col("_id").alias("id"))
    return unpushed.join(stay, "id", "left_semi")


def config_push_plan(changes: DataFrame, remote: DataFrame) -> DataFrame:
    """``(_id, action, relation, blocked)`` for changed settings docs.

    push, skip or divergent; one divergent row blocks the whole push, so every
    row then carries ``blocked`` and the cursor stays.
    """
    mine = changes.filter(ids.is_config("_id") & ~store_removed(changes))
    rows = _compare(mine, remote)
    rel = F.col("relation")
    action = (
        F.when(rel.isNull() | (rel == "dominates"), "push")
        .when((rel == "equal") & F.col("same"), "skip")
        .otherwise("divergent")
    )
    plan = rows.select("_id", action.alias("action"), rel.alias("relation"))
    gate = plan.agg((F.count_if(F.col("action") == "divergent") > 0).alias("blocked"))
    one = F.lit(1).alias("_k")
    return plan.select("*", one).join(F.broadcast(gate.select("*", one)), "_k").drop("_k")


def force_advance(divergent: DataFrame, local: DataFrame, remote: DataFrame, device: str) -> DataFrame:
    """Local docs named by ``divergent`` with merged clock + 1, so they dominate."""
    mine = only_ids(local, divergent)
    theirs = only_ids(remote, divergent).select("_id", F.col("vclock").alias("_r"))
    return (
        mine.join(theirs, "_id", "inner")
        .withColumn("vclock", clocks.increment(clocks.merge("vclock", "_r"), device))
        .drop("_r")
    )
