"""Pull planning: what each change of the remote feed does to the local store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.operators.classify import Side, prefixed, relation, verdict
from tidemark.operators.integrity import missing_chunks
from tidemark.operators.skew import broadcast_if_small
from tidemark.schemas import IDS


def latest_changes(changes: DataFrame) -> DataFrame:
    """Highest sequence per id; the feed carries the latest revision only."""
    return changes.groupBy("id").agg(
        F.max("seq").alias("seq"),
        F.max_by(F.struct("deleted", "doc"), "seq").alias("_row"),
    ).select("id", "seq", F.coalesce("_row.deleted", F.lit(False)).alias("deleted"), "_row.doc")


def only_ids(table: DataFrame, wanted: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of a large table named by a delta; a small delta is broadcast, so
    the large side is filtered where it is read."""
    return table.join(broadcast_if_small(wanted.select(key).distinct()), key, "left_semi")


def _judged(changes: DataFrame, local: DataFrame, recreate: bool) -> DataFrame:
    """Latest change per id beside the local doc (``l_*``, ``r_*``)."""
    latest = latest_changes(changes)
    rows = latest.select(
        F.col("id").alias("_id"),
        "seq",
        F.col("deleted").alias("gone"),
        F.col("doc").isNotNull().alias("has_doc"),
        clocks.clock("doc.vclock").alias("r_vclock"),
        F.col("doc.chunks").alias("r_chunks"),
        F.col("doc.size").alias("r_size"),
        F.col("doc.mtime").alias("r_mtime"),
        F.coalesce("doc.deleted", F.lit(False)).alias("r_deleted"),
    )
    joined = rows.join(prefixed(local, "l_", "_id"), "_id", "left").withColumn(
        "here", F.col("l_here").isNotNull()
    )
    left, right = Side.of("l_"), Side.of("r_")
    rel = F.col("_clock_rel")
    return (
        joined.withColumn("_clock_rel", clocks.relation("l_vclock", "r_vclock"))
        .withColumn(
            "converged",
            F.col("here")
            & ~clocks.is_empty("l_vclock")
            & (rel == "equal")
            & F.col("l_chunks").eqNullSafe(F.col("r_chunks"))
            & (F.coalesce("l_deleted", F.lit(False)) == F.col("r_deleted")),
        )
        .withColumn("_relation", relation(left, right, recreate=recreate, clock_relation=rel))
        .withColumn("_verdict", verdict(F.col("here"), F.col("_relation")))
    )


def pull_plan(changes: DataFrame, local: DataFrame, unpushed_ids: DataFrame) -> DataFrame:
    """One row per changed id: ``outcome``, accepted version, ``pending_kind``.

    Outcomes: take-remote, silent-merge, keep-local, converged, concurrent,
    deletion-applied, deletion-conflict, deletion-moot, chunk, ignored.
    ``unpushed_ids`` (``_id``) names docs with a local edit not yet pushed.
    """
    held = unpushed_ids.select("_id").distinct().withColumn("unpushed", F.lit(True))
    judged = _judged(changes, local, False).join(held, "_id", "left")
    is_file, is_config = ids.is_file("_id"), ids.is_config("_id")
    l_deleted = F.coalesce("l_deleted", F.lit(False))
    deletion = (
        F.when(~is_file, "ignored")
        .when(~F.col("here") | l_deleted, "deletion-moot")
        .when(F.coalesce("unpushed", F.lit(False)), "deletion-conflict")
        .otherwise("deletion-applied")
    )
    outcome = (
        F.when(F.col("gone"), deletion)
        .when(~F.col("has_doc"), "ignored")
        .when(~is_file & ~is_config, "chunk")
        .when(F.col("converged"), "converged")
        .otherwise(F.col("_verdict"))
    )
    plan = judged.withColumn("outcome", outcome)
    o = F.col("outcome")
    pending = F.when(o == "deletion-conflict", "pull-delete-vs-edit").when(
        (o == "concurrent") & is_file,
        F.when(F.col("r_deleted") & ~l_deleted, "pull-delete-vs-edit")
        .when(~F.col("r_deleted") & l_deleted, "local-delete-vs-remote-edit")
        .when(~F.col("r_deleted") & ~l_deleted, "edit-vs-edit"),
    )
    return _accepted(plan, o).withColumn("pending_kind", pending).select(
        "_id", "seq", "outcome", "accepted", "vclock", "chunks", "size", "mtime", "deleted", "pending_kind"
    )


def _accepted(plan: DataFrame, o: Column) -> DataFrame:
    """The version to write: remote, remote under the merged clock, or a
    tombstone that keeps the local clock."""
    tomb = o == "deletion-applied"
    taken = o.isin("take-remote", "silent-merge")
    return (
        plan.withColumn("accepted", tomb | taken)
        .withColumn(
            "vclock",
            F.when(o == "silent-merge", clocks.merge("l_vclock", "r_vclock"))
            .when(o == "take-remote", F.col("r_vclock"))
            .when(tomb, clocks.clock("l_vclock"))
            .when(o == "deletion-conflict", clocks.empty_clock()),
        )
        .withColumn("chunks", F.when(tomb, F.array().cast(IDS)).when(taken, F.col("r_chunks")))
        .withColumn("size", F.when(tomb, F.lit(0)).when(taken, F.col("r_size")))
        .withColumn("mtime", F.when(tomb, F.col("l_mtime")).when(taken, F.col("r_mtime")))
        .withColumn("deleted", F.when(tomb, True).when(taken, F.col("r_deleted")))
    )


def pull_stats(plan: DataFrame, writes: DataFrame | None = None) -> DataFrame:
    """One row of counters; ``writes`` (``_id, result``) adds what the disk
    writer reported: applied, skipped or failed."""
    o = F.col("outcome")
    counts = plan.agg(
        F.count_if(o == "keep-local").alias("keep_local"),
        F.count_if(o == "chunk").alias("chunks"),
        F.count_if(o.startswith("deletion-")).alias("deleted"),
        F.count_if(o == "converged").alias("converged"),
        F.count_if(o == "silent-merge").alias("silent_merge"),
        F.count_if(o.isin("concurrent", "deletion-conflict")).alias("concurrent"),
        F.count_if("accepted").alias("accepted"),
    )
    if writes is None:
        return counts
    done = writes.agg(
        F.count_if(F.col("result") == "applied").alias("written"),
        F.count_if(F.col("result") == "skipped").alias("skipped"),
        F.count_if(F.col("result") == "failed").alias("failed"),
    )
    one = F.lit(1).alias("k")
    return counts.select("*", one).join(done.select("*", one), "k").drop("k")


def pending_apply_rows(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retry rows of accepted docs: deletions, and files with absent chunks."""
    accepted = plan.filter(F.col("accepted") & ids.is_file("_id"))
    gone = accepted.filter("deleted").select("_id", F.lit("pending-deletion").alias("reason"))
    alive = accepted.filter(~F.col("deleted"))
    broken = missing_chunks(alive.select("_id", "chunks", "deleted"), chunks)
    return (
        gone.unionAll(broken.select("_id", F.lit("missing-chunks")))
        .select(F.col("_id").alias("id"), "reason", F.lit(0).alias("attempts"))
    )


def pending_conflicts_review(pending: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(id, kind, decision)``: present a stored conflict again, or drop it."""
    wanted = pending.select(F.col("id").alias("_id"))
    rows = (
        pending.select(F.col("id").alias("_id"), "kind")
        .join(prefixed(only_ids(local, wanted), "l_", "_id"), "_id", "left")
        .join(prefixed(only_ids(remote, wanted), "r_", "_id"), "_id", "left")
    )
    l_here, r_here = F.col("l_here").isNotNull(), F.col("r_here").isNotNull()
    l_dead = F.coalesce("l_deleted", F.lit(False))
    r_live = r_here & ~F.coalesce("r_deleted", F.lit(False))
    still = relation(
        Side.of("l_"), Side.of("r_"), clock_relation=clocks.relation("l_vclock", "r_vclock")
    ) == "true-divergent"
    keep = (
        F.when(F.col("kind") == "local-delete-vs-remote-edit", l_here & l_dead & r_live)
        .when(F.col("kind") == "edit-vs-edit", l_here & ~l_dead & r_live & still)
        .otherwise(l_here & ~l_dead)
    )
    return rows.select(
        F.col("_id").alias("id"), "kind", F.when(keep, "present").otherwise("drop").alias("decision")
    )


def pending_apply_step(pending: DataFrame, docs: DataFrame, *chunks: DataFrame) -> DataFrame:
    """One retry round: ``(id, reason, attempts, outcome)``.

    Outcome applied or moot leaves the set; retry stays with attempts + 1.
    Deletions are re-applied without looking at chunks.
    """
    wanted = pending.select(F.col("id").alias("_id"))
    named = only_ids(docs, wanted).select("_id", "chunks", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    broken = missing_chunks(named, *chunks).select("_id", F.lit(True).alias("_broken"))
    rows = (
        pending.withColumnRenamed("id", "_id")
        .join(named.select("_id", F.col("deleted").alias("_dead")), "_id", "left")
        .join(broken, "_id", "left")
    )
    deletion = F.col("reason") == "pending-deletion"
    known = F.col("_dead").isNotNull() & ids.is_file("_id")
    outcome = (
        F.when(deletion, F.when(known & F.col("_dead"), "applied").otherwise("moot"))
        .when(~known | F.col("_dead"), "moot")
        .when(F.col("_broken"), "retry")
        .otherwise("applied")
    )
    return rows.select(
        F.col("_id").alias("id"),
        "reason",
        F.when(outcome == "retry", F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        outcome.alias("outcome"),
    )


def config_pull_plan(changes: DataFrame, local: DataFrame, recreate: bool = False) -> DataFrame:
    """Like :func:`pull_plan` for settings rows: take-remote, silent-merge,
    keep-local, converged, concurrent, deleted or ignored."""
    judged = _judged(changes.filter(ids.is_config("id")), local, recreate)
    outcome = (
        F.when(F.col("gone"), "deleted")
        .when(~F.col("has_doc"), "ignored")
        .when(F.col("converged"), "converged")
        .otherwise(F.col("_verdict"))
    )
    plan = judged.withColumn("outcome", outcome)
    return _accepted(plan, F.col("outcome")).select(
        "_id", "seq", "outcome", "accepted", "vclock", "chunks", "size", "deleted"
    )
