"""Divergence, chunk consistency, repair and garbage collection.

Chunk bodies stay out of every join here except the final copy in
:func:`apply_repair`; presence is decided on ids alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.operators.chunking import verify_chunks
from tidemark.operators.paths import with_path_key
from tidemark.operators.skew import HOT_ROWS, is_small, salted_join, is_small
from tidemark.schemas import DEFAULT_ALG
from tidemark.session import cut_lineage


def alive(deleted: str = "deleted") -> Column:
    return ~F.coalesce(F.col(deleted), F.lit(False))


def diff_file_docs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(_id, side, relation)``: local_only, remote_only, or differing clocks.

    Deleted docs take part; equal clocks are left out even if content differs.
    """
    a = local.select("_id", F.col("vclock").alias("_l"), F.lit(True).alias("_in_l"))
    b = remote.select("_id", F.col("vclock").alias("_r"), F.lit(True).alias("_in_r"))
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    side = (
        F.when(F.col("_in_r").isNull(), "local_only")
        .when(F.col("_in_l").isNull(), "remote_only")
        .otherwise("differing")
    )
    return (
        a.join(b, "_id", "full_outer")
        .select("_id", side.alias("side"), F.when(both, clocks.relation("_l", "_r")).alias("relation"))
        .filter((F.col("side") != "differing") | (F.col("relation") != "equal"))
    )


def chunk_refs(owners: DataFrame) -> DataFrame:
    """``(id, path)`` per reference of an alive owner; a chunk used twice in one
    file gives two rows.  Long form: a chunk may be used by any number of files."""
    return owners.filter(alive()).select(
        F.explode("chunks").alias("id"), ids.path_of("_id").alias("path")
    )


def ref_ids(owners: DataFrame) -> DataFrame:
    return owners.filter(alive()).select(F.explode("chunks").alias("id")).distinct()


def chunk_presence(
    owners: DataFrame, local_chunks: DataFrame, remote_chunks: DataFrame
) -> DataFrame:
    """``(id, in_local, in_remote, referenced)`` for every known chunk id.

    The three id lists are unioned and or-ed together: one shuffle of ids,
    combined map-side, so a chunk referenced by a third of all files costs one
    row per task.
    """

    def flagged(df: DataFrame, id_col: str, bit: int) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.lit(bit).alias("bits"))

    refs = owners.filter(alive()).select(F.explode("chunks").alias("id"))
    bits = (
        flagged(local_chunks, "_id", 1)
        .unionAll(flagged(remote_chunks, "_id", 2))
        .unionAll(flagged(refs, "id", 4))
        .groupBy("id")
        .agg(F.bit_or("bits").alias("bits"))
    )

    def has(bit: int) -> Column:
        return F.col("bits").bitwiseAND(F.lit(bit)) != 0

    return bits.select(
        "id", has(1).alias("in_local"), has(2).alias("in_remote"), has(4).alias("referenced")
    )


def report_rows(presence: DataFrame) -> DataFrame:
    """Long report ``(bucket, id)``; an id may sit in several buckets."""
    l, r, f = F.col("in_local"), F.col("in_remote"), F.col("referenced")
    buckets = F.array_compact(
        F.array(
            F.when(l & ~r, "local_only"),
            F.when(r & ~l, "remote_only"),
            F.when(l & ~f, "orphan_local"),
            F.when(r & ~f, "orphan_remote"),
            F.when(f & ~l & ~r, "missing_referenced"),
        )
    )
    return presence.select(F.explode(buckets).alias("bucket"), "id")


def missing_referenced_paths(
    owners: DataFrame, presence: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, path)`` of references to chunks that exist on neither side."""
    gone = presence.filter(~F.col("in_local") & ~F.col("in_remote")).select("id")
    return salted_join(chunk_refs(owners), gone, "id", ["path"], "left_semi", hot_rows)


@dataclass
class Consistency:
    """Result of :func:`chunk_consistency`; all frames are lazy."""

    state: str
    divergence: DataFrame
    presence: DataFrame | None = None
    report: DataFrame | None = None
    missing_paths: DataFrame | None = None


def chunk_consistency(
    local_files: DataFrame,
    remote_files: DataFrame,
    local_chunks: DataFrame,
    remote_chunks: DataFrame,
) -> Consistency:
    """Chunk report, or only the divergence while the stores have not converged.

    The convergence gate is the single driver check, made before any chunk scan.
    """
    divergence = diff_file_docs(local_files, remote_files)
    if not divergence.isEmpty():
        return Consistency("needs-convergence", divergence)
    presence = chunk_presence(local_files, local_chunks, remote_chunks)
    return Consistency(
        "converged",
        divergence,
        presence,
        report_rows(presence),
        missing_referenced_paths(local_files, presence),
    )


def consistency_counts(presence: DataFrame) -> DataFrame:
    l, r, f = F.col("in_local"), F.col("in_remote"), F.col("referenced")
    return presence.agg(
        F.count_if(l).alias("local_chunks"),
        F.count_if(r).alias("remote_chunks"),
        F.count_if(f).alias("referenced_ids"),
        F.count_if(l & ~r).alias("local_only"),
        F.count_if(r & ~l).alias("remote_only"),
        F.count_if(f & ~l & ~r).alias("missing_referenced"),
        F.count_if(l & ~f).alias("orphan_local"),
        F.count_if(r & ~f).alias("orphan_remote"),
    )


def docs_signature(docs: DataFrame, seq: str = "_local_seq") -> DataFrame:
    """``(max_seq, doc_count)``: moves on any insert, update or delete."""
    return docs.agg(
        F.coalesce(F.max(seq), F.lit(0)).alias("max_seq"), F.count(F.lit(1)).alias("doc_count")
    )


def snapshot_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: did the signature move between the two readings?"""
    return before.select(F.struct("max_seq", "doc_count").alias("b"), F.lit(1).alias("k")).join(
        after.select(F.struct("max_seq", "doc_count").alias("a"), F.lit(1).alias("k")), "k"
    ).select((F.col("b") != F.col("a")).alias("changed"))


def repair_plan(presence: DataFrame) -> DataFrame:
    """``(id, action)`` for one-sided chunks; everything else is left alone."""
    l, r, f = F.col("in_local"), F.col("in_remote"), F.col("referenced")
    action = (
        F.when(l & ~r & f, "push")
        .when(r & ~l & f, "pull")
        .when(l & ~r, "delete-local")
        .when(r & ~l, "delete-remote")
    )
    return presence.select("id", action.alias("action")).filter(F.col("action").isNotNull())


def revalidate_plan(plan: DataFrame, local_files: DataFrame, remote_files: DataFrame) -> DataFrame:
    """Drops planned deletes of chunks that a file references *now*."""
    held = (
        ref_ids(local_files)
        .withColumn("action", F.lit("delete-local"))
        .unionAll(ref_ids(remote_files).withColumn("action", F.lit("delete-remote")))
    )
    return plan.join(held, ["id", "action"], "left_anti")


@dataclass
class Repaired:
    local_chunks: DataFrame
    remote_chunks: DataFrame
    results: DataFrame


def apply_repair(
    plan: DataFrame, local_chunks: DataFrame, remote_chunks: DataFrame, alg=DEFAULT_ALG
) -> Repaired:
    """New chunk tables plus ``(id, action, result)``.

    Bodies with no usable content fail on push; pulled bodies must hash to
    their id.  The plan is written once, so that only planned ids meet bodies
    and a short plan is broadcast by its measured size.
    """
    plan = cut_lineage(plan)

    def picked(chunks: DataFrame, action: str) -> DataFrame:
        wanted = plan.filter(F.col("action") == action).select(F.col("id").alias("_id"))
        return chunks.select("_id", "content").join(wanted, "_id", "left_semi")

    def without(chunks: DataFrame, action: str) -> DataFrame:
        gone = plan.filter(F.col("action") == action).select(F.col("id").alias("_id"))
        return chunks.select("_id", "content").join(gone, "_id", "left_anti")

    pushed = picked(local_chunks, "push").withColumn(
        "verdict", F.when(F.col("content").isNull(), "content-missing").otherwise("ok")
    )
    pulled = verify_chunks(picked(remote_chunks, "pull"), alg)
    new_remote = without(remote_chunks, "delete-remote").unionByName(
        pushed.filter("verdict = 'ok'").drop("verdict")
    )
    new_local = without(local_chunks, "delete-local").unionByName(
        pulled.filter("verdict = 'ok'").drop("verdict")
    )
    moved = pushed.select(F.col("_id").alias("id"), F.lit("push").alias("action"), "verdict").unionAll(
        pulled.select(F.col("_id").alias("id"), F.lit("pull").alias("action"), "verdict")
    )
    removals = plan.filter(F.col("action").startswith("delete"))
    moves = plan.filter(~F.col("action").startswith("delete")).join(moved, ["id", "action"], "left")
    results = removals.select("id", "action", F.lit("ok").alias("result")).unionAll(
        moves.select("id", "action", F.coalesce("verdict", F.lit("absent")).alias("result"))
    )
    return Repaired(new_local, new_remote, results)


@dataclass
class Collected:
    kept: DataFrame
    deleted: DataFrame
    counts: DataFrame


def gc_chunks(owners: DataFrame, chunks: DataFrame) -> Collected:
    """Chunks no alive owner references.  Pass one owner kind and its own chunk
    table: references never cross stores.  ``kept`` removes by the (usually
    short) deleted list; use :func:`gc_ids` where bodies are not needed."""
    flags = gc_ids(owners, chunks)
    deleted = cut_lineage(
        flags.filter(F.col("stored") & ~F.col("referenced")).select(F.col("id").alias("_id"))
    )
    counts = flags.agg(
        F.count_if("stored").alias("scanned"),
        F.count_if("referenced").alias("referenced"),
        F.count_if(F.col("stored") & ~F.col("referenced")).alias("deleted"),
    )
    kept = chunks.join(deleted, "_id", "left_anti")
    return Collected(kept, deleted, counts)


def gc_ids(owners: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, stored, referenced)``: one shuffle of ids."""
    refs = owners.filter(alive()).select(F.explode("chunks").alias("id"), F.lit(2).alias("bits"))
    stored = chunks.select(F.col("_id").alias("id"), F.lit(1).alias("bits"))
    return (
        stored.unionAll(refs)
        .groupBy("id")
        .agg(F.bit_or("bits").alias("bits"))
        .select(
            "id",
            (F.col("bits").bitwiseAND(F.lit(1)) != 0).alias("stored"),
            (F.col("bits").bitwiseAND(F.lit(2)) != 0).alias("referenced"),
        )
    )


def gc_counts(owners: DataFrame, chunks: DataFrame) -> DataFrame:
    return gc_ids(owners, chunks).agg(
        F.count_if("stored").alias("scanned"),
        F.count_if("referenced").alias("referenced"),
        F.count_if(F.col("stored") & ~F.col("referenced")).alias("deleted"),
    )


def usable_ids(*chunk_tables: DataFrame) -> DataFrame:
    """Ids whose content is really there, over one or several stores.

    A table with a ``bytes`` column (length of the content, NULL without one) tells
    it by that column, and no content is read.
    """
    out = None
    for table in chunk_tables:
        told = "bytes" if "bytes" in table.columns else "content"
        part = table.filter(F.col(told).isNotNull()).select(F.col("_id").alias("chunk"))
        out = part if out is None else out.unionAll(part)
    return out


def missing_chunks(files: DataFrame, *chunk_tables: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(_id, missing)``: alive files and their absent or unusable chunk ids, in
    list order.

    Distinct referenced ids are tested first, where they are few by a filter on the
    scan of the ids; only references to a missing id are joined back to their file.
    """
    refs = files.filter(alive()).select("_id", F.posexplode("chunks").alias("ord", "chunk"))
    stored = usable_ids(*chunk_tables)
    asked = cut_lineage(refs.select("chunk").distinct())
    if is_small(asked):
        stored = stored.join(F.broadcast(asked), "chunk", "left_semi")
    gone = (
        asked.select("chunk", F.lit(1).alias("bits"))
        .unionAll(stored.select("chunk", F.lit(2).alias("bits")))
        .groupBy("chunk")
        .agg(F.bit_or("bits").alias("bits"))
        .filter("bits = 1")
        .select("chunk")
    )
    broken = salted_join(refs, gone, "chunk", ["_id", "ord"], "left_semi", hot_rows)
    return broken.groupBy("_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "chunk"))), lambda p: p["chunk"]
        ).alias("missing")
    )


def quarantine(
    files: DataFrame,
    local_chunks: DataFrame,
    remote_chunks: DataFrame | None,
    previous: DataFrame,
) -> DataFrame:
    """``(path_key, state, is_new, missing)`` for files that are or were broken.

    quarantined: missing on both sides (``is_new`` when the list changed);
    transient: missing here and the remote is unknown; cleared: quarantined
    before and complete now.
    """
    tables = [local_chunks] + ([remote_chunks] if remote_chunks is not None else [])
    broken = with_path_key(
        missing_chunks(files, *tables).withColumn("path", ids.path_of("_id"))
    ).select("path_key", "missing")
    known = with_path_key(files.filter(alive()).select(ids.path_of("_id").alias("path"))).select(
        "path_key"
    )
    before = previous.select("path_key", F.col("missing_chunks").alias("_was"), F.lit(True).alias("_had"))
    joined = broken.join(before, "path_key", "full_outer")
    state = F.when(F.col("missing").isNull(), "cleared").otherwise(
        "quarantined" if remote_chunks is not None else "transient"
    )
    is_new = (state == "quarantined") & ~F.col("missing").eqNullSafe(F.col("_was"))
    out = joined.select("path_key", state.alias("state"), is_new.alias("is_new"), "missing")
    # A previous entry whose file is no longer looked at keeps its entry.
    return out.filter("state <> 'cleared'").unionAll(
        out.filter("state = 'cleared'").join(known, "path_key", "left_semi")
    )


def push_backfill(local: DataFrame, remote: DataFrame, unpushed: DataFrame) -> DataFrame:
    """New unpushed rows for ids the remote lacks or lags behind on."""
    diff = diff_file_docs(local, remote)
    targets = diff.filter((F.col("side") == "local_only") | (F.col("relation") == "dominates"))
    return (
        targets.select(F.col("_id").alias("id"))
        .join(unpushed.select("id"), "id", "left_anti")
        .select("id", F.lit("race-stale").alias("reason"), F.lit(0).alias("attempts"))
    )


def config_divergence(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(_id, relation)`` of non-equal clocks on ids both stores hold."""
    joined = local.select("_id", F.col("vclock").alias("_l")).join(
        remote.select("_id", F.col("vclock").alias("_r")), "_id"
    )
    return joined.select("_id", clocks.relation("_l", "_r").alias("relation")).filter(
        F.col("relation") != "equal"
    )


def dangerous_for(divergence: DataFrame, direction: str) -> DataFrame:
    """Entries a blind ``push`` or ``pull`` would overwrite."""
    risky = {"push": ("concurrent", "dominated"), "pull": ("concurrent", "dominates")}[direction]
    return divergence.filter(F.col("relation").isin(*risky))


def empty_folders(disk: DataFrame, deletes: DataFrame) -> DataFrame:
    """``(dir)``: parents of deleted files that hold no other file any more."""
    remaining = disk.select("path").join(deletes.select("path"), "path", "left_anti")
    left = remaining.select(F.explode(ids.ancestors("path")).alias("dir")).distinct()
    touched = deletes.select(F.explode(ids.ancestors("path")).alias("dir")).distinct()
    return touched.join(left, "dir", "left_anti")
