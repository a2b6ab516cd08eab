"""Applying a reconcile plan: what changes in docs, chunks, baselines and on disk.

Every output holds the changes only.  Files are opened where they are pushed, bodies are
never shuffled but for the chunk dedup, and everything else is rows of planned paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.operators.integrity import docs_signature
from tidemark.operators.paths import with_path_key
from tidemark.operators.skew import broadcast_if_small
from tidemark.plans.pull import only_ids
from tidemark.plans.reconcile import ingest_chunks, ingest_files, keyed_docs, mark_deleted, update_baselines
from tidemark.schemas import DEFAULT_ALG, DEFAULT_MAX_FILE_MB, FILE_CHUNK_BYTES, IDS
from tidemark.session import cut_lineage
from tidemark.sources.store import CONFLICT_ROWS, DocStore

TAKES = ("restore", "pull", "collision-restore")
ESTABLISHED = (*TAKES, "vclock-adopt", "delete-apply", "baseline-align", "collision-resolved")
LOSERS = ("dedup-file", "tombstone")
CONFLICTS = {
    "conflict-edit": "edit-vs-edit",
    "conflict-delete": "local-delete-vs-remote-edit",
    "conflict-recreate": "recreate-vs-delete",
    "collision-unresolved": "spelling",
}


@dataclass
class Applied:
    """Changes of one reconcile run.

    docs: new versions with ``expected_vclock``; chunks: of pushed files; baselines: new
    rows, ``removed`` where there is none any more; disk: ``path, op, _id, chunks, size,
    mtime`` with op write or delete; skipped: ``path_key, path, size_mb``, NULL where a file
    fits again; quarantined, conflicts: what waits for chunks or for the user.
    """

    docs: DataFrame
    chunks: DataFrame
    baselines: DataFrame
    disk: DataFrame
    skipped: DataFrame
    quarantined: DataFrame
    conflicts: DataFrame


def changed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those of the same key."""
    return table.join(broadcast_if_small(rows.select(key).distinct()), key, "left_anti").unionByName(rows)


def listing(disk: DataFrame, ops: DataFrame) -> DataFrame:
    """``(path, size, mtime)`` of the disk once ``ops`` are done."""
    stats = disk.select("path", F.col("size").cast("bigint").alias("size"), F.col("mtime").cast("bigint").alias("mtime"))
    written = ops.filter("op = 'write'").select("path", "size", "mtime")
    return stats.join(broadcast_if_small(ops.select("path")), "path", "left_anti").unionByName(written)


def _tombstones(docs: DataFrame, clocks_by_id: DataFrame) -> DataFrame:
    """The named docs as deleted ones under their new clocks; chunks stay listed."""
    old = only_ids(docs, clocks_by_id).withColumnRenamed("vclock", "expected_vclock").withColumn("deleted", F.lit(True))
    return old.join(clocks_by_id, "_id")


def apply_plan(
    plan: DataFrame,
    disk: DataFrame,
    docs: DataFrame,
    baselines: DataFrame,
    device: str,
    skipped: DataFrame | None = None,
    include_re: str | None = None,
    exclude_re: str | None = None,
    max_mb: float = DEFAULT_MAX_FILE_MB,
    chunk_bytes: int = FILE_CHUNK_BYTES,
    alg=DEFAULT_ALG,
) -> Applied:
    """What a plan (``reconcile_plan`` with ``with_doc``) changes.

    push: the file is ingested as its exact path (held and out-of-scope files change
    nothing); delete: a tombstone, unless the doc moved past its baseline; pull, restore: the
    doc is written to disk, a pull over the file that is there; delete-apply: the file goes
    where the tombstone names its exact spelling.  These and the aligning actions set the
    baselines of their own paths and of no others.  Of colliding spellings the losers
    become tombstones and the canonical doc's baseline is established.  Conflicts and
    quarantined paths change nothing and are listed.  ``docs`` and ``baselines`` are read
    several times: a table is better than a plan that folds versions.
    """
    plan = cut_lineage(plan)
    a = F.col("action")

    pushed = plan.filter(a == "push").select("path")
    files = disk.join(broadcast_if_small(pushed), "path", "left_semi")
    named = only_ids(docs, pushed.select(F.concat(F.lit("file:"), "path").alias("_id")))
    made = cut_lineage(
        ingest_files(files, named, baselines, device, include_re, exclude_re, max_mb, chunk_bytes, alg)
    )
    written = made.filter("outcome = 'written'")
    before = named.select("_id", F.col("vclock").alias("expected_vclock"))
    new_docs = written.join(before, "_id", "left").withColumn(
        "expected_vclock", F.coalesce("expected_vclock", clocks.empty_clock())
    )

    marks = cut_lineage(mark_deleted(docs, baselines, plan.filter(a == "delete").select("path"), device))
    dead = marks.filter("outcome = 'tombstone'").select(F.concat(F.lit("file:"), "path").alias("_id"), "vclock")
    lost = plan.filter(a.isin(*LOSERS)).select(F.concat(F.lit("file:"), "path").alias("_id"))
    dropped = only_ids(docs, lost).select("_id", clocks.increment(F.col("vclock"), device).alias("vclock"))
    gone = _tombstones(docs, dead.unionByName(dropped))

    columns = [c for c in docs.columns if c not in ("_version", "_local_seq")]
    fresh = cut_lineage(
        _shaped(new_docs, docs, columns).unionByName(gone.select(*columns, "expected_vclock"))
    )

    takes = plan.filter(a.isin(*TAKES)).select("path", F.col("doc_id").alias("_id"))
    source = only_ids(docs, takes).select("_id", "chunks", F.col("size").cast("bigint").alias("size"),
                                          F.col("mtime").cast("bigint").alias("mtime"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("_id", "string"), ("chunks", IDS), ("size", "bigint"), ("mtime", "bigint"))]
    exact = F.coalesce(ids.path_of("doc_id") == F.col("path"), F.lit(False))
    erased = plan.filter((a == "dedup-file") | ((a == "delete-apply") & exact))
    ops = cut_lineage(
        takes.join(source, "_id").select("path", F.lit("write").alias("op"), "_id", "chunks", "size", "mtime")
        .unionByName(erased.select("path", F.lit("delete").alias("op"), *none))
    )

    own = written.select("path_key", "vclock", "chunks", "size", "mtime", F.lit(False).alias("deleted"))
    buried = marks.filter(F.col("outcome").isin("tombstone", "baseline-aligned")).select(
        "path_key", "vclock", F.array().cast(IDS).alias("chunks"), F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("bigint").alias("mtime"), F.lit(True).alias("deleted"),
    )
    # One spelling a path is left; its doc and its file as they are after all of the above.
    # Both modes start from the rows of their paths, which are folded and written once.
    keys = cut_lineage(plan.filter(a.isin("align", *ESTABLISHED)).select("path_key", (a == "align").alias("_align")).distinct())
    now = cut_lineage(only_ids(with_path_key(listing(disk, ops)), keys, "path_key"))
    stored = changed(docs.select(*columns), fresh.select(*columns), "_id")
    stored = cut_lineage(only_ids(keyed_docs(stored), keys, "path_key"))
    known = cut_lineage(only_ids(baselines, keys, "path_key"))
    settled = own.unionByName(buried)
    for mode, chosen in (("align", F.col("_align")), ("establish", ~F.col("_align"))):
        rows = update_baselines(known, stored, now, mode, keys.filter(chosen).select("path_key"))
        settled = settled.unionByName(
            rows.filter(~F.col("label").isin("already-aligned", "unchanged")).drop("label")
        )
    erased_rows = marks.filter("outcome = 'baseline-removed'").select("path_key", F.lit(True).alias("removed"))
    settled = settled.withColumn("removed", F.lit(False)).unionByName(erased_rows, allowMissingColumns=True)

    large = made.filter("outcome = 'skipped'").join(disk.select("path", F.col("size").alias("_bytes")), "path")
    too_large = large.select("path_key", "path", F.round(F.col("_bytes") / F.lit(1 << 20), 1).alias("size_mb"))
    if skipped is not None:
        fits = made.filter("outcome not in ('skipped', 'out-of-scope')").join(
            skipped.select("path_key").distinct(), "path_key", "left_semi"
        )
        too_large = too_large.unionByName(fits.select("path_key", "path", F.lit(None).cast("double").alias("size_mb")))

    kinds = F.create_map(*[F.lit(x) for pair in CONFLICTS.items() for x in pair])
    return Applied(
        docs=fresh,
        chunks=ingest_chunks(files, made, chunk_bytes, alg),
        baselines=cut_lineage(settled),
        disk=ops,
        skipped=too_large,
        quarantined=plan.filter(a == "quarantined").select("path_key", "path", F.col("doc_id").alias("_id")),
        conflicts=plan.filter(a.isin(*CONFLICTS)).select("path_key", "path", kinds[a].alias("kind")),
    )


def _shaped(rows: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the columns of ``docs``; what an ingest does not tell is NULL."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}

    def one(name: str) -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kinds[name]).alias(name)

    return rows.select(*[one(c) for c in columns], "expected_vclock")


def settle(store: DocStore, part: int, disk: DataFrame, applied: Applied, started_at: int) -> DataFrame:
    """Commits a run to ``store`` as one batch; returns its conflicts with other writers.

    Docs, chunks, baselines, skipped and quarantined paths, user conflicts, the disk work
    to do, and the manifest and cursor that the next ``reconcile_needed`` looks at, are seen
    together or not at all.
    """
    done = store.last()
    if done is not None and part <= done:  # a replay
        return store.spark.createDataFrame([], CONFLICT_ROWS)
    held = cut_lineage(store.docs(columns=["_local_seq"]))
    added = applied.docs.select("_id").join(held.select("_id"), "_id", "left_anti").count()
    seen = docs_signature(held).first()
    wrote = 0 if applied.docs.isEmpty() else 1
    cursor = store.spark.range(1).select(
        F.lit("cursor").alias("name"), F.lit(started_at).cast("bigint").alias("last_started_at"),
        F.lit(seen["max_seq"] + wrote).cast("bigint").alias("max_seq"),
        F.lit(seen["doc_count"] + added).cast("bigint").alias("doc_count"),
    )
    now = with_path_key(listing(disk, applied.disk).select("path")).withColumn("part", F.lit(part).cast("bigint"))
    keep = F.lit(False).alias("_gone")
    return store.apply(
        part, applied.docs, applied.chunks,
        tables={
            "baselines": applied.baselines.withColumnRenamed("removed", "_gone"),
            "skipped": applied.skipped.withColumn("_gone", F.col("size_mb").isNull()),
            "quarantined": applied.quarantined.select("*", keep),
            "conflicts": applied.conflicts.select("*", keep),
            "disk": applied.disk.select("*", keep),
            "manifest": now.drop("part").select("*", keep),
            "cursor": cursor.select("*", keep),
        },
    )
