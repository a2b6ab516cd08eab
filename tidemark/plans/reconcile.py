"""Snapshot reconcile: disk, local docs, integration baselines, manifest.

Everything is keyed by the folded path.  The four inputs are unioned and grouped
once, so a whole reconcile costs one shuffle of narrow rows; file bytes are
hashed where they are read and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, content as contentf, ids
from tidemark.operators.chunking import disk_fingerprints, split_into_chunks
from tidemark.operators.classify import Side, relation
from tidemark.operators.clock_ops import dominators
from tidemark.operators.integrity import docs_signature, missing_chunks
from tidemark.operators.paths import with_path_key, with_scope
from tidemark.operators.skew import broadcast_if_small
from tidemark.plans.pull import only_ids
from tidemark.schemas import (
    CLOCK_SKEW_MARGIN_MS,
    DEFAULT_ALG,
    DEFAULT_MAX_FILE_MB,
    FILE_CHUNK_BYTES,
    FILE_SCHEMA_VERSION,
    IDS,
    LARGE_DELETE_SHARE,
)
from tidemark.session import cut_lineage

FILE = "struct<path:string,mtime:bigint,size:bigint,chunks:array<string>>"
DOC = (
    "struct<deleted:boolean,_id:string,vclock:map<string,bigint>,chunks:array<string>,"
    "size:bigint,mtime:bigint>"
)
BASE = (
    "struct<vclock:map<string,bigint>,chunks:array<string>,size:bigint,mtime:bigint,"
    "deleted:boolean>"
)


def keyed_docs(docs: DataFrame) -> DataFrame:
    """Docs with ``path`` and ``path_key``; those that have both are taken as they are."""
    if {"path", "path_key"} <= set(docs.columns):
        return docs
    return with_path_key(docs.withColumn("path", ids.path_of("_id")))


def _doc_struct() -> Column:
    return F.struct(
        F.coalesce("deleted", F.lit(False)).alias("deleted"), "_id",
        clocks.clock("vclock").alias("vclock"), "chunks",
        F.col("size").cast("bigint").alias("size"), F.col("mtime").cast("bigint").alias("mtime"),
    ).cast(DOC)


def _base_struct() -> Column:
    return F.struct(
        clocks.clock("vclock").alias("vclock"), "chunks", "size", "mtime",
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
    ).cast(BASE)


def _side(name: str, file: bool = False) -> Side:
    c = F.col(name)
    if file:
        return Side(F.col("base.vclock"), c["chunks"], c["size"], F.lit(False))
    return Side(c["vclock"], c["chunks"], c["size"], F.coalesce(c["deleted"], F.lit(False)))


def occupants(
    prints: DataFrame, docs: DataFrame, baselines: DataFrame, manifest: DataFrame | None = None
) -> DataFrame:
    """One row per folded path: file, representative doc, baseline, manifest flag.

    An alive doc represents its path before a tombstone does, then the smaller id.
    """

    def part(df: DataFrame, **have: Column) -> DataFrame:
        empty = {"file": FILE, "doc": DOC, "base": BASE, "listed": "int"}
        return df.select(
            "path_key",
            *[have[n].alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in empty.items()],
        )

    file = F.struct("path", F.col("mtime").cast("bigint").alias("mtime"),
                    F.col("size").cast("bigint").alias("size"), "chunks").cast(FILE)
    rows = part(prints, file=file).unionByName(part(keyed_docs(docs), doc=_doc_struct())).unionByName(
        part(baselines, base=_base_struct())
    )
    if manifest is not None:
        rows = rows.unionByName(part(with_path_key(manifest), listed=F.lit(1)))
    live = F.col("doc").isNotNull() & ~F.coalesce(F.col("doc.deleted"), F.lit(False))
    return (
        rows.groupBy("path_key")
        .agg(
            F.count("file").alias("n_files"),
            F.count_if(live).alias("n_alive"),
            F.count("doc").alias("n_docs"),
            F.min("file").alias("file"),
            F.min_by("doc", F.when(F.col("doc").isNotNull(), F.struct("doc.deleted", "doc._id"))).alias("doc"),
            F.first("base", ignorenulls=True).alias("base"),
            F.max("listed").isNotNull().alias("listed"),
        )
        .filter((F.col("n_files") > 0) | (F.col("n_docs") > 0))
    )


def _with_relation(occ: DataFrame) -> DataFrame:
    """Relation of disk file and doc, the baseline clock attributed to the disk."""
    both = F.col("file").isNotNull() & F.col("doc").isNotNull()
    return occ.withColumn("_clock", F.when(both, clocks.relation("base.vclock", "doc.vclock"))).withColumn(
        "relation",
        F.when(
            both,
            relation(
                _side("file", file=True), _side("doc"), _side("base"), F.col("base").isNotNull(),
                attributed=True, clock_relation=F.col("_clock"),
            ),
        ),
    ).drop("_clock")


def classify_files(
    disk: DataFrame, docs: DataFrame, baselines: DataFrame, chunk_bytes: int = FILE_CHUNK_BYTES,
    alg=DEFAULT_ALG,
) -> DataFrame:
    """``(path_key, path, relation)`` of every disk file that has a doc."""
    occ = occupants(disk_fingerprints(disk, baselines, chunk_bytes, alg=alg), docs, baselines)
    return _with_relation(occ).filter(F.col("relation").isNotNull()).select(
        "path_key", F.col("file.path").alias("path"), "relation"
    )


def reconcile_plan(
    disk: DataFrame,
    docs: DataFrame,
    baselines: DataFrame,
    manifest: DataFrame | None,
    device: str,
    previous_devices: Sequence[str] = (),
    chunk_bytes: int = FILE_CHUNK_BYTES,
    local_chunks: DataFrame | None = None,
    remote_chunks: DataFrame | None = None,
    alg=DEFAULT_ALG,
    with_doc: bool = False,
) -> DataFrame:
    """``(path_key, path, action, relation, bucket)``: one action per path, or one
    per variant where spellings collide.  ``with_doc`` adds ``doc_id``, the doc that
    stands for the path, as ``apply_plan`` needs it.

    ``manifest=None`` means "no earlier scan" and differs from an empty table.
    With ``local_chunks`` given, restores and pulls whose chunks are gone become
    quarantined (missing on both sides) or skipped (remote unknown).
    """
    occ = occupants(disk_fingerprints(disk, baselines, chunk_bytes, alg=alg), docs, baselines, manifest)
    # Written once: the plan and the search for clashing spellings both start here.
    rows = cut_lineage(_with_relation(occ))
    crowded = (F.col("n_files") > 1) | (F.col("n_alive") > 1)
    has_file, has_doc = F.col("file").isNotNull(), F.col("doc").isNotNull()
    dead = F.coalesce(F.col("doc.deleted"), F.lit(False))
    based = F.col("base").isNotNull()
    base_dead = F.coalesce(F.col("base.deleted"), F.lit(False))
    rel = F.col("relation")

    vs_base = clocks.relation("doc.vclock", "base.vclock")
    own = F.coalesce(
        clocks.latest_device("doc.vclock").isin(device, *previous_devices), F.lit(False)
    )
    known_here = F.lit(manifest is not None) & (own | F.col("listed"))
    missing_file = (
        F.when(
            based & base_dead,
            F.when(F.col("_vs") == "dominates", "restore")
            .when(F.col("_vs") == "concurrent", "conflict-delete")
            .otherwise("delete"),
        )
        .when(based, F.when(F.col("_vs") == "dominates", "conflict-delete").otherwise("delete"))
        .when(known_here, "delete")
        .otherwise("restore")
    )
    over_tombstone = (
        F.when(rel == "local-edit", "push")
        .when(rel == "remote-edit", "delete-apply")
        .when(rel == "true-divergent", "conflict-recreate")
        .otherwise("error")
    )
    both_alive = (
        F.when(rel == "identical", "align")
        .when(rel == "vclock-only-drift", "vclock-adopt")
        .when(rel == "local-edit", "push")
        .when(rel == "true-divergent", "conflict-edit")
        .otherwise("pull")
    )
    action = (
        F.when(~has_file & (~has_doc | dead), F.when(has_doc & based & ~base_dead, "baseline-align"))
        .when(has_file & ~has_doc, "push")
        .when(has_file & dead, over_tombstone)
        .when(~has_file, missing_file)
        .otherwise(both_alive)
    )
    a = F.col("action")
    bucket = (
        F.when(a.isin("align", "vclock-adopt"), "in-sync")
        .when((a == "push") & has_doc & ~dead, "local-win")
        .when(a.isin("push", "conflict-recreate"), "pushed")
        .when(a.isin("pull", "conflict-edit"), "remote-win")
        .when(a == "restore", "restored")
        .when(a.isin("delete", "delete-apply", "conflict-delete"), "deleted")
    )
    single = (
        rows.filter(~crowded)
        .withColumn("_vs", F.when(~has_file & based, vs_base))
        .withColumn("action", action)
        .filter(a.isNotNull())
        .select(
            "path_key",
            F.coalesce("file.path", ids.path_of("doc._id")).alias("path"),
            "action",
            F.when(has_file, rel).alias("relation"),
            bucket.alias("bucket"),
            F.col("doc._id").alias("doc_id"),
        )
    )
    crowd = path_collisions(
        disk, docs, baselines, chunk_bytes=chunk_bytes, alg=alg, keys=rows.filter(crowded).select("path_key")
    )
    crowd = crowd.filter(F.col("action") != "keep").select(
        "path_key", "path", "action", F.lit(None).cast("string").alias("relation"),
        # The report counts one resolved collision per path: its canonical row.
        F.lit(None).cast("string").alias("bucket"),
        F.when(F.col("action") == "collision-restore", F.concat(F.lit("file:"), "path")).alias("doc_id"),
    ).unionByName(
        crowd.filter(F.col("is_canonical") & (F.col("state") == "resolved")).select(
            "path_key", "path", F.lit("collision-resolved").alias("action"),
            F.lit(None).cast("string").alias("relation"),
            F.lit("collision-resolved").alias("bucket"),
            F.lit(None).cast("string").alias("doc_id"),
        )
    )
    plan = single.unionByName(crowd)
    if local_chunks is not None:
        plan = withhold_broken(plan, docs, local_chunks, remote_chunks)
    return plan if with_doc else plan.drop("doc_id")


def withhold_broken(
    plan: DataFrame, docs: DataFrame, local_chunks: DataFrame, remote_chunks: DataFrame | None
) -> DataFrame:
    """Restores and pulls that cannot be written become quarantined or skipped."""
    plan = cut_lineage(plan)
    takes = F.col("action").isin("restore", "pull", "collision-restore")
    wanted = plan.filter(takes).select(F.col("doc_id").alias("_id"))
    tables = [local_chunks] + ([remote_chunks] if remote_chunks is not None else [])
    broken = missing_chunks(docs.join(wanted, "_id", "left_semi"), *tables).select(
        F.col("_id").alias("doc_id"), F.lit(True).alias("_broken")
    )
    label = "quarantined" if remote_chunks is not None else "skipped"
    stuck = takes & F.coalesce("_broken", F.lit(False))
    return (
        plan.join(broken, "doc_id", "left")
        .withColumn(
            "bucket",
            F.when(stuck, "quarantined" if label == "quarantined" else None).otherwise(F.col("bucket")),
        )
        .withColumn("action", F.when(stuck, label).otherwise(F.col("action")))
        .drop("_broken")
    )


def path_collisions(
    disk: DataFrame,
    docs: DataFrame,
    baselines: DataFrame,
    pending: DataFrame | None = None,
    chunk_bytes: int = FILE_CHUNK_BYTES,
    alg=DEFAULT_ALG,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Folded paths with more than one disk file or alive doc, one row per variant:
    ``(path_key, path, action, state, is_canonical)``.

    resolved: every file is backed by an alive doc of its exact path, all alive
    docs have one chunk list and no file has unpushed edits.  Then the canonical
    variant stays (collision-restore when it is not on disk) and the others are
    dedup-file (delete and tombstone) or tombstone.  Else collision-unresolved.
    ``keys`` names those paths where a caller has counted them already.
    """
    files = with_path_key(disk.select("path"))
    live = keyed_docs(docs.filter(~F.coalesce("deleted", F.lit(False))))
    if keys is None:
        counted = files.select("path_key", F.lit(1).alias("f"), F.lit(0).alias("d")).unionAll(
            live.select("path_key", F.lit(0), F.lit(1))
        )
        keys = cut_lineage(
            counted.groupBy("path_key")
            .agg(F.sum("f").alias("f"), F.sum("d").alias("d"))
            .filter((F.col("f") > 1) | (F.col("d") > 1))
            .select("path_key")
        )
    # Clashes are few: where their checked size allows, files are filtered where they
    # are read, then hashed, and no body is shuffled.
    keys = broadcast_if_small(keys)
    clash_paths = cut_lineage(files.join(keys, "path_key", "left_semi").distinct())
    clash_files = disk.drop("path_key").join(broadcast_if_small(clash_paths), "path")
    clash_docs = live.join(keys, "path_key", "left_semi")
    edits = has_unpushed(clash_files, clash_docs, baselines, pending, chunk_bytes, alg)
    variants = cut_lineage(
        edits.select(
            "path_key", "path", F.lit(1).alias("f"), F.lit(0).alias("d"),
            F.lit(None).cast(IDS).alias("chunks"), F.col("unpushed").alias("_edit"),
        )
        .unionAll(
            clash_docs.select("path_key", "path", F.lit(0), F.lit(1), "chunks", F.lit(False))
        )
        .groupBy("path_key", "path")
        .agg(
            (F.max("f") == 1).alias("has_file"),
            (F.max("d") == 1).alias("has_doc"),
            F.first("chunks", ignorenulls=True).alias("chunks"),
            F.bool_or("_edit").alias("_edit"),
        )
    )
    facts = variants.groupBy("path_key").agg(
        F.bool_and(~F.col("has_file") | F.col("has_doc")).alias("backed"),
        (F.count_if("has_doc") > 0).alias("any_doc"),
        F.min("chunks").eqNullSafe(F.max("chunks")).alias("one_list"),
        F.bool_or(F.coalesce("_edit", F.lit(False))).alias("edited"),
    )
    best = dominators(clash_docs, ["path_key"], id_col="path").select(
        "path_key", F.coalesce("dominator", "smallest").alias("canonical")
    )
    judged = variants.join(facts, "path_key").join(best, "path_key", "left")
    resolved = F.col("backed") & F.col("any_doc") & F.col("one_list") & ~F.col("edited")
    canonical = F.coalesce(F.col("path") == F.col("canonical"), F.lit(False))
    action = (
        F.when(~resolved, "collision-unresolved")
        .when(canonical & F.col("has_file"), "keep")
        .when(canonical, "collision-restore")
        .when(F.col("has_file"), "dedup-file")
        .otherwise("tombstone")
    )
    return judged.select(
        "path_key",
        "path",
        action.alias("action"),
        F.when(resolved, "resolved").otherwise("unresolved").alias("state"),
        (resolved & canonical).alias("is_canonical"),
    )


def reconcile_report(plan: DataFrame, disk: DataFrame) -> DataFrame:
    """One row of counts per bucket, discrepancies, and the large-delete warning."""
    names = {
        "in-sync": "in_sync", "local-win": "local_wins", "remote-win": "remote_wins",
        "pushed": "pushed", "deleted": "deleted", "restored": "restored",
        "quarantined": "quarantined", "collision-resolved": "collisions_resolved",
    }
    counts = plan.agg(*[F.count_if(F.col("bucket") == b).alias(n) for b, n in names.items()])
    total = sum(
        (F.col(n) for n in names.values() if n not in ("in_sync", "quarantined")), F.lit(0)
    )
    one = F.lit(1).alias("_k")
    files = disk.agg(F.count(F.lit(1)).alias("_files"))
    return (
        counts.select("*", one)
        .join(files.select("*", one), "_k")
        .withColumn("discrepancies", total.cast("bigint"))
        .withColumn("large_delete", F.col("deleted") > F.col("_files") * LARGE_DELETE_SHARE)
        .drop("_k", "_files")
    )


def reconcile_needed(
    disk: DataFrame, docs: DataFrame, manifest: DataFrame | None, cursor: DataFrame | None
) -> DataFrame:
    """One row: must the full scan run?  ``cursor``: last_started_at, max_seq,
    doc_count (one row).  NULL inputs mean "never scanned"."""
    spark = disk.sparkSession
    if manifest is None or cursor is None:
        return spark.range(1).select(F.lit(True).alias("needed"))
    def keyed(df: DataFrame) -> DataFrame:
        return df if "path_key" in df.columns else with_path_key(df)

    files = keyed(disk).select("path_key", "mtime", F.lit(1).alias("f"), F.lit(0).alias("m"))
    listed = keyed(manifest).select(
        "path_key", F.lit(None).cast("bigint").alias("mtime"), F.lit(0).alias("f"), F.lit(1).alias("m")
    )
    sets = (
        files.unionByName(listed)
        .groupBy("path_key")
        .agg(F.sum("f").alias("f"), F.max("m").alias("m"), F.max("mtime").alias("mtime"))
        .agg(
            F.coalesce(F.bool_or((F.col("f") > 0) != (F.col("m") > 0)), F.lit(False)).alias("moved"),
            F.coalesce(F.bool_or(F.col("f") > 1), F.lit(False)).alias("twins"),
            F.max("mtime").alias("newest"),
        )
    )
    one = F.lit(1).alias("_k")
    joined = (
        sets.select("*", one)
        .join(docs_signature(docs).select("*", one), "_k")
        .join(
            cursor.select(
                "last_started_at", F.col("max_seq").alias("c_seq"), F.col("doc_count").alias("c_count"), one
            ),
            "_k",
            "left",
        )
    )
    touched = F.coalesce(
        F.col("newest") > F.coalesce("last_started_at", F.lit(0)) - CLOCK_SKEW_MARGIN_MS, F.lit(False)
    )
    same_docs = (F.col("max_seq") == F.col("c_seq")) & (F.col("doc_count") == F.col("c_count"))
    return joined.select(
        (
            F.col("last_started_at").isNull()
            | touched
            | F.col("moved")
            | F.col("twins")
            | ~F.coalesce(same_docs, F.lit(False))
        ).alias("needed")
    )


def has_unpushed(
    disk: DataFrame,
    docs: DataFrame,
    baselines: DataFrame,
    pending: DataFrame | None = None,
    chunk_bytes: int = FILE_CHUNK_BYTES,
    alg=DEFAULT_ALG,
) -> DataFrame:
    """``(path_key, path, unpushed)`` per disk file; bytes are always hashed again.

    ``pending`` (``path``) lists files whose debounce timer still runs.
    """
    known = [c for c in ("path_key",) if c in disk.columns]
    own = disk.select(
        "path", *known, F.col("size").alias("_size"),
        contentf.chunk_list("content", chunk_bytes, alg).alias("_own"),
    )
    # Folded after hashing, so that no bodies queue behind the fold.
    own = own if known else with_path_key(own)
    base = baselines.select("path_key", _base_struct().alias("base"))
    exact = docs.select(ids.path_of("_id").alias("path"), _doc_struct().alias("doc"))
    rows = own.join(base, "path_key", "left").join(exact, "path", "left")
    b, d = F.col("base"), F.col("doc")

    def differs(v: Column) -> Column:
        return ~(F.col("_size").eqNullSafe(v["size"]) & F.col("_own").eqNullSafe(v["chunks"]))

    legacy = b.isNull() | b["chunks"].isNull() | b["size"].isNull()
    doc_ok = d.isNotNull() & ~d["deleted"] & d["chunks"].isNotNull() & d["size"].isNotNull()
    edited = (
        F.when(F.coalesce(b["deleted"], F.lit(False)), True)
        .when(legacy, F.when(doc_ok, differs(d)).otherwise(True))
        .otherwise(differs(b))
    )
    if pending is not None:
        rows = rows.join(pending.select("path", F.lit(True).alias("_p")).distinct(), "path", "left")
        edited = F.coalesce("_p", F.lit(False)) | edited
    return rows.select("path_key", "path", edited.alias("unpushed"))


# --- baselines ------------------------------------------------------------------


def _disk_mtime() -> Column:
    """Stat time to remember: only when the disk size is the doc's size."""
    return F.when(F.col("file.size") == F.col("doc.size"), F.col("file.mtime"))


def update_baselines(
    baselines: DataFrame, docs: DataFrame, disk: DataFrame, mode: str = "align", paths: DataFrame | None = None
) -> DataFrame:
    """Next baselines with an ``label`` per path that has a doc.

    ``align`` keeps the baseline clock and refreshes content (already-aligned,
    upgraded-legacy, recovered-stale, stamped-mtime); a tombstone gives a
    ``deleted`` baseline.  ``establish`` takes over the doc's clock as well
    (established, or already-aligned).  Paths without a doc keep their row, and with
    ``paths`` (``path_key``) all others do: a doc that no plan touched may await a pull.
    """
    stats = disk if "path_key" in disk.columns else with_path_key(disk)
    prints = stats.select("path_key", "path", "mtime", "size", F.lit(None).cast(IDS).alias("chunks"))
    known = baselines
    if paths is not None:
        prints, known = only_ids(prints, paths, "path_key"), only_ids(baselines, paths, "path_key")
        docs = only_ids(keyed_docs(docs), paths, "path_key")
    occ = occupants(prints, docs, known)
    doc, base = F.col("doc"), F.col("base")
    mtime = _disk_mtime()
    has_base = base.isNotNull()
    base_dead = F.coalesce(base["deleted"], F.lit(False))
    legacy = base["chunks"].isNull() | base["size"].isNull()
    same = base["size"].eqNullSafe(doc["size"]) & base["chunks"].eqNullSafe(doc["chunks"])
    clock_same = clocks.relation("base.vclock", "doc.vclock") == "equal"
    stamp_same = mtime.isNull() | base["mtime"].eqNullSafe(mtime)
    dead = doc["deleted"]
    dead_label = F.when(has_base & base_dead & clock_same, "already-aligned").otherwise("deleted")
    if mode == "align":
        label = (
            F.when(dead, dead_label)
            .when(~has_base | legacy, "upgraded-legacy")
            .when(same & (stamp_same | base_dead), "already-aligned")
            .when(same, "stamped-mtime")
            .otherwise("recovered-stale")
        )
        vclock = F.when(has_base, base["vclock"]).otherwise(doc["vclock"])
    else:
        aligned = has_base & ~base_dead & ~legacy & same & clock_same & stamp_same
        label = F.when(dead, dead_label).when(aligned, "already-aligned").otherwise("established")
        vclock = doc["vclock"]
    rows = occ.filter(doc.isNotNull()).withColumn("label", label)
    kept = F.col("label") == "already-aligned"
    stamped = F.col("label") == "stamped-mtime"
    updated = rows.select(
        "path_key",
        F.when(kept, base["vclock"]).when(dead, doc["vclock"]).otherwise(vclock).alias("vclock"),
        F.when(kept, base["chunks"]).when(dead, F.array().cast(IDS)).otherwise(doc["chunks"]).alias("chunks"),
        F.when(kept, base["size"]).when(dead, F.lit(0)).otherwise(doc["size"]).alias("size"),
        F.when(kept, base["mtime"]).when(~dead, mtime).alias("mtime"),
        F.when(kept, base_dead).when(stamped, base_dead).otherwise(dead).alias("deleted"),
        "label",
    )
    others = baselines.join(rows.select("path_key"), "path_key", "left_anti").select(
        "path_key", "vclock", "chunks", "size", "mtime",
        F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit("unchanged").alias("label"),
    )
    return updated.unionByName(others)


# --- disk -> docs, deletes, renames ----------------------------------------------


def ingest_files(
    disk: DataFrame,
    docs: DataFrame,
    baselines: DataFrame,
    device: str,
    include_re: str | None = None,
    exclude_re: str | None = None,
    max_mb: float = DEFAULT_MAX_FILE_MB,
    chunk_bytes: int = FILE_CHUNK_BYTES,
    alg=DEFAULT_ALG,
) -> DataFrame:
    """``(path, path_key, outcome, ...new doc columns)`` for every disk file.

    skipped / out-of-scope / unchanged / held (remote-edit, true-divergent, or a
    legacy baseline the doc moved past) / written: clock + 1, chunks, stat.
    New baselines are the written rows; chunks come from :func:`ingest_chunks`.
    """
    scoped = with_path_key(
        with_scope(disk, include_re, exclude_re, max_mb)
        .withColumn(
            "_own", F.when(F.col("scope") == "in", contentf.chunk_list("content", chunk_bytes, alg))
        )
        .drop("content")
    )
    exact = docs.select(ids.path_of("_id").alias("path"), _doc_struct().alias("doc"))
    base = baselines.select("path_key", _base_struct().alias("base"))
    rows = scoped.join(exact, "path", "left").join(base, "path_key", "left")
    doc, has_doc, has_base = F.col("doc"), F.col("doc").isNotNull(), F.col("base").isNotNull()
    rows = rows.withColumn("_clock", F.when(has_doc, clocks.relation("base.vclock", "doc.vclock")))
    rel = relation(
        Side(F.col("base.vclock"), F.col("_own"), F.col("size"), F.lit(False)),
        _side("doc"), _side("base"), has_base, attributed=True, clock_relation=F.col("_clock"),
    )
    # The clock relation runs from the baseline; the doc moved past it when the
    # baseline is dominated, and without a baseline when the doc has any clock.
    moved_past = F.when(has_base, F.col("_clock") == "dominated").otherwise(
        ~clocks.is_empty("doc.vclock")
    )
    outcome = (
        F.when(F.col("scope") == "skipped", "skipped")
        .when(F.col("scope") == "out", "out-of-scope")
        .when(has_doc & ~doc["deleted"] & doc["chunks"].eqNullSafe(F.col("_own")), "unchanged")
        .when(~has_doc, "written")
        .when(rel.isin("remote-edit", "true-divergent"), "held")
        .when((rel == "legacy-skip") & moved_past, "held")
        .otherwise("written")
    )
    done = F.col("outcome") == "written"
    return rows.withColumn("outcome", outcome).select(
        "path",
        "path_key",
        "outcome",
        F.when(done, F.concat(F.lit("file:"), "path")).alias("_id"),
        F.when(done, F.lit(FILE_SCHEMA_VERSION)).alias("schema_version"),
        F.when(done, F.col("_own")).alias("chunks"),
        F.when(done, F.col("mtime")).alias("mtime"),
        F.when(done, F.col("ctime")).alias("ctime"),
        F.when(done, F.col("size")).alias("size"),
        F.when(done, F.lit(False)).alias("deleted"),
        F.when(done, clocks.increment(F.col("doc.vclock"), device)).alias("vclock"),
    )


def ingest_chunks(disk: DataFrame, plan: DataFrame, chunk_bytes: int = FILE_CHUNK_BYTES, alg=DEFAULT_ALG) -> DataFrame:
    """Chunk rows of the files an ingest wrote, one per id."""
    # Written once: the plan hashes files, and its paths are counted before they are joined.
    written = cut_lineage(plan.filter("outcome = 'written'").select("path"))
    chosen = disk.join(broadcast_if_small(written), "path", "left_semi")
    return split_into_chunks(chosen.select("path", "content"), chunk_bytes, alg).select(
        "_id", "content"
    ).dropDuplicates(["_id"])


def mark_deleted(
    docs: DataFrame, baselines: DataFrame, paths: DataFrame, device: str
) -> DataFrame:
    """``(path, outcome, vclock)`` per path to delete.

    tombstone: clock + 1 and a deleted baseline under that clock; held: the doc
    moved past the baseline (or has a clock and no baseline); baseline-removed:
    no doc; baseline-aligned: already deleted.
    """
    wanted = with_path_key(paths.select("path").distinct()).withColumn(
        "_id", F.concat(F.lit("file:"), "path")
    )
    exact = only_ids(docs, wanted).select("_id", _doc_struct().alias("doc"))
    base = only_ids(baselines, wanted, "path_key").select("path_key", _base_struct().alias("base"))
    rows = wanted.join(exact, "_id", "left").join(base, "path_key", "left")
    outcome = (
        F.when(F.col("doc").isNull(), "baseline-removed")
        .when(F.col("doc.deleted"), "baseline-aligned")
        .when(_moved_past("doc", "base"), "held")
        .otherwise("tombstone")
    )
    return rows.withColumn("outcome", outcome).select(
        "path",
        "path_key",
        "outcome",
        F.when(F.col("outcome") == "tombstone", clocks.increment(F.col("doc.vclock"), device))
        .when(F.col("outcome") == "baseline-aligned", F.col("doc.vclock"))
        .alias("vclock"),
    )


def _moved_past(doc: str, base: str) -> Column:
    """The doc holds a state this device has not integrated yet."""
    return F.when(
        F.col(base).isNotNull(), clocks.relation(f"{doc}.vclock", f"{base}.vclock") == "dominates"
    ).otherwise(~clocks.is_empty(f"{doc}.vclock"))


def delete_folder(docs: DataFrame, baselines: DataFrame, folder: str, device: str) -> DataFrame:
    """:func:`mark_deleted` of every alive doc inside a folder."""
    from tidemark.sources.scan import docs_under_folder

    inside = docs_under_folder(docs, folder).select(ids.path_of("_id").alias("path"))
    return mark_deleted(docs, baselines, inside, device)


def rename_docs(
    renames: DataFrame,
    disk: DataFrame,
    docs: DataFrame,
    baselines: DataFrame,
    device: str,
    chunk_bytes: int = FILE_CHUNK_BYTES,
    alg=DEFAULT_ALG,
) -> DataFrame:
    """``(old_path, path, outcome, vclock, old_outcome, old_vclock, chunks, size, mtime)``.

    ingest: both paths are the same, a plain :func:`ingest_files`; renamed: the new
    doc strictly dominates the old path's tombstone; new-only:
    the old doc awaits a pull and is left alone; held: an unintegrated doc at the
    new path, or a case-only rename of a doc awaiting a pull; gone: the file is no
    longer on disk.  A case-only rename keeps the single baseline row.
    """
    r = with_path_key(with_path_key(renames.select("old_path", "path")), "old_path", "old_key")
    prints = disk.join(broadcast_if_small(renames.select("path").distinct()), "path", "left_semi").select(
        "path", contentf.chunk_list("content", chunk_bytes, alg).alias("chunks"), "size", "mtime"
    )
    wanted = r.select(F.concat(F.lit("file:"), "path").alias("_id")).unionAll(
        r.select(F.concat(F.lit("file:"), "old_path"))
    )
    named = only_ids(docs, wanted).select(ids.path_of("_id").alias("p"), _doc_struct().alias("d"))
    keys = r.select("path_key").unionAll(r.select("old_key"))
    bases = only_ids(baselines, keys, "path_key").select(F.col("path_key").alias("k"), _base_struct().alias("b"))

    def pick(df: DataFrame, key: str, value: str, on: str, out: str) -> DataFrame:
        return df.select(F.col(key).alias(on), F.col(value).alias(out))

    rows = (
        r.join(prints, "path", "left")
        .join(pick(named, "p", "d", "path", "new"), "path", "left")
        .join(pick(named, "p", "d", "old_path", "old"), "old_path", "left")
        .join(pick(bases, "k", "b", "path_key", "new_base"), "path_key", "left")
        .join(pick(bases, "k", "b", "old_key", "old_base"), "old_key", "left")
    )
    same_key = F.col("old_key") == F.col("path_key")
    new_alive = F.col("new").isNotNull() & ~F.coalesce(F.col("new.deleted"), F.lit(True))
    old_alive = F.col("old").isNotNull() & ~F.coalesce(F.col("old.deleted"), F.lit(True))
    rows = (
        rows.withColumn("_new_held", new_alive & _moved_past("new", "new_base"))
        .withColumn("_old_held", old_alive & _moved_past("old", "old_base"))
        .withColumn("_base", clocks.merge("old.vclock", "new.vclock"))
    )
    outcome = (
        F.when(F.col("chunks").isNull(), "gone")
        .when(F.col("old_path") == F.col("path"), "ingest")
        .when(F.col("_new_held") | (F.col("_old_held") & same_key), "held")
        .when(F.col("_old_held"), "new-only")
        .when(old_alive, "renamed")
        .otherwise("new-doc")
    )
    o = F.col("outcome")
    tomb = clocks.increment("_base", device)
    new_clock = (
        F.when(o == "renamed", clocks.increment(clocks.increment("_base", device), device))
        .when(o == "new-only", clocks.increment(F.col("new.vclock"), device))
        .when(o == "new-doc", clocks.increment("_base", device))
    )
    old_outcome = F.when(o == "renamed", "tombstone").when(
        (o == "new-doc") & F.col("old").isNull() & ~same_key, "baseline-removed"
    ).when((o == "new-doc") & F.col("old").isNotNull() & ~same_key, "baseline-aligned")
    return rows.withColumn("outcome", outcome).select(
        "old_path",
        "path",
        "outcome",
        new_clock.alias("vclock"),
        old_outcome.alias("old_outcome"),
        F.when(o == "renamed", tomb).when(old_outcome == "baseline-aligned", F.col("old.vclock")).alias("old_vclock"),
        "chunks",
        "size",
        "mtime",
        same_key.alias("case_only"),
    )
