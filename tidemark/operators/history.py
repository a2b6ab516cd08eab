"""Revision history: capture, churn, lineage, retention."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.content import is_diffable_text, line_churn
from tidemark.operators.paths import matches_any
from tidemark.operators.skew import HOT_ROWS, broadcast_if_small, is_small, previous_row, salted_join
from tidemark.schemas import DAY_MS
from tidemark.session import cut_lineage


def churn(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds ``added`` and ``removed`` line counts between two text columns.

    Only pairs that differ go to Python; equal ones are answered natively.
    """
    differ = ~F.col(old).eqNullSafe(F.col(new))
    out = df.withColumn(
        "_churn", line_churn(F.when(differ, F.col(old)), F.when(differ, F.col(new)))
    )
    return out.withColumn("added", F.col("_churn.added")).withColumn("removed", F.col("_churn.removed")).drop("_churn")


def capture_revisions(
    versions: DataFrame, exclude: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """One revision per changed diffable version of a file, in time order.

    ``versions``: ``(file_path, timestamp, content, source)``.  Dot-paths and
    excluded globs are left out; a version equal to the one before makes none.
    """
    in_scope = ~F.col("file_path").startswith(".") & ~matches_any("file_path", exclude)
    texts = versions.filter(in_scope & is_diffable_text(F.encode("content", "UTF-8"))).withColumn(
        "_hash", F.sha2(F.encode("content", "UTF-8"), 256)
    )
    # Digests are compared and linked; texts are looked up for the rows that are left.
    light = cut_lineage(texts.drop("content"))
    before = previous_row(light, ["file_path"], ["timestamp"], {"_hash": "_old"}, slices)
    changed = cut_lineage(
        before.withColumn("base_hash", F.coalesce("_old", F.sha2(F.lit(b""), 256))).drop("_old")
        .filter(F.col("base_hash") != F.col("_hash"))
    )
    linked = cut_lineage(
        previous_row(changed, ["file_path"], ["timestamp"], {"timestamp": "parent_timestamp"}, slices)
    )
    asked = linked.select("_hash").unionAll(linked.select(F.col("base_hash").alias("_hash"))).distinct()
    bodies = texts.select("_hash", "content").join(broadcast_if_small(cut_lineage(asked)), "_hash", "left_semi")
    bodies = bodies.dropDuplicates(["_hash"])
    old = bodies.select(F.col("_hash").alias("base_hash"), F.col("content").alias("_before"))
    spread = ["file_path", "timestamp"]
    pairs = salted_join(salted_join(linked, bodies, "_hash", spread), old, "base_hash", spread)
    counted = churn(pairs.withColumn("_before", F.coalesce("_before", F.lit(""))), "_before", "content")
    return counted.select(
        *versions.columns, "base_hash", "added", "removed", "parent_timestamp", F.lit(False).alias("conflict")
    )


def link_chain(revisions: DataFrame, slices: int | None = None) -> DataFrame:
    """``parent_id`` = previous id of the file by time."""
    return previous_row(
        revisions.drop("parent_id"), ["file_path"], ["timestamp", "id"], {"id": "parent_id"}, slices
    )


def chain_heads(revisions: DataFrame) -> DataFrame:
    """Last revision per file."""
    return revisions.groupBy("file_path").agg(
        F.max_by("id", F.struct("timestamp", "id")).alias("head_record_id")
    )


def file_history(revisions: DataFrame, path: str, since: int | None = None) -> DataFrame:
    rows = revisions.filter(F.col("file_path") == path)
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= since)
    return rows.orderBy("timestamp", "id")


def lineage(
    revisions: DataFrame, heads: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per revision: ``depth`` (root 0), ``root_id``, ``cyclic``, ``on_head_path``,
    ``subtree_size`` and ``fork_id``, the deepest ancestor-or-self it shares with
    the head (NULL when there is none).

    Ancestor doubling: after round k every row knows its 2^k-th ancestor, the
    descendants within that distance, and the nearest head-path ancestor, so a
    chain of n revisions takes log2(n) self-joins.  Finished rows leave the join.
    Rows whose walk never ends are in or behind a cycle; they are cut there:
    depth and root stay NULL, and their head-path facts are found the same way.
    """
    own = revisions.select("file_path", "id", "parent_id")
    known = own.select("file_path", F.col("id").alias("_pid"))
    # A parent that is not in the table ends the walk.
    start = (
        own.withColumnRenamed("parent_id", "_pid")
        .join(known.withColumn("_ok", F.lit(True)), ["file_path", "_pid"], "left")
        .select("file_path", "id", F.when(F.col("_ok"), F.col("_pid")).alias("anc"))
    )
    head_ids = _head_path(start, heads)
    state = cut_lineage(
        start.join(head_ids.withColumn("_h", F.lit(True)), ["file_path", "id"], "left").select(
            "file_path",
            "id",
            "anc",
            F.lit(0).cast("bigint").alias("depth"),
            F.lit(1).cast("bigint").alias("size"),
            F.coalesce("_h", F.lit(False)).alias("on_head"),
            F.when(F.col("_h"), F.col("id")).alias("fork"),
            F.col("id").alias("top"),
        )
    )
    # No acyclic walk is longer than the number of revisions of the largest file.
    longest = state.groupBy("file_path").count().agg(F.max("count")).first()[0] or 0
    for k in count():  # ends by the length of the longest possible walk
        open_rows = state.filter(F.col("anc").isNotNull())
        if open_rows.isEmpty() or (1 << k) > longest:
            break
        step = 1 << k
        grown = open_rows.groupBy("file_path", F.col("anc").alias("id")).agg(F.sum("size").alias("_more"))
        ahead = state.select(
            "file_path", F.col("id").alias("anc"), F.col("anc").alias("_anc2"),
            F.col("depth").alias("_d2"), F.col("fork").alias("_f2"), F.col("top").alias("_t2"),
        )
        moved = _by_ancestor(open_rows, ahead, hot_rows).select(
            "file_path", "id", F.col("_anc2").alias("anc"),
            (F.lit(step) + F.col("_d2")).cast("bigint").alias("depth"), "size", "on_head",
            F.coalesce("fork", "_f2").alias("fork"), F.col("_t2").alias("top"),
        )
        state = cut_lineage(
            state.filter(F.col("anc").isNull())
            .unionByName(moved)
            .join(grown, ["file_path", "id"], "left")
            .withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0)))
            .drop("_more")
        )
    cyclic = F.col("anc").isNotNull()
    return state.select(
        "file_path",
        "id",
        F.when(~cyclic, F.col("depth")).alias("depth"),
        F.when(~cyclic, F.col("top")).alias("root_id"),
        cyclic.alias("cyclic"),
        F.col("on_head").alias("on_head_path"),
        F.when(~cyclic, F.col("size")).alias("subtree_size"),
        F.col("fork").alias("fork_id"),
    )


def _by_ancestor(rows: DataFrame, ahead: DataFrame, hot_rows: int) -> DataFrame:
    """Join on (file, ancestor); very many revisions may share one ancestor."""
    key = F.struct("file_path", "anc")
    left = rows.withColumn("_k", key)
    right = ahead.withColumn("_k", key).drop("file_path", "anc")
    return salted_join(left, right, "_k", ["id"], "inner", hot_rows).drop("_k", "anc")


def _head_path(start: DataFrame, heads: DataFrame) -> DataFrame:
    """``(file_path, id)`` from each head to its root, cycles walked once.

    The set doubles each round: rows reached so far are joined with jump
    pointers of the same length, so n steps take log2(n) rounds.
    """
    jumps = cut_lineage(start)
    seeds = heads.filter(F.col("head_record_id").isNotNull()).select(
        "file_path", F.col("head_record_id").alias("id")
    )
    reached = cut_lineage(seeds.join(jumps.select("file_path", "id"), ["file_path", "id"], "left_semi"))
    size = reached.count()
    while True:  # the set only grows, and stops when a round adds nothing
        next_ids = reached.join(jumps, ["file_path", "id"]).filter(F.col("anc").isNotNull())
        grown = cut_lineage(
            reached.unionAll(next_ids.select("file_path", F.col("anc").alias("id"))).distinct()
        )
        now = grown.count()
        ahead = jumps.select("file_path", F.col("id").alias("anc"), F.col("anc").alias("_anc2"))
        reached = grown
        if now == size:
            break
        size = now
        jumps = cut_lineage(
            jumps.filter(F.col("anc").isNotNull())
            .join(ahead, ["file_path", "anc"], "left")
            .select("file_path", "id", F.col("_anc2").alias("anc"))
            .unionByName(jumps.filter(F.col("anc").isNull()))
        )
    return reached


def revision_content(
    revisions: DataFrame, heads: DataFrame, picks: DataFrame, facts: DataFrame | None = None
) -> DataFrame:
    """``(file_path, id, content)`` per picked revision.

    NULL without a head row, with a NULL head, for an unknown revision, or when
    it shares no ancestor with the head.  The head itself gives the head text.
    ``facts`` is the result of :func:`lineage` where already at hand.
    """
    facts = facts if facts is not None else lineage(revisions, heads)
    forks = facts.select("file_path", "id", "fork_id")
    tops = heads.select("file_path", "head_record_id")
    asked = picks.select("file_path", "id").join(forks, ["file_path", "id"], "left")
    # Which text each pick gets is settled before any text is moved.
    told = cut_lineage(
        salted_join(asked, tops, "file_path", ["id"]).select(
            "file_path", "id",
            F.when(F.col("head_record_id") == F.col("id"), "head").when(F.col("fork_id").isNotNull(), "own").alias("_from"),
        )
    )
    keys = ["file_path", "id"]
    own, top = told.filter("_from = 'own'").select(keys), told.filter("_from = 'head'").select(keys)
    texts = revisions.select(*keys, "content").join(broadcast_if_small(own.distinct()), keys, "left_semi")
    shown = heads.select("file_path", "content").join(broadcast_if_small(top.select("file_path").distinct()), "file_path", "left_semi")
    return (
        own.join(texts, keys, "left").unionByName(top.join(shown, "file_path", "left"))
        .unionByName(told.filter("_from is null").select(*keys, F.lit(None).cast("string").alias("content")))
    )


def restore(heads: DataFrame, picks: DataFrame) -> DataFrame:
    """Heads moved to the picked revision (``file_path, id, content``, content as
    given by :func:`revision_content`); a NULL text restores nothing."""
    chosen = picks.filter(F.col("content").isNotNull()).select(
        "file_path", F.col("id").alias("_id"), F.col("content").alias("_c")
    )
    return heads.join(chosen, "file_path", "left").select(
        "file_path",
        F.coalesce("_c", "content").alias("content"),
        F.coalesce("_id", "head_record_id").alias("head_record_id"),
    )


def record_conflicts(resolutions: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(revisions, heads)`` after resolved conflicts.

    ``resolutions``: ``(file_path, local_content, remote_content, winner, id,
    timestamp)``.  The revision is flagged, its churn runs from winner to loser,
    its parent is the old head; the head text becomes the winner's.
    """
    local_won = F.col("winner") == "local"
    rows = resolutions.select(
        "file_path", "id", "timestamp",
        F.when(local_won, F.col("local_content")).otherwise(F.col("remote_content")).alias("content"),
        F.when(local_won, F.col("remote_content")).otherwise(F.col("local_content")).alias("_loser"),
    )
    parents = heads.select("file_path", F.col("head_record_id").alias("parent_id"))
    revisions = (
        churn(rows, "content", "_loser")
        .join(parents, "file_path", "left")
        .select(
            "id", "file_path", "timestamp", F.sha2(F.encode("content", "UTF-8"), 256).alias("base_hash"),
            "added", "removed", F.lit(True).alias("conflict"), F.lit("local").alias("source"),
            "parent_id", "content",
        )
    )
    moved = rows.select("file_path", "content", F.col("id").alias("head_record_id"))
    next_heads = heads.select("file_path", "content", "head_record_id").join(
        moved.select("file_path"), "file_path", "left_anti"
    ).unionByName(moved)
    return revisions, next_heads


def history_retention(revisions: DataFrame, now: int, days: int) -> DataFrame:
    return revisions.filter(F.col("timestamp") >= now - days * DAY_MS)


def rename_history(
    revisions: DataFrame, heads: DataFrame, renames: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``old_path`` move to ``new_path``; a head already there is replaced.

    A list of renames of checked size goes to the texts; for a longer one a file's
    revisions are spread by their ids.
    """
    moves = cut_lineage(renames.select(F.col("old_path").alias("file_path"), "new_path"))
    small = is_small(moves)

    def moved(df: DataFrame) -> DataFrame:
        if small:
            met = df.join(F.broadcast(moves), "file_path", "left")
        else:
            met = salted_join(df, moves, "file_path", ["id"] if "id" in df.columns else ["file_path"])
        return met.withColumn("file_path", F.coalesce("new_path", "file_path"))

    arriving = moved(heads.join(moves.select("file_path"), "file_path", "left_semi")).drop("new_path")
    staying = heads.join(moves.select("file_path"), "file_path", "left_anti").join(
        arriving.select("file_path"), "file_path", "left_anti"
    )
    return moved(revisions).drop("new_path"), staying.unionByName(arriving)


def clear_history(revisions: DataFrame, heads: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = paths.select("file_path").distinct()
    return (
        revisions.join(gone, "file_path", "left_anti"),
        heads.join(gone, "file_path", "left_anti"),
    )


def history_totals(revisions: DataFrame) -> DataFrame:
    return revisions.agg(F.count(F.lit(1)).alias("revisions"), F.min("timestamp").alias("oldest"))
