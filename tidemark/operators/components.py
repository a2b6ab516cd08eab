"""Connected components by alternating large and small stars, in Spark alone.

Every node learns the smallest id of its component.  A round is two groupings with
map-side combining and two joins; a node with very many neighbours is only ever
reduced by ``min``, so it lands in no single task, and its side of a join can be
split by the skew rule.  The number of rounds grows with the logarithm of the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

CHUNK_EDGES = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on ``(a, b)`` with ``a > b``: points neighbours at the minimum."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        return moved  # repeats go with those of the small star
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").filter("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that join what ``edges`` (a, b of long) do, chains within a chunk as stars."""

    def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in batches]) for c in (0, 1))
        ids, at = np.unique(np.r_[a, b], return_inverse=True)
        i, j = at[: len(a)], at[len(a):]
        least, before = np.arange(len(ids)), None
        while before is None or (least != before).any():
            before = least.copy()
            low = np.minimum(least[i], least[j])
            # The smallest number reaches the ends of an edge and what they point at.
            for ends in (i, j, before[i], before[j]):
                np.minimum.at(least, ends, low)
            least = least[least]
        moved = np.flatnonzero(least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[least[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK_EDGES:
                yield stars(held)
                held, count = [], 0
        if count:
            yield stars(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, contract: bool = False) -> DataFrame:
    """``(id, component)`` of every node of ``edges`` (a, b); ids are integers or text.

    Self-loops, repeated edges and either direction are fine; no edges give no rows.
    ``contract`` (ids are longs) first joins the edges that lie in one chunk of a task:
    a bounded step that saves rounds where edges of a component were written together.
    """
    edges = edges.filter("a <> b")
    if contract:
        edges = _contracted(edges)
    now = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = cut_lineage(_star(_star(now, large=True), large=False))
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
