"""Near copies by SimHash and MinHash of word shingles, verified by exact Jaccard similarity.

Texts of equal shingle sets are one node.  First come SimHash fingerprints of the sets:
fingerprints within ``RADIUS`` bits are linked (``simhash.links``, which loses no such
pair), and nodes whose fingerprints links reach are compared.  A pair at a similarity of
0.8 differs in 10 of 64 bits on average, more than an exact search over blocks can take,
so the texts that SimHash left apart meet in MinHash bands over the same hashes: with
``BANDS`` bands of ``BAND_ROWS`` minima two texts at exactly 0.8 meet with a chance of
0.9999, more similar ones with more.  All that meet are compared by their whole shingle
sets, and only links that reach the threshold go into the component search.  A few bands
come before the others, and only groups are compared that still hold different
components.  Of the links of a cell only a spanning forest is returned, so groups don't
yield all pairs.

Defined results: letters are folded in ASCII only; fewer words than a shingle are one
shingle; NULL, empty and blank texts are copies of each other and of nothing else;
long texts are compared whole; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buckets import by_cell, spread
from tidemark.llm.common import cut_lineage, row_key, unwrapped, wrapped
from tidemark.llm.components import components
from tidemark.llm.simhash import hashes, majority, with_component

WORDS = 5
SIMILARITY = 0.8
BAND_ROWS = 5
BANDS = 24
FIRST_BANDS = 2
RADIUS = 6
CELL_ROWS = 1024
_RNG = np.random.default_rng(7)
TIMES = _RNG.integers(1, 2**63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 2**63, size=BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    return np.unique(hashes(text, words))


def bands(found: np.ndarray) -> list[int]:
    """A signed number for each band of the minima of a shingle set; none if empty."""
    if not len(found):
        return []
    least = np.full(len(TIMES), ~np.uint64(0))
    for at in range(0, len(found), 1024):
        some = found[at:at + 1024]
        mixed = some[None, :] * TIMES[:, None] + PLUS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    total = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64).tolist()


def _sketches(rows: DataFrame) -> DataFrame:
    """``(doc_id, key, node, fp, bands)``: equal shingle sets share a node and a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            node, prints, marks = [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py())
                node.append(xxh3_128_hexdigest(found.tobytes()))
                prints.append(majority(found))
                marks.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.string()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "key", "node", "fp", "bands"],
            )

    source = rows.select(F.col("doc_id").cast("long"), F.col("_key").alias("key"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, key string, node string, fp long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``(node, shingles)`` of rows ``(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t.as_py()).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return rows.select("node", F.col("text").cast("string")).mapInArrow(run, "node string, shingles binary")


def joined(sets: list[np.ndarray], part: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of at least ``similarity`` that join all sets which such links join.

    Sets of equal ``part`` are joined already: they are never compared.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    stop = np.cumsum(size)
    flat = np.concatenate(sets)
    _, number = np.unique(flat, return_inverse=True)
    mark = np.zeros(number.max() + 1, np.int8)
    left = np.ones(len(sets), bool)
    out = []
    while left.any():
        start = np.flatnonzero(left)[0]
        waiting = np.flatnonzero(left & (part == part[start])).tolist()
        left[waiting] = False
        while waiting and left.any():
            a = waiting.pop()
            near = left & (np.minimum(size, size[a]) >= similarity * np.maximum(size, size[a]) - 1e-9)
            if not near.any():
                continue
            own = number[stop[a] - size[a]:stop[a]]
            mark[own] = 1
            both = np.add.reduceat(mark[number], stop - size, dtype=np.int64)
            mark[own] = 0
            for b in np.flatnonzero(near & (both >= similarity * (size + size[a] - both) - 1e-9)).tolist():
                if left[b]:
                    out.append((b, a))
                    more = np.flatnonzero(left & (part == part[b]))
                    left[more] = False
                    waiting += more.tolist()
    return out


def _verified(similarity: float):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table.column("cell").to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        a, b = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo < 2:
                continue
            node = table.column("node").slice(lo, hi - lo).to_pylist()
            _, part = np.unique(np.array(table.column("component").slice(lo, hi - lo).to_pylist()), return_inverse=True)
            if not part.any():
                continue
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles").slice(lo, hi - lo)]
            for i, j in joined(sets, part, similarity):
                a.append(node[i])
                b.append(node[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _links(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified edges ``(a, b)`` between components of ``(node, key, bands, component)``."""
    met = nodes.select("node", "component", F.posexplode("bands").alias("band", "bucket"))
    crowded = met.groupBy("band", "bucket").agg(F.min("component").alias("_l"), F.max("component").alias("_h"))
    met = cut_lineage(met.join(crowded.filter("_l <> _h").select("band", "bucket"), ["band", "bucket"]))
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("key").alias("_key"))
    sets = cut_lineage(_sets(texts.join(wanted, "_key").select("node", "text")).dropDuplicates(["node"]))
    cells = spread(met, ["band", "bucket"], F.col("node"), CELL_ROWS).select("cell", "node", "component")
    return by_cell(cells.join(sets, "node"), _verified(similarity), "a string, b string", rows=1024)


def _grouped(rows: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """``(node, component)`` of every shingle set."""
    nodes = cut_lineage(
        marks.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    )
    prints = with_component(cut_lineage(nodes.select("fp").distinct()), RADIUS).withColumnRenamed("component", "near")
    # An empty set is like no other; it has no bands and meets none here either.
    near = F.when(F.size("bands") > 0, F.array("near")).otherwise(F.array().cast("array<long>"))
    nodes = cut_lineage(
        nodes.join(prints, "fp").withColumn("near", near).withColumn("component", F.col("node")).drop("fp")
    )
    first, rest = F.slice("bands", 1, FIRST_BANDS), F.slice("bands", 1 + FIRST_BANDS, BANDS - FIRST_BANDS)
    for buckets in (F.col("near"), first, rest):
        some = nodes.withColumn("bands", buckets)
        edges = _links(some, rows.select("_key", "text"), similarity)
        # Edges join nodes; what was one component before stays one.
        before = nodes.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(edges.unionByName(before)).withColumnRenamed("component", "_to").withColumnRenamed("id", "node")
        nodes = cut_lineage(
            nodes.join(found, "node", "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")
        )
    return nodes.select("node", "component")


def without_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near copies: the smallest doc_id, NULL last.

    Rows that repeat a kept one are dropped too.
    """
    rows = wrapped(docs).withColumn("_key", row_key())
    marks = cut_lineage(_sketches(rows))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")
    kept = cut_lineage(
        marks.join(_grouped(rows, marks, similarity), "node").groupBy("component").agg(best)
        .select(F.col("best.key").alias("_key"))
    )
    left = rows.join(kept, "_key", "left_semi")
    again = marks.groupBy(F.col("key").alias("_key")).count().filter("count > 1").join(kept, "_key", "left_semi")
    if not again.isEmpty():
        left = left.dropDuplicates(["_key"])
    return unwrapped(left, docs.columns)
