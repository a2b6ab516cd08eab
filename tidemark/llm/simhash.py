"""SimHash near-duplicates, compared in bit slices.

Fingerprints: a bit is set when more than half of the hashes of a text's word
shingles have it.  Equal fingerprints are one node.  By the pigeonhole principle two
fingerprints within the radius agree on enough of the blocks that 64 bits are cut
into; rows meet in one bucket per choice of blocks, so no link is lost.  In a bucket,
64 fingerprints at a time are stored as bit planes; a fingerprint is compared with
all 64 by xor with each plane, differences are counted by carry-save bitwise
counters, and a pair of fingerprint and plane block is abandoned once all 64 lanes
exceed the radius.  Of the matches of a cell only those are returned that join two
parts not yet joined, so groups don't yield all pairs.

Defined results: NULL, empty and blank texts have fingerprint zero and link like any
other; fewer words than a shingle are one shingle; long texts are hashed whole; equal
rows share a component; a NULL doc_id keeps its fingerprint and belongs to the
component of its fingerprint; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buckets import by_cell, spread
from tidemark.llm.common import cut_lineage, row_key, unwrapped, wrapped
from tidemark.llm.components import components, forest

WORDS = 4
RADIUS = 4
HASH_SEED = 42
CELL_ROWS = 1024
BUCKET_ROWS = 64
SLICE = 8  # planes between two looks at which comparisons can be abandoned


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all word shingles of a whole text, repeats included."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    n = max(1, len(ws) - words + 1)
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(ws)) - 1:].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], HASH_SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashed: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as unsigned; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 65_536):
        bits = np.unpackbits(hashed[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of the bits of the hashes of all word shingles, as unsigned."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, key: Column | None = None) -> DataFrame:
    """``(doc_id, fp, key)`` with the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64)), batch.column(1)], ["doc_id", "fp", "key"]
            )

    key = F.lit(None) if key is None else key
    rows = docs.select(F.col("doc_id").cast("long"), key.cast("string").alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long, key string")


def masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which two fingerprints within ``radius`` agree on at least one.

    With ``blocks`` blocks at least ``blocks - radius`` agree.  More blocks give more
    masks of more bits; as many are taken as keep an even bucket short.
    """
    for blocks in range(radius + 1, radius + 5):
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        chosen = [sum(c) for c in combinations(parts, blocks - radius)]
        if rows / 2.0 ** min(m.bit_count() for m in chosen) <= BUCKET_ROWS:
            break
    return chosen


def within(fp: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``(i, j)``, ``i > j``, of equal cells (sorted) within ``radius`` bits."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, size)
    # Lanes: 64 rows of a cell to a block; planes[p, b] has bit p of the block's rows.
    per_cell = (size + 63) // 64
    block0 = np.cumsum(per_cell) - per_cell
    block = np.repeat(block0, size) + place // 64
    lane = (place % 64).astype(np.uint64)
    n_blocks = int(per_cell.sum())
    start = np.repeat(first, per_cell) + 64 * (np.arange(n_blocks) - np.repeat(block0, per_cell))
    length = np.minimum(64, np.repeat(first + size, per_cell) - start)
    planes = np.zeros((64, n_blocks), np.uint64)
    for p in range(64):
        bit = ((fp >> np.uint64(p)) & np.uint64(1)) << lane
        planes[p] = np.bitwise_or.reduceat(bit, start) if n_blocks else 0
    rows_out, mates_out = [], []
    # A row meets its own block and the earlier ones of its cell, some rows at a time.
    meets = place // 64 + 1
    total = np.cumsum(meets)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 500_000, side="right")))
        m = meets[at:upto]
        row = np.repeat(np.arange(at, upto), m)
        blk = np.repeat(block[at:upto] - m + 1, m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
        at = upto
        lanes = np.where(length[blk] == 64, ~np.uint64(0), (np.uint64(1) << length[blk].astype(np.uint64)) - np.uint64(1))
        own = blk == block[row]
        lanes = np.where(own, (np.uint64(1) << lane[row]) - np.uint64(1), lanes)  # earlier rows only
        live = np.flatnonzero(lanes)
        row, blk, lanes = row[live], blk[live], lanes[live]
        # Counters saturate: over marks lanes that have more than radius differences.
        depth = max(1, radius.bit_length())
        count = np.zeros((depth, len(row)), np.uint64)
        over = ~lanes
        value = fp[row]
        for p in range(64):
            carry = planes[p, blk] ^ (np.uint64(0) - ((value >> np.uint64(p)) & np.uint64(1)))
            for d in range(depth):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
            if p % SLICE == SLICE - 1:
                over |= _more_than(count, radius)
                keep = np.flatnonzero(~over)
                if len(keep) < len(row):
                    row, blk, lanes, value = row[keep], blk[keep], lanes[keep], value[keep]
                    count, over = count[:, keep], over[keep]
                if not len(row):
                    break
        if len(row):
            bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, ln = np.nonzero(bits)
            rows_out.append(row[r])
            mates_out.append(start[blk[r]] + ln)
    if not rows_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(mates_out)


def _more_than(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is above ``radius``."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            equal &= count[d]
        else:
            above |= equal & count[d]
            equal &= ~count[d]
    return above


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` over distinct ``(fp, node)`` rows that join all links.

    Every two fingerprints within ``radius`` are joined by a path of edges, each of
    which lies in the same component; edges themselves can be longer than a link.
    """
    chosen = masks(nodes.count(), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    rows = nodes.select(
        "fp", "node", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask", "_m")
    ).withColumn("_key", F.col("fp").bitwiseAND(F.col("_m"))).drop("_m")
    cells = spread(rows, ["mask", "_key"], F.col("node"), CELL_ROWS).select("cell", "fp", "node")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table.column("cell").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        i, j = within(fp, cell, radius)
        if len(i):
            moved, to = forest(i, j, len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[to])], ["a", "b"])

    return by_cell(cells, run, "a long, b long")


def with_component(nodes: DataFrame, radius: int) -> DataFrame:
    """Adds ``component`` to rows of distinct fingerprints: one of those that links reach."""
    # A fingerprint is its own node id: doc_ids need be neither unique nor present.
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    return nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """Adds ``component`` (a fingerprint) and ``component_id`` to fingerprints."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labelled = with_component(nodes, radius)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(labelled.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable by links."""
    prints = cut_lineage(fingerprints(docs, words).drop("key"))
    return _grouped(prints, radius).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the smallest doc_id, NULL last.

    Texts meet a list of row keys and are never grouped; rows that repeat a kept one
    are dropped too.
    """
    rows = wrapped(docs).withColumn("_key", row_key())
    prints = cut_lineage(fingerprints(rows, words, F.col("_key")))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")
    kept = cut_lineage(
        _grouped(prints, radius).groupBy("component").agg(best).select(F.col("best.key").alias("_key"))
    )
    left = rows.join(kept, "_key", "left_semi")
    again = prints.groupBy(F.col("key").alias("_key")).count().filter("count > 1").join(kept, "_key", "left_semi")
    if not again.isEmpty():
        left = left.dropDuplicates(["_key"])
    return unwrapped(left, docs.columns)


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
