"""Near-duplicate embeddings by lattice hashing.

A table projects vectors at random to one or more groups of eight coordinates and
decodes each group to the nearest point of the E8 lattice.  A vector stands in the
cell of its point and probes the cells of the neighbouring points nearest to it;
vectors that meet are compared by cosine in double precision.  Several independent
tables bring the chance to meet at a cosine of 0.9 to about 0.985, and to nearly one
above 0.95.  The tables are the same for any number of vectors, so that links don't
depend on the size of the input; large cells are compared in blocks, by a product in
single precision with a margin first.

Equal vectors are one class and never compared with each other.  A pair that meets
often counts where it meets first: in the lowest table and cell.  No pairs leave a
task, only counts per class and edges that join parts.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite
components link with nothing and are kept; vectors of different length don't link;
labels are ignored; repeated rows are separate vectors; a NULL vec_id takes part and
counts as the largest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buckets import by_cell, spread
from tidemark.llm.common import cut_lineage
from tidemark.llm.components import components, forest

THRESHOLD = 0.9
SEED = 5
SCALE = 2.0
PROBES = 1
CELL_ROWS = 4096
#: Groups to a table, and tables, for any number of vectors: a link that is found does not
#: depend on how many other rows there are.  The chance to meet at a cosine of 0.9 is 0.985.
PLANS = ((None, 1, 6),)
#: Rows that a cell compares with columns at a time.
BLOCK = (512, 2048)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) for s in product((0.5, -0.5), repeat=8) if np.prod(np.sign(s)) > 0]
    return np.array(whole + half)


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``y``: the nearer of two cosets of D8."""

    def even(z: np.ndarray) -> np.ndarray:
        near = np.rint(z)
        off = z - near
        worst = np.abs(off).argmax(axis=1)
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
        return near

    a, b = even(y), even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Tables:
    """Seeded projections and cell numbers for vectors of one length."""

    def __init__(self, dim: int, groups: int, tables: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.maps = rng.normal(size=(tables, groups, dim, 8)) / SCALE
        self.mix = rng.integers(1, 2**63, size=(tables, groups, 8), dtype=np.uint64) | np.uint64(1)
        self.near = neighbours()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``[row, table, cell]`` as 64-bit numbers; cell 0 is the vector's own."""
        out = []
        for maps, mix in zip(self.maps, self.mix):
            total = np.zeros((len(unit), 1), np.uint64)
            for m, x in zip(maps, mix):
                y = unit @ m
                own = decode(y)
                order = np.argsort(-((y - own) @ self.near.T), axis=1, kind="stable")[:, :PROBES]
                points = np.concatenate([own[:, None, :], own[:, None, :] + self.near[order]], axis=1)
                # A point in halves is a vector of integers; its number is a dot product.
                numbers = (np.rint(2 * points).astype(np.int64).view(np.uint64) * x).sum(axis=2, dtype=np.uint64)
                total = (total[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + numbers[:, None, :]).reshape(len(unit), -1)
            out.append(total ^ (total >> np.uint64(29)))
        return np.stack(out, axis=1).view(np.int64)


def _classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: ``(node, vector, n)``; arrays are compared by value."""
    usable = vectors.filter(
        F.exists("embedding", lambda x: x != 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return cut_lineage(
        usable.groupBy(F.col("embedding").alias("vector")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), "vector", "n")
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, vectors)`` by length of the binary vectors of a column."""
    raw = column.to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    found = []
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        flat = np.frombuffer(b"".join(raw[i] for i in rows), dtype).reshape(len(rows), -1)
        found.append((rows, flat.astype(np.float64)))
    return found


@lru_cache(maxsize=8)
def _tables(dim: int, groups: int, tables: int, seed: int) -> Tables:
    return Tables(dim, groups, tables, seed)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _probe_rows(classes: DataFrame, dtype, groups: int, tables: int, seed: int) -> DataFrame:
    """One row per class, table and cell it stands in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            n = batch.column(1).to_numpy()
            vectors = [np.asarray(v, dtype).tobytes() for v in batch.column(2).to_pylist()]
            for rows, x in _matrix(pa.array(vectors, pa.binary()), dtype):
                cells = _tables(x.shape[1], groups, tables, seed).cells(_unit(x))
                raw = pa.array([vectors[i] for i in rows], pa.binary())
                for t in range(tables):
                    for c in range(cells.shape[2]):
                        k = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[rows]), pa.array(n[rows]), raw, pa.array(np.full(k, t, np.int32)),
                             pa.array(np.full(k, x.shape[1], np.int32)), pa.array(cells[:, t, c]),
                             pa.array(np.full(k, c == 0))],
                            ["node", "n", "vector", "table", "dim", "key", "home"],
                        )

    return classes.select("node", "n", "vector").mapInArrow(
        run, "node long, n long, vector binary, table int, dim int, key long, home boolean"
    )


def _first_meeting(own: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, key: int) -> np.ndarray:
    """Pairs (i, j) that meet in no lower table, and in no lower cell of this one."""
    ok = np.ones(len(i), bool)
    for t in range(table + 1):
        a, b = own[i, t], own[j, t]
        # Where j's own cell is one of i's cells, and the reverse.
        to_j = (a == b[:, :1]).any(axis=1)
        to_i = (b == a[:, :1]).any(axis=1)
        if t < table:
            ok &= ~(to_j | to_i)
        else:
            top = np.iinfo(np.int64).max
            lowest = np.minimum(np.where(to_j, b[:, 0], top), np.where(to_i, a[:, 0], top))
            ok &= lowest == key
    return ok


def _compare(dtype, groups: int, tables: int, seed: int, threshold: float):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table.column("cell").to_numpy()
        col = {c: table.column(c).to_numpy() for c in ("node", "n", "table", "key", "home", "part", "same")}
        raw = table.column("vector")
        edges = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            home = col["home"][lo:hi]
            if hi - lo < 2 or not home.any():
                continue
            x = _matrix(raw.slice(lo, hi - lo), dtype)[0][1]  # the length is part of the key
            node, n, part = (col[c][lo:hi] for c in ("node", "n", "part"))
            unit = _unit(x)
            single = unit.astype(np.float32)
            least = np.float32(threshold - 2 * x.shape[1] * np.finfo(np.float32).eps)
            level, key, same = int(col["table"][lo]), int(col["key"][lo]), bool(col["same"][lo])
            own = np.zeros((hi - lo, level + 1, (1 + PROBES) ** groups), np.int64)
            told = np.zeros(hi - lo, bool)
            linked = np.zeros(hi - lo, np.int64)
            moved = to = np.empty(0, np.int64)
            at = np.flatnonzero(home)
            for r, c in product(range(0, len(at), BLOCK[0]), range(0, hi - lo, BLOCK[1])):
                rows = at[r:r + BLOCK[0]]
                near = single[rows] @ single[c:c + BLOCK[1]].T >= least
                ri, ci = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(ri):
                    continue
                i, j = np.nonzero(near[np.ix_(ri, ci)] & (unit[rows[ri]] @ unit[c + ci].T >= threshold))
                i, j = rows[ri][i], c + ci[j]
                # Each pair once; of one part only in the cell where that part meets itself.
                keep = (node[i] != node[j]) & (~home[j] | (node[i] < node[j]))
                keep &= (part[i] != part[j]) | same
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                new = np.unique(np.r_[i, j])
                new = new[~told[new]]
                if len(new):
                    own[new] = _tables(x.shape[1], groups, tables, seed).cells(unit[new])[:, : level + 1]
                    told[new] = True
                first = _first_meeting(own, i, j, level, key)
                np.add.at(linked, i[first], n[j[first]])
                np.add.at(linked, j[first], n[i[first]])
                moved, to = forest(np.r_[moved, i], np.r_[to, j], hi - lo)
            if not len(moved):
                continue
            some = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[node[moved], node[some]]), pa.array(np.r_[node[to], node[some]]),
                 pa.array(np.r_[np.zeros(len(moved), np.int64), linked[some]])],
                ["a", "b", "linked"],
            )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.float32 if element == "float" else np.float64
    if dtype is np.float64 and element != "double":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    classes = _classes(vectors)
    (_, groups, tables), = PLANS
    rows = _probe_rows(classes, dtype, groups, tables, seed)
    cells = spread(rows, ["table", "dim", "key"], F.col("node"), CELL_ROWS)
    cells = cells.select("cell", "node", "n", "vector", "table", "key", "home", "part", "same")
    met = cut_lineage(
        by_cell(cells, _compare(dtype, groups, tables, seed, threshold), "a long, b long, linked long", rows=8192)
    )
    counted = met.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    found = components(met.filter("a <> b").select("a", "b")).withColumnRenamed("id", "node")
    labelled = classes.join(counted, "node", "left").join(found, "node", "left").select(
        "vector", "n", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "node").alias("component")
    )
    all_rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    joined = cut_lineage(all_rows.join(labelled, "vector", "left").select("vec_id", "n", "linked", "component"))
    least = joined.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("_least"))
    return joined.join(least, "component", "left").select(
        "vec_id",
        F.coalesce(F.col("n") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_least", "vec_id"), F.lit(True)).alias("kept"),
    )
