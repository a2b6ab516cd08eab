"""Comparing the rows of a bucket with each other, with no bucket in one task.

``spread`` gives every row the cells in which it meets others.  A bucket of at most
``limit`` rows is one cell; a larger one is cut by a hash into parts, and every pair
of parts is a cell of its own, so each two rows of a bucket still meet.
``by_cell`` hands whole cells to a function, many small ones at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage


BROADCAST_ROWS = 100_000


def spread(df: DataFrame, keys: list[str], spread_by: Column, limit: int) -> DataFrame:
    """Adds ``cell`` (of bucket and pair of parts), ``part`` and ``same``.

    ``same`` says that the cell is a part met with itself: two rows of one part share
    many cells, but only one such.  The list of large buckets is written and counted;
    it is broadcast (a few bytes a row) up to ``BROADCAST_ROWS`` and joined beyond.
    """
    large = cut_lineage(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_parts"))
    )
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    sized = df.join(large, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    sized = sized.withColumn("part", F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int"))
    met = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("part", "_other"), F.greatest("part", "_other")
    return met.withColumn("cell", F.xxhash64(*keys, low, high)).withColumn(
        "same", F.col("part") == F.col("_other")
    ).drop("_parts", "_other")


def by_cell(
    df: DataFrame, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 65_536
) -> DataFrame:
    """Calls ``fn`` with tables of whole cells, sorted by cell, of about ``rows`` rows.

    A table is longer only where one cell is, and ``spread`` bounds cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held)
            cells = table.column("cell").to_numpy()
            cut = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if cut:
                yield from fn(table.slice(0, cut))
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)
