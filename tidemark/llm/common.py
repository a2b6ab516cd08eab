"""Helpers that the training-data operators share.

``SPACE`` is the white space that separates words everywhere in this package.
Ranks and running totals over a key that may hold a third of all rows are made in
two levels: each key is cut into slices of a uniform hash, slices are summed first
(combined map-side), and only the rows of one slice meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage, shared_dir

__all__ = [
    "SPACE", "cut_lineage", "fold_of", "hash_slice", "null_last", "n_slices", "row_key",
    "running_total", "shared_dir", "unwrapped", "words", "wrapped",
]

SPACE = " \t\n\x0b\x0c\r"
MAX_SLICES = 65_536
ROWS_PER_SLICE = 128


def words(text: Column) -> Column:
    """The maximal runs of other characters than ``SPACE``; none for NULL."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(plain, " "), "")


def null_last(text: Column) -> Column:
    """A key that joins and sorts like ``text`` by code point, with NULL last."""
    return F.coalesce(F.concat(F.lit("="), text), F.lit("~"))


def fold_of(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def row_key() -> Column:
    """A hash of doc_id and text: equal rows share it, other rows don't."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", doc_id, F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))).cast("binary"))


USED = ("doc_id", "text")


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no names clash inside."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in USED]
    return docs.select(*USED, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_rest"))


def unwrapped(df: DataFrame, columns: Sequence[str], **changed: Column) -> DataFrame:
    """``columns`` again: as ``changed``, as they are, or from what was wrapped."""
    return df.select(*[
        (changed[c] if c in changed else F.col(c) if c in USED else F.col("_rest")[c]).alias(c) for c in columns
    ])


def n_slices(rows: int) -> int:
    """Slices in proportion to the rows, bounded, so that offsets stay small."""
    return max(1, min(MAX_SLICES, rows // ROWS_PER_SLICE))


def hash_slice(hex_key: Column, slices: int) -> Column:
    """Slice of a hexadecimal hash; follows the order of the hash."""
    head = F.conv(F.substring(hex_key, 1, 4), 16, 10).cast("long")
    return F.floor(head * slices / F.lit(65_536)).cast("int")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[Column | str],
    weight: Column,
    out: str,
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all earlier rows of the same keys.

    ``slice_col`` must not fall along ``order``.  A key has at most ``MAX_SLICES``
    slices, so the window over slices is bounded whatever one key holds.  Keys must
    not be NULL.
    """
    keys = list(keys)
    sums = df.groupBy(*keys, slice_col).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, slice_col, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        df.join(offsets, [*keys, slice_col])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_offset")
    )
