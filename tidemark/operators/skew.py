"""Joins and windows that stay balanced when one key holds a large share.

A key is *hot* when it has more than ``hot_rows`` rows, so there are at most
``rows / hot_rows`` hot keys: the hot-key table has a proven bound and may be
broadcast, whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import cut_lineage

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, _splits)`` of the keys above ``hot_rows`` rows; map-side counted."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > hot_rows) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_splits"))
    )


def salted_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` (keys may be hot) to ``one`` (keys unique) on ``key``.

    Hot keys are found first, in one pass counted map-side; without any (the
    usual case) this is a plain join.  Otherwise rows of a hot key are spread
    over ``_splits`` salts by a hash of ``spread_by``, and only the matching row
    of ``one`` is repeated, as often as that key needs.  ``how`` is inner, left,
    left_semi or left_anti.  ``hot`` is a written :func:`hot_keys` of the same rows, or
    of more, where it is at hand.
    """
    found = cut_lineage(hot_keys(many, key, hot_rows)) if hot is None else hot
    if found.isEmpty():
        return many.join(one, key, how)
    hot = broadcast_if_small(found)
    salted = many.join(hot, key, "left").withColumn(
        "_salt",
        F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_splits"), F.lit(1))).cast("int"),
    ).drop("_splits")
    copies = one.join(hot, key, "left").withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)),
    ).drop("_splits")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


SMALL_ROWS = 200_000
SMALL_BYTES = 32 << 20


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Checked size in rows and in bytes of text; counted map-side, no row is moved."""
    texts = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("string", "binary")]
    wide = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(8 * len(df.columns)))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a narrow key table of checked size; else a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


SLICE_ROWS = 100_000
MAX_SLICES = 1024


def _cuts(df: DataFrame, order: str, slices: int | None) -> list:
    """Equal-depth cut points of one numeric column (at most ``MAX_SLICES`` values).

    Where ``slices`` is not given it follows the number of rows.
    """
    if slices is None:
        slices = max(1, min(MAX_SLICES, df.count() // SLICE_ROWS))
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    row = df.agg(F.percentile_approx(order, shares, 10 * slices).alias("c")).first()
    return sorted(set(row["c"] or []))


def slice_no(order: Column | str, cuts: Sequence) -> Column:
    """Number of cut points at or below the value: monotone in ``order``."""
    o = F.col(order) if isinstance(order, str) else order
    # No lambda: the optimizer would carry its variable into filters it infers for
    # the other side of a join, where the column it captures does not exist.
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(o < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(o.isNull(), 0).otherwise(search(0, len(cuts))) if cuts else F.lit(0)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    slices: int | None = None,
    cuts: Sequence | None = None,
) -> DataFrame:
    """``lag`` by key where one key may hold a large share of all rows.

    The first order column is cut into equal-depth ranges, ``slices`` of them or as many
    as the rows ask for, and rows
    are windowed per ``(keys, range)``.  Only the last row of each range is
    carried to the next range of the same key, so no task ever sees more than
    one range of a key.  ``values`` maps source column to output column.
    """
    keys = list(keys)
    if cuts is None:
        cuts = _cuts(df, order[0], slices)
    cut = df.withColumn("_slice", slice_no(order[0], cuts))
    # Tagged as a struct so that a carried NULL value differs from "no row".
    payload = F.struct(*[F.col(c) for c in values])
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = cut.withColumn("_prev", F.lag(payload).over(inner))

    last = cut.groupBy(*keys, "_slice").agg(
        F.max(F.struct(*[F.col(c) for c in order], payload.alias("_p"))).alias("_last")
    )
    outer = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(
        *keys, "_slice", F.lag(F.col("_last._p")).over(outer).alias("_carry")
    ).filter(F.col("_carry").isNotNull())

    first = F.row_number().over(inner) == 1
    joined = local.withColumn("_first", first).join(carried, [*keys, "_slice"], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    out = joined.withColumn("_prev", prev)
    for source, target in values.items():
        out = out.withColumn(target, F.col("_prev")[source])
    return out.drop("_prev", "_carry", "_first", "_slice")


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, slices: int | None = None
) -> DataFrame:
    """Adds ``out``: the largest ``value`` up to and with this row of its key.

    Sliced like :func:`previous_row`: a task sees one range of a key, and the
    maxima of a key's ranges.
    """
    keys = list(keys)
    cut = df.withColumn("_slice", slice_no(order[0], _cuts(df, order[0], slices))).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, "_slice").agg(F.max("_value").alias("_top"))
    carried = tops.select(*keys, "_slice", F.max("_top").over(outer).alias("_carry"))
    local = cut.withColumn("_local", F.max("_value").over(inner))
    joined = local.join(carried, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.greatest("_local", "_carry")).drop("_slice", "_value", "_local", "_carry")


def newest_cut(df: DataFrame, order: Sequence[str], keep: int, fanout: int = 4096) -> Column | None:
    """Predicate that keeps exactly the ``keep`` largest rows by integer columns.

    The boundary tuple is found by histogram descent: each pass counts at most
    ``fanout`` equal-width ranges of the one column being narrowed, so neither a
    global sort nor a single-task window is needed.  ``order`` must identify a
    row.  Returns NULL when nothing has to go.
    """
    remaining, scope, keep_if = keep, F.lit(True), F.lit(False)
    n = df.count()
    if n <= keep:
        return None
    tied = F.lit(True)
    for name in order:
        c = F.col(name)
        lo, hi = df.filter(scope).agg(F.min(c), F.max(c)).first()
        while lo < hi:
            width = max(1, -(-(hi - lo + 1) // fanout))
            bucket = F.floor((c - F.lit(lo)) / F.lit(width)).cast("bigint")
            counts = (
                df.filter(scope & c.between(lo, hi))
                .groupBy(bucket.alias("b"))
                .count()
                .orderBy(F.desc("b"))
                .collect()
            )
            for r in counts:
                if r["count"] >= remaining:
                    lo, hi = lo + r["b"] * width, min(hi, lo + (r["b"] + 1) * width - 1)
                    break
                remaining -= r["count"]
        keep_if = keep_if | (tied & (c > lo))
        tied = tied & (c == lo)
        scope = scope & (c == lo)
    return keep_if | tied


def typed_null(dtype: T.DataType | str) -> Column:
    return F.lit(None).cast(dtype)
