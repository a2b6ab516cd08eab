"""Vector clocks as MAP<STRING,BIGINT> columns.

A missing key counts as 0 and a NULL map as empty.  MAPs cannot be compared or
grouped, so a clock leaves a query as text (:func:`clock_text`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import CLOCK

RELATIONS = ("equal", "dominates", "dominated", "concurrent")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_clock() -> Column:
    return F.create_map().cast(CLOCK)


def clock(c: Column | str) -> Column:
    return F.coalesce(_col(c), empty_clock())


def relation(a: Column | str, b: Column | str) -> Column:
    """``equal / dominates / dominated / concurrent`` of ``a`` against ``b``.

    One pass over the key union sets bit 1 when ``a`` is ahead somewhere and
    bit 2 when it is behind somewhere; the bits index the relation list.
    """
    signs = F.map_values(
        F.map_zip_with(
            clock(a),
            clock(b),
            lambda _k, x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"),
        )
    )
    bits = F.aggregate(
        signs,
        F.lit(0),
        lambda acc, s: acc.bitwiseOR(F.when(s > 0, 1).when(s < 0, 2).otherwise(0)),
    )
    return F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), bits + 1)


def merge(a: Column | str, b: Column | str) -> Column:
    return F.map_zip_with(
        clock(a),
        clock(b),
        lambda _k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("bigint"),
    )


def increment(a: Column | str, device: Column | str) -> Column:
    """One counter + 1. ``device`` is a literal name when given as text."""
    dev = F.lit(device) if isinstance(device, str) else device
    base = clock(a)
    bumped = F.coalesce(F.element_at(base, dev), F.lit(0).cast("bigint")) + F.lit(1).cast("bigint")
    return F.map_concat(F.map_filter(base, lambda k, _v: k != dev), F.create_map(dev, bumped))


def latest_device(a: Column | str) -> Column:
    """Device with the highest counter, ties to the smallest name, NULL if empty."""
    ranked = F.transform(
        F.map_entries(clock(a)),
        lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("device")),
    )
    return F.array_min(ranked)["device"]


def total(a: Column | str) -> Column:
    """Sum of all counters: pointwise order of clocks implies order of totals."""
    return F.aggregate(F.map_values(clock(a)), F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def is_empty(a: Column | str) -> Column:
    return F.size(clock(a)) == 0


def clock_text(a: Column | str) -> Column:
    """Canonical text ``{a:1,b:2}``, keys in byte order."""
    parts = F.transform(
        F.array_sort(F.map_entries(clock(a))),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
