"""The six-way relation of two versions of a path, and what a pull makes of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks


@dataclass(frozen=True)
class Side:
    """Columns of one version: clock, ordered chunk ids, size, deleted flag."""

    vclock: Column
    chunks: Column
    size: Column
    deleted: Column

    @classmethod
    def of(cls, prefix: str = "", deleted: bool = True) -> Side:
        return cls(
            F.col(f"{prefix}vclock"),
            F.col(f"{prefix}chunks"),
            F.col(f"{prefix}size"),
            F.coalesce(F.col(f"{prefix}deleted"), F.lit(False)) if deleted else F.lit(False),
        )


def content_equal(left: Side, right: Side) -> Column:
    """The deleted flag outranks the fingerprint: two deletions are equal."""
    same_bytes = left.size.eqNullSafe(right.size) & left.chunks.eqNullSafe(right.chunks)
    return left.deleted.eqNullSafe(right.deleted) & (left.deleted | same_bytes)


def relation(
    left: Side,
    right: Side,
    baseline: Side | None = None,
    has_baseline: Column | None = None,
    attributed: Column | bool = False,
    recreate: Column | bool = False,
    clock_relation: Column | None = None,
) -> Column:
    """identical, vclock-only-drift, remote-edit, local-edit, true-divergent or
    legacy-skip; the first matching rule wins."""
    attributed = F.lit(attributed) if isinstance(attributed, bool) else attributed
    recreate = F.lit(recreate) if isinstance(recreate, bool) else recreate
    rel = clock_relation if clock_relation is not None else clocks.relation(left.vclock, right.vclock)
    same = content_equal(left, right)

    if baseline is None:
        no_base, legacy, base_dead = F.lit(True), F.lit(False), F.lit(False)
        explained = F.lit(False)
    else:
        known = has_baseline if has_baseline is not None else baseline.vclock.isNotNull()
        no_base = ~F.coalesce(known, F.lit(False))
        legacy = baseline.chunks.isNull() | baseline.size.isNull()
        base_dead = F.coalesce(baseline.deleted, F.lit(False))
        explained = (
            ~base_dead
            & left.size.eqNullSafe(baseline.size)
            & left.chunks.eqNullSafe(baseline.chunks)
        )

    remote_deletes_file = right.deleted & ~left.deleted & attributed
    behind = (
        F.when(
            remote_deletes_file,
            F.when(~no_base & ~base_dead & ~legacy & explained, "remote-edit").otherwise(
                "true-divergent"
            ),
        )
        .when(no_base, "remote-edit")
        .when(legacy, "legacy-skip")
        .when(explained & ~left.deleted, "remote-edit")
        .otherwise("true-divergent")
    )
    return (
        F.when(same & (rel == "equal"), "identical")
        .when(same, "vclock-only-drift")
        .when(rel == "concurrent", "true-divergent")
        .when(rel == "dominated", behind)
        .when(
            (rel == "equal") & ~attributed,
            F.when(recreate, "remote-edit").otherwise("true-divergent"),
        )
        .otherwise("local-edit")
    )


def classify_relation(
    pairs: DataFrame, left: str = "l_", right: str = "r_", baseline: str | None = "b_"
) -> DataFrame:
    """Adds ``relation`` to rows holding two prefixed versions, an optional
    baseline, and optional ``attributed`` / ``recreate`` flags."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in pairs.columns else F.lit(False)

    base = has = None
    if baseline is not None:
        base = Side.of(baseline)
        has = F.col(f"{baseline}vclock").isNotNull()
    clock_rel = clocks.relation(F.col(f"{left}vclock"), F.col(f"{right}vclock"))
    return pairs.withColumn("_rel", clock_rel).withColumn(
        "relation",
        relation(
            Side.of(left), Side.of(right), base, has, flag("attributed"), flag("recreate"), F.col("_rel")
        ),
    ).drop("_rel")


VERDICTS = {
    "identical": "keep-local",
    "vclock-only-drift": "silent-merge",
    "remote-edit": "take-remote",
    "local-edit": "keep-local",
    "true-divergent": "concurrent",
    "legacy-skip": "keep-local",
}


def verdict(has_local: Column, relation_col: Column) -> Column:
    out = F.when(~has_local, "take-remote")
    for name, value in VERDICTS.items():
        out = out.when(relation_col == name, value)
    return out


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """Version columns of a table under a prefix, joined later by ``key``."""
    have = set(df.columns)
    cols = [F.col(key)]
    for c in ("vclock", "chunks", "size", "mtime", "ctime", "deleted", "schema_version"):
        if c == "deleted":
            v = F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
        elif c == "vclock":
            v = clocks.clock(c)
        elif c in have:
            v = F.col(c)
        else:
            continue
        cols.append(v.alias(prefix + c))
    return df.select(*cols, F.lit(True).alias(prefix + "here"))


def pull_verdicts(
    remote: DataFrame, local: DataFrame, recreate: bool = False
) -> DataFrame:
    """``remote`` docs with ``l_*`` columns of the local doc, ``relation`` and
    ``verdict``.  No baseline takes part and no clock is attributed."""
    joined = prefixed(remote, "r_", "_id").join(prefixed(local, "l_", "_id"), "_id", "left")
    here = F.col("l_here").isNotNull()
    rel = joined.withColumn("clock_relation", clocks.relation("l_vclock", "r_vclock"))
    classified = rel.withColumn(
        "relation",
        F.when(
            here,
            relation(
                Side.of("l_"), Side.of("r_"), recreate=recreate, clock_relation=F.col("clock_relation")
            ),
        ),
    )
    return classified.withColumn("verdict", verdict(here, F.col("relation")))
