"""Projections, filters and predicates on ids, paths and scope."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ids
from tidemark.functions.content import is_diffable_text
from tidemark.schemas import (
    CHUNK_SCHEMA_VERSION,
    CONFIG_SCHEMA_VERSION,
    DEFAULT_MAX_FILE_MB,
    FILE_SCHEMA_VERSION,
)

MIB = 1024 * 1024


def with_doc_id(df: DataFrame, id_col: str = "_id") -> DataFrame:
    """Adds kind, path, alg, hash, local_name and ``id_error``."""
    bad = ids.chunk_id_error(id_col)
    return (
        df.withColumn("kind", ids.kind(id_col))
        .withColumn("path", ids.path_of(id_col))
        .withColumn("alg", F.when(bad.isNull(), ids.chunk_alg(id_col)))
        .withColumn("hash", F.when(bad.isNull(), ids.chunk_hash(id_col)))
        .withColumn("local_name", ids.local_name(id_col))
        .withColumn("id_error", bad)
    )


def with_path_key(df: DataFrame, path: str = "path", out: str = "path_key") -> DataFrame:
    """Adds the folded path (NFC + lower case); the raw path is kept."""
    # NULL in, NULL out: ASCII rows reach the Python function as NULL.
    rare = ids.nfc_key(F.when(~ids.is_ascii(path), F.col(path)))
    return df.withColumn(out, F.coalesce(rare, F.lower(F.col(path))))


def with_parent_dir(df: DataFrame, path: str = "path", out: str = "parent_dir") -> DataFrame:
    return df.withColumn(out, ids.parent_dir(path))


def flag_unsafe_paths(df: DataFrame, path: str = "path", out: str = "unsafe_reason") -> DataFrame:
    return df.withColumn(out, ids.unsafe_reason(path))


def matches_any(path: Column | str, patterns: Sequence[str]) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return reduce(lambda a, b: a | b, (p.rlike(ids.glob_regex(g)) for g in patterns), F.lit(False))


def filter_glob(df: DataFrame, patterns: Sequence[str], path: str = "path", keep: bool = True) -> DataFrame:
    """Rows whose path matches any pattern (or, with ``keep=False``, none)."""
    hit = matches_any(path, patterns)
    return df.filter(hit if keep else ~hit)


def in_scope(path: Column | str, include_re: str | None = None, exclude_re: str | None = None) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    cond = ~p.startswith(".")
    include, exclude = ids.valid_regex(include_re), ids.valid_regex(exclude_re)
    if include:
        cond = cond & p.rlike(include)
    if exclude:
        cond = cond & ~p.rlike(exclude)
    return cond


def with_scope(
    df: DataFrame,
    include_re: str | None = None,
    exclude_re: str | None = None,
    max_mb: float = DEFAULT_MAX_FILE_MB,
) -> DataFrame:
    """Adds ``scope``: skipped (oversize, tested first), out, or in; and ``size_mb``."""
    size_mb = F.col("size") / F.lit(MIB)
    return df.withColumn("size_mb", F.round(size_mb, 1)).withColumn(
        "scope",
        F.when(size_mb > max_mb, "skipped")
        .when(in_scope("path", include_re, exclude_re), "in")
        .otherwise("out"),
    )


def sync_scope(
    df: DataFrame,
    include_re: str | None = None,
    exclude_re: str | None = None,
    max_mb: float = DEFAULT_MAX_FILE_MB,
) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)``: files to sync, and oversize files with MB to 0.1."""
    tagged = with_scope(df, include_re, exclude_re, max_mb)
    kept = tagged.filter(F.col("scope") == "in").drop("scope", "size_mb")
    skipped = with_path_key(tagged.filter(F.col("scope") == "skipped")).select(
        "path_key", "size_mb"
    )
    return kept, skipped


def flag_diffable_text(df: DataFrame, content: str = "content", out: str = "diffable") -> DataFrame:
    return df.withColumn(out, is_diffable_text(content))


# --- fixed values: device name rules -----------------------------------------
DEVICE_MIN, DEVICE_MAX = 2, 30
DEVICE_PATTERN = r"\A[a-z0-9][a-z0-9-]{0,28}[a-z0-9]\z"
# -----------------------------------------------------------------------------


def device_problem(name: Column | str) -> Column:
    """First failing rule of a device name, NULL when it is fine."""
    n = F.col(name) if isinstance(name, str) else name
    return (
        F.when(F.coalesce(n, F.lit("")) == "", "required")
        .when(F.length(n) < DEVICE_MIN, "too short")
        .when(F.length(n) > DEVICE_MAX, "too long")
        .when(~n.rlike(DEVICE_PATTERN), "bad characters")
    )


def flag_bad_devices(docs: DataFrame) -> DataFrame:
    """``(_id, device, problem)`` for every bad device name in a clock."""
    return (
        docs.select("_id", F.explode(F.map_keys(clocks.clock("vclock"))).alias("device"))
        .withColumn("problem", device_problem("device"))
        .filter(F.col("problem").isNotNull())
    )


EXPECTED_VERSION = {
    "file": FILE_SCHEMA_VERSION,
    "chunk": CHUNK_SCHEMA_VERSION,
    "config": CONFIG_SCHEMA_VERSION,
}


def schema_gate(df: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """Rows of another schema version; with ``strict`` such a row fails the job
    and every row passes through."""
    expected = EXPECTED_VERSION[kind]
    bad = ~F.col("schema_version").eqNullSafe(F.lit(expected))
    if not strict:
        return df.filter(bad)
    message = F.concat(F.lit(f"{kind} schema is not {expected}: "), F.col("_id"))
    # assert_true yields NULL when it holds, so the filter keeps every good row.
    return df.filter(F.assert_true(~bad, message).isNull())


def find_legacy_docs(docs: DataFrame) -> DataFrame:
    """``(_id, why)`` of rows that do not belong in a current file store."""
    kind = ids.kind("_id")
    why = (
        F.when(kind == "unknown", "unknown prefix")
        .when(kind == "config", "config row in file store")
        .when((kind == "file") & clocks.is_empty("vclock"), "file without clock")
    )
    return docs.select("_id", why.alias("why")).filter(F.col("why").isNotNull())
