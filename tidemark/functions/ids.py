"""Document ids and paths as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import CHUNK_ALGS, CHUNK_PREFIX, CONFIG_PREFIX, FILE_PREFIX


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after(c: Column | str, prefix: str) -> Column:
    """Text after a prefix that is known to be there."""
    return F.substring(_col(c), F.lit(len(prefix) + 1), F.length(_col(c)))


def is_file(c: Column | str) -> Column:
    return _col(c).startswith(FILE_PREFIX)


def is_chunk(c: Column | str) -> Column:
    return _col(c).startswith(CHUNK_PREFIX)


def is_config(c: Column | str) -> Column:
    return _col(c).startswith(CONFIG_PREFIX)


def is_replicated(c: Column | str) -> Column:
    return is_file(c) | is_chunk(c) | is_config(c)


def kind(c: Column | str) -> Column:
    i = _col(c)
    return (
        F.when(is_config(i), "config")
        .when(is_chunk(i), "chunk")
        .when(is_file(i), "file")
        .when(i.startswith("_"), "local")
        .otherwise("unknown")
    )


def path_of(c: Column | str) -> Column:
    i = _col(c)
    return F.when(is_config(i), after(i, CONFIG_PREFIX)).when(is_file(i), after(i, FILE_PREFIX))


def chunk_alg(c: Column | str) -> Column:
    """Algorithm tag of a chunk id, NULL when the tag is absent."""
    i = _col(c)
    rest = after(i, CHUNK_PREFIX)
    return F.when(is_chunk(i) & rest.contains(":"), F.substring_index(rest, ":", 1))


def chunk_hash(c: Column | str) -> Column:
    i = _col(c)
    rest = after(i, CHUNK_PREFIX)
    return F.when(
        is_chunk(i) & rest.contains(":"),
        F.substring(rest, F.locate(":", rest) + 1, F.length(rest)),
    )


def chunk_id_error(c: Column | str) -> Column:
    i = _col(c)
    alg = chunk_alg(i)
    return (
        F.when(is_chunk(i) & alg.isNull(), "missing algorithm tag")
        .when(is_chunk(i) & ~alg.isin(*CHUNK_ALGS), "unknown algorithm")
    )


def local_name(c: Column | str) -> Column:
    i = _col(c)
    return F.when(i.startswith("_local/"), after(i, "_local/")).when(i.startswith("_"), after(i, "_"))


@F.pandas_udf(T.StringType())
def _nfc_lower(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p).lower())


def path_key(c: Column | str) -> Column:
    """NFC + lower case for one column, inside any expression.

    The native ``lower`` answers pure-ASCII rows, but a Python function inside a
    conditional is still evaluated for every row; a table goes through
    :func:`tidemark.operators.paths.with_path_key`, which sends only the
    non-ASCII values to Python.
    """
    p = _col(c)
    return F.when(is_ascii(p), F.lower(p)).otherwise(_nfc_lower(p))


def nfc_key(c: Column | str) -> Column:
    return _nfc_lower(_col(c))


def is_ascii(c: Column | str) -> Column:
    return F.octet_length(_col(c)) == F.char_length(_col(c))


def parent_dir(c: Column | str) -> Column:
    p = _col(c)
    return F.when(p.contains("/"), F.regexp_extract(p, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(F.lit(""))


def ancestors(c: Column | str) -> Column:
    """All directories above a path: ``a/b/c.md`` gives ``[a, a/b]``."""
    parts = F.split(_col(c), "/", -1)
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


# --- fixed values: what is said of a path that must not be written -----------
EMPTY = "empty path"
BACKSLASH = "backslash separator"
ABSOLUTE = "absolute path"
DRIVE = "drive letter"
TRAVERSAL = "parent-directory traversal (..)"
# -----------------------------------------------------------------------------


def unsafe_reason(c: Column | str) -> Column:
    """Why a path could leave its root, NULL where it can't."""
    p = F.coalesce(_col(c), F.lit(""))
    climbs = F.array_contains(F.split(p, "/", -1), "..")
    return (
        F.when(p == "", EMPTY).when(p.contains("\\"), BACKSLASH).when(p.startswith("/"), ABSOLUTE)
        .when(p.rlike("^[a-zA-Z]:"), DRIVE).when(climbs, TRAVERSAL)
    )


def glob_regex(pattern: str) -> str:
    """Glob to an anchored Java regex: ``**/`` spans folders, ``*`` stays in one."""
    tokens = {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    body = "".join(tokens.get(t) or re.escape(t) for t in parts)
    return rf"\A{body}\z"


def end_of_text(pattern: str) -> str:
    r"""The pattern with each bare ``$`` as ``\z``: it never matches before a line end."""
    parts = re.split(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\$)", pattern, flags=re.S)
    return "".join(r"\z" if p == "$" else p for p in parts)


def valid_regex(pattern: str | None) -> str | None:
    """The pattern as the executors match it, or NULL when it does not compile there.

    Compiled once on the driver by the engine that runs it: group names and classes
    follow that engine.  An invalid pattern is ignored.
    """
    if not pattern:
        return None
    pattern = end_of_text(pattern)
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return None
    return pattern


def seq_number(c: Column | str) -> Column:
    """Numeric prefix of a sequence such as ``225-g1AA``; 0 when there is none."""
    digits = F.regexp_extract(_col(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
