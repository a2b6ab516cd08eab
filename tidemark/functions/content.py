"""Bytes as column expressions: chunk ids, text probe, codec header."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import CHUNK_PREFIX, DIFFABLE_PROBE_BYTES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _x64(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b), seed=0))


def digest(content: Column | str, alg="s256") -> Column:
    """Hex digest: ``s256``, ``x64`` or a user function ``Column -> Column``."""
    if callable(alg):
        return alg(_col(content))
    if alg == "s256":
        return F.sha2(_col(content), 256)
    if alg == "x64":
        return _x64(_col(content))
    raise ValueError(f"unknown chunk algorithm {alg!r}")


def alg_tag(alg) -> str:
    return alg if isinstance(alg, str) else getattr(alg, "alg", alg.__name__)


def chunk_id(content: Column | str, alg="s256") -> Column:
    return F.concat(F.lit(f"{CHUNK_PREFIX}{alg_tag(alg)}:"), digest(content, alg))


def piece_count(content: Column | str, chunk_bytes: int) -> Column:
    """Number of fixed-size pieces; an empty file has exactly one, empty."""
    return F.greatest(F.ceil(F.octet_length(_col(content)) / F.lit(chunk_bytes)), F.lit(1)).cast("int")


def piece(content: Column | str, ordinal: Column, chunk_bytes: int) -> Column:
    return F.substring(
        _col(content), (ordinal * F.lit(chunk_bytes) + 1).cast("int"), F.lit(chunk_bytes)
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _x64_list(content: pd.Series, chunk_bytes: pd.Series) -> pd.Series:
    def hashes(b, n: int) -> list[str] | None:
        if b is None:
            return None
        body = bytes(b)
        return [xxhash.xxh64_hexdigest(body[i:i + n], seed=0) for i in range(0, max(len(body), 1), n)]

    return pd.Series([hashes(b, n) for b, n in zip(content, chunk_bytes)])


def chunk_list(content: Column | str, chunk_bytes: int, alg="s256") -> Column:
    """Ordered chunk ids of one row's bytes, without a shuffle.

    A user function must be made of built-in column functions here.
    """
    if alg == "x64":  # no UDF can stand inside a lambda
        return F.transform(
            _x64_list(_col(content), F.lit(chunk_bytes)), lambda h: F.concat(F.lit(f"{CHUNK_PREFIX}x64:"), h)
        )
    ordinals = F.sequence(F.lit(0), piece_count(content, chunk_bytes) - 1)
    return F.transform(ordinals, lambda i: chunk_id(piece(content, i, chunk_bytes), alg))


def is_diffable_text(content: Column | str) -> Column:
    """No NUL in the first 8192 bytes and those bytes are whole UTF-8."""
    probe = F.substring(_col(content), 1, DIFFABLE_PROBE_BYTES)
    text = probe.cast("string")
    return F.is_valid_utf8(text) & ~text.contains("\x00")


@F.pandas_udf(T.LongType())
def gzip_length(content: pd.Series) -> pd.Series:
    """Length after gzip (level 6, no timestamp)."""
    return content.map(
        lambda b: None if b is None else len(gzip.compress(bytes(b), compresslevel=6, mtime=0))
    ).astype("Int64")


# --- fixed values: header bits of a stored blob ------------------------------
BIT_ENCRYPTED = 0x01
BIT_COMPRESSED = 0x02
BITS_RESERVED = 0x7C
BIT_EXTENSION = 0x80
ENCRYPTED_MIN_BYTES = 13
# -----------------------------------------------------------------------------


def codec_mode(blob: Column | str) -> Column:
    """``plain / compressed / encrypted / encrypted+compressed / invalid: <why>``."""
    b = _col(blob)
    flags = F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")

    def has(bits: int) -> Column:
        return flags.bitwiseAND(F.lit(bits)) != 0

    return (
        F.when(F.octet_length(b) < 1, "invalid: empty")
        .when(has(BITS_RESERVED), "invalid: reserved bits")
        .when(has(BIT_EXTENSION), "invalid: extension bit")
        .when(
            has(BIT_ENCRYPTED) & (F.octet_length(b) < ENCRYPTED_MIN_BYTES),
            "invalid: short encrypted",
        )
        .when(has(BIT_ENCRYPTED) & has(BIT_COMPRESSED), "encrypted+compressed")
        .when(has(BIT_ENCRYPTED), "encrypted")
        .when(has(BIT_COMPRESSED), "compressed")
        .otherwise("plain")
    )


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _line_ids(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    left, right = _lines(a), _lines(b)
    ids: dict[str, int] = {}
    return (
        np.array([ids.setdefault(s, len(ids)) for s in left], dtype=np.int64),
        np.array([ids.setdefault(s, len(ids)) for s in right], dtype=np.int64),
    )


MAX_EDITS = 1000  # beyond, the bit-parallel way is taken
BLOCK_LINES = 16_384


def _same_run(x: np.ndarray, i: int, y: np.ndarray, j: int) -> int:
    """Length of the common run that starts at ``x[i]`` and ``y[j]``."""
    n, step = 0, 32
    while True:
        a, b = x[i + n : i + n + step], y[j + n : j + n + step]
        size = min(len(a), len(b))
        apart = np.flatnonzero(a[:size] != b[:size])
        if len(apart):
            return n + int(apart[0])
        n += size
        if size < step:
            return n
        step = min(2 * step, 1 << 20)


def _few_edits(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """Fewest insertions and deletions that turn ``x`` into ``y``, if no more than ``most``.

    Per number of edits the farthest row reached on each diagonal is kept, so memory
    follows the number of edits and time the lines plus its square.
    """
    n, m = len(x), len(y)
    first, second = x.tolist(), y.tolist()
    far = {1: 0}
    for d in range(min(most, n + m) + 1):
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and far[k - 1] < far[k + 1])
            i = far[k + 1] if down else far[k - 1] + 1
            j = i - k
            if i < n and j < m and i >= 0 and j >= 0 and first[i] == second[j]:
                i += _same_run(x, i, y, j)
                j = i - k
            far[k] = i
            if i >= n and j >= m:
                return d
    return None


def _bit_lcs(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence by one bit per line of ``x``, a block of lines at a time.

    A block hands the carries of its additions on to the next one, so that only the masks
    of one block are held.  Lines of ``y`` that neither occur in the block nor carry into it
    are passed over.
    """
    carry = np.zeros(len(y), bool)
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    zeros = 0
    for at in range(0, len(x), BLOCK_LINES):
        part = x[at : at + BLOCK_LINES]
        match: dict[int, int] = {}
        for i, v in enumerate(part.tolist()):
            match[v] = match.get(v, 0) | (1 << i)
        kinds = np.array(sorted(match))
        lo, hi = np.searchsorted(ranked, kinds), np.searchsorted(ranked, kinds, side="right")
        here = carry.copy()
        for s, e in zip(lo.tolist(), hi.tolist()):
            here[order[s:e]] = True
        full = (1 << len(part)) - 1
        row = full
        out = np.zeros(len(y), bool)
        for j in np.flatnonzero(here).tolist():
            hit = row & match.get(int(y[j]), 0)
            total = row + hit + int(carry[j])
            out[j] = total > full
            row = (total | (row - hit)) & full
        carry = out
        zeros += len(part) - row.bit_count()
    return zeros


def lcs_length(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence of two arrays of line ids, exact and in bounded memory.

    Lines of one side only can't be common and go first, then equal ends.  What is left
    of alike texts is a few edits apart; texts farther apart are compared by bits.
    """
    x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
    size = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    both = (np.bincount(x, minlength=size) > 0) & (np.bincount(y, minlength=size) > 0)
    x, y = x[both[x]], y[both[y]]
    lo = _same_run(x, 0, y, 0)
    x, y = x[lo:], y[lo:]
    hi = _same_run(x[::-1], 0, y[::-1], 0)
    x, y = x[: len(x) - hi], y[: len(y) - hi]
    if not len(x) or not len(y):
        return lo + hi
    # A search over d edits costs about d * d steps; short texts are cheaper by bits.
    edits = _few_edits(x, y, MAX_EDITS) if min(len(x), len(y)) > 4 * MAX_EDITS else None
    common = _bit_lcs(x, y) if edits is None else (len(x) + len(y) - edits) // 2
    return lo + hi + common


CHURN = T.StructType([T.StructField("added", T.LongType()), T.StructField("removed", T.LongType())])


@F.pandas_udf(CHURN)
def line_churn(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Lines added and removed between two texts (exact: lengths minus LCS)."""
    added, removed = [], []
    for a, b in zip(old.fillna(""), new.fillna("")):
        x, y = _line_ids(a, b)
        common = lcs_length(x, y)
        added.append(len(y) - common)
        removed.append(len(x) - common)
    return pd.DataFrame({"added": added, "removed": removed})
