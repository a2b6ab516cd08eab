"""Table schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the format this library reads and writes) -----
FILE_PREFIX = "file:"
CHUNK_PREFIX = "chunk:"
CONFIG_PREFIX = "config:"
CHUNK_ALGS = ("s256", "x64", "hmac")
DEFAULT_ALG = "s256"
FILE_SCHEMA_VERSION = 2
CHUNK_SCHEMA_VERSION = 2
CONFIG_SCHEMA_VERSION = 3
FILE_CHUNK_BYTES = 75 * 1024
CONFIG_CHUNK_BYTES = 256 * 1024
MAX_CONFIG_BYTES = 5 * 1024 * 1024
DEFAULT_MAX_FILE_MB = 50
DIFFABLE_PROBE_BYTES = 8192
RACE_STALE_LIMIT = 3
CLOCK_SKEW_MARGIN_MS = 5000
ECHO_TTL_MS = 60_000
LOG_AVG_ENTRY_BYTES = 200
LOG_ENTRY_OVERHEAD_BYTES = 48
LARGE_DELETE_SHARE = 0.10
DAY_MS = 24 * 60 * 60 * 1000
LOG_LEVELS = ("debug", "info", "warn", "error")
CONFIG_UNITS = (
    "app-behavior",
    "theme-css",
    "snippets",
    "core-settings",
    "community-settings",
    "install-state",
    "enabled-list",
    "layout",
    "other",
)
# -----------------------------------------------------------------------------

CLOCK = T.MapType(T.StringType(), T.LongType())
IDS = T.ArrayType(T.StringType())


def _struct(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


S, L, I, B, BIN, D = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.BinaryType(),
    T.DoubleType(),
)

FILE_DOCS = _struct(
    ("_id", S), ("schema_version", I), ("chunks", IDS), ("mtime", L), ("ctime", L),
    ("size", L), ("deleted", B), ("vclock", CLOCK), ("_version", L), ("_local_seq", L),
)
CONFIG_DOCS = _struct(
    ("_id", S), ("schema_version", I), ("chunks", IDS), ("mtime", L), ("size", L),
    ("deleted", B), ("vclock", CLOCK), ("_version", L), ("_local_seq", L),
)
CHUNKS = _struct(("_id", S), ("schema_version", I), ("content", BIN))
DISK_FILES = _struct(("path", S), ("mtime", L), ("ctime", L), ("size", L), ("content", BIN))
BASELINES = _struct(
    ("path_key", S), ("vclock", CLOCK), ("chunks", IDS), ("size", L), ("mtime", L),
    ("deleted", B),
)
MANIFEST = _struct(("path", S))
CHANGE_DOC = _struct(
    ("_id", S), ("schema_version", I), ("chunks", IDS), ("mtime", L), ("ctime", L),
    ("size", L), ("deleted", B), ("vclock", CLOCK),
)
CHANGES = _struct(("id", S), ("seq", L), ("deleted", B), ("doc", CHANGE_DOC))
UNPUSHED = _struct(("id", S), ("reason", S), ("attempts", I), ("added_at", L))
PENDING_APPLY = _struct(("id", S), ("reason", S), ("attempts", I), ("added_at", L))
PENDING_CONFLICT = _struct(("id", S), ("kind", S), ("added_at", L))
SKIPPED = _struct(("path_key", S), ("size_mb", D), ("skipped_at", L))
QUARANTINED = _struct(("path_key", S), ("missing_chunks", IDS), ("quarantined_at", L))
REVISIONS = _struct(
    ("id", L), ("file_path", S), ("timestamp", L), ("base_hash", S), ("added", L),
    ("removed", L), ("conflict", B), ("source", S), ("parent_id", L), ("content", S),
)
HEADS = _struct(("file_path", S), ("content", S), ("last_modified", L), ("head_record_id", L))
LOGS = _struct(("id", L), ("timestamp", L), ("level", S), ("message", S))
VAULT_EVENTS = _struct(("ts", T.TimestampType()), ("path", S), ("old_path", S), ("kind", S))
SCAN_CURSOR = _struct(("last_started_at", L), ("max_seq", L), ("doc_count", L))
