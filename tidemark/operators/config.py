"""Settings files: units, send and receive policy, scan, write and tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, content as contentf, ids
from tidemark.operators.chunking import reassemble
from tidemark.operators.integrity import alive
from tidemark.operators.paths import MIB
from tidemark.schemas import (
    CONFIG_CHUNK_BYTES,
    CONFIG_PREFIX,
    CONFIG_SCHEMA_VERSION,
    CONFIG_UNITS,
    DEFAULT_ALG,
    MAX_CONFIG_BYTES,
)
from tidemark.session import cut_lineage

# --- fixed values: which settings file belongs to which unit, and defaults ------
CONFIG_DIR = ".config"
APP_BEHAVIOR_FILES = ("app.json", "appearance.json", "hotkeys.json")
ENABLED_LIST_FILES = ("community-plugins.json", "core-plugins.json", "core-plugins-migration.json")
LAYOUT_FILES = ("workspace.json", "workspace-mobile.json")
CODE_PATTERN = r"(?i)\.(js|mjs|cjs)\z"
UNIT_DEFAULTS = {
    "app-behavior": True,
    "core-settings": True,
    "community-settings": True,
    "theme-css": True,
    "snippets": True,
    "enabled-list": False,
    "install-state": False,
    "layout": False,
    "other": False,
}
# --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """Unit switches (missing units take the default), a lock on plugin code, and
    the settings folder.  Per-path overrides are a table: ``(path, allowed)``."""

    units: dict[str, bool] = field(default_factory=dict)
    block_plugin_code: bool = True
    config_dir: str = CONFIG_DIR

    def unit_default(self, unit: Column) -> Column:
        switches = [(n, self.units.get(n, UNIT_DEFAULTS[n])) for n in CONFIG_UNITS]
        table = F.create_map(*[F.lit(x) for pair in switches for x in pair])
        return F.coalesce(F.try_element_at(table, unit), F.lit(False))


def classify_config_paths(df: DataFrame, path: str = "path", config_dir: str = CONFIG_DIR) -> DataFrame:
    """Adds ``unit``, ``is_plugin_code`` and ``plugin_dir``."""
    root = config_dir.rstrip("/") + "/"
    p = F.col(path)
    rest = F.when(p.startswith(root), F.substring(p, F.lit(len(root) + 1), F.length(p)))
    rows = (
        df.withColumn("_parts", F.split(rest, "/", -1))
        .withColumn("_first", F.try_element_at("_parts", F.lit(1)))
        .withColumn("_depth", F.size("_parts"))
    )
    first, depth = F.col("_first"), F.col("_depth")
    plugin = (first == "plugins") & (depth >= 3)
    data = (depth == 3) & (F.try_element_at("_parts", F.lit(3)) == "data.json")
    by_name = (
        F.when(first.isin(*LAYOUT_FILES), "layout")
        .when(first.isin(*APP_BEHAVIOR_FILES), "app-behavior")
        .when(first.isin(*ENABLED_LIST_FILES), "enabled-list")
        .when(first.endswith(".json"), "core-settings")
        .otherwise("other")
    )
    unit = (
        F.when(F.col("_parts").isNull(), "other")
        .when(plugin, F.when(data, "community-settings").otherwise("install-state"))
        .when((first == "themes") & (depth >= 3), "theme-css")
        .when((first == "snippets") & (depth >= 2), "snippets")
        .when(depth == 1, by_name)
        .otherwise("other")
    )
    return (
        rows.withColumn("unit", unit)
        .withColumn("is_plugin_code", (F.col("unit") == "install-state") & p.rlike(CODE_PATTERN))
        .withColumn(
            "plugin_dir",
            F.when(plugin, F.concat(F.lit(root + "plugins/"), F.try_element_at("_parts", F.lit(2)))),
        )
        .drop("_parts", "_first", "_depth")
    )


def with_send(df: DataFrame, policy: Policy, overrides: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Adds unit columns and ``send``: code lock, layout lock, per-path override,
    unit default."""
    rows = classify_config_paths(df, path, policy.config_dir)
    allowed = F.lit(None).cast("boolean")
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("path").alias(path), F.col("allowed").alias("_allowed")), path, "left")
        allowed = F.col("_allowed")
    unit = F.col("unit")
    locked = (unit == "layout") | (F.lit(policy.block_plugin_code) & (unit == "install-state"))
    send = ~locked & F.coalesce(allowed, policy.unit_default(unit))
    return rows.withColumn("send", send).drop("_allowed")


def send_scope(df: DataFrame, policy: Policy, overrides: DataFrame | None = None, path: str = "path") -> DataFrame:
    return with_send(df, policy, overrides, path).filter("send").drop("send")


def receive_scope(
    df: DataFrame,
    policy: Policy,
    plugins: DataFrame,
    is_mobile: bool,
    overrides: DataFrame | None = None,
    path: str = "path",
) -> DataFrame:
    """Send scope, minus settings of absent plugins, minus (on mobile) plugins
    known to be desktop-only.  ``plugins``: ``(plugin_dir, desktop_only)``."""
    rows = with_send(df, policy, overrides, path).filter("send").drop("send")
    known = plugins.select("plugin_dir", "desktop_only", F.lit(True).alias("_present"))
    rows = rows.join(known, "plugin_dir", "left")
    present = F.coalesce("_present", F.lit(False))
    keep = (F.col("unit") != "community-settings") | F.col("plugin_dir").isNull() | present
    if is_mobile:
        keep = keep & ~F.coalesce("desktop_only", F.lit(False))
    return rows.filter(keep).drop("_present", "desktop_only")


def config_skipped(
    disk: DataFrame, policy: Policy, overrides: DataFrame | None = None, max_bytes: int = MAX_CONFIG_BYTES
) -> DataFrame:
    """``(path, size)`` of the files within send scope that are too large to send."""
    return send_scope(disk, policy, overrides).filter(F.col("size") > max_bytes).select("path", "size")


def config_scan(
    disk: DataFrame,
    docs: DataFrame,
    last_synced: DataFrame,
    policy: Policy,
    device: str,
    overrides: DataFrame | None = None,
    chunk_bytes: int = CONFIG_CHUNK_BYTES,
    skip_paths: DataFrame | None = None,
    skip_names: tuple[str, ...] = (),
    max_bytes: int = MAX_CONFIG_BYTES,
    alg=DEFAULT_ALG,
) -> DataFrame:
    """New settings docs of changed files within send scope, at most ``max_bytes``;
    :func:`config_skipped` names the larger ones.

    ``last_synced``: ``(path, size, chunks)`` of the last exchange.
    """
    files = send_scope(disk, policy, overrides).filter(F.col("size") <= max_bytes)
    if skip_names:
        files = files.filter(~F.substring_index("path", "/", -1).isin(*skip_names))
    if skip_paths is not None:
        files = files.join(skip_paths.select("path"), "path", "left_anti")
    prints = files.select("path", "mtime", "size", contentf.chunk_list("content", chunk_bytes, alg).alias("chunks"))
    cached = last_synced.select("path", F.col("size").alias("_s"), F.col("chunks").alias("_c"))
    stored = docs.select(F.col("_id"), F.col("vclock").alias("_v"))
    same = F.col("_s").eqNullSafe(F.col("size")) & F.col("_c").eqNullSafe(F.col("chunks"))
    return (
        prints.join(cached, "path", "left")
        .filter(~same)
        .withColumn("_id", F.concat(F.lit(CONFIG_PREFIX), "path"))
        .join(stored, "_id", "left")
        .select(
            "_id",
            F.lit(CONFIG_SCHEMA_VERSION).alias("schema_version"),
            "chunks",
            "mtime",
            "size",
            F.lit(False).alias("deleted"),
            clocks.increment("_v", device).alias("vclock"),
        )
    )


def config_write_plan(
    docs: DataFrame,
    chunks: DataFrame,
    policy: Policy,
    plugins: DataFrame,
    is_mobile: bool,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """``(path, status, missing, size, content)``: bytes of every alive settings
    doc with a safe path inside receive scope; incomplete and oversize files are
    reported by status instead of written."""
    rows = docs.filter(alive()).withColumn("path", ids.path_of("_id"))
    safe = rows.filter(ids.unsafe_reason("path").isNull())
    wanted = cut_lineage(
        receive_scope(safe, policy, plugins, is_mobile, overrides).select("_id", "chunks")
    )
    bodies = reassemble(wanted, chunks, MAX_CONFIG_BYTES / MIB)
    return bodies.select(ids.path_of("_id").alias("path"), "status", "missing", "size", "content")


def config_tree(
    local_paths: DataFrame, remote_paths: DataFrame, policy: Policy, overrides: DataFrame | None = None
) -> DataFrame:
    """Per unit: paths on either side, paths only on the server, all/any sent."""
    sides = (
        local_paths.select("path", F.lit(1).alias("bits"))
        .unionAll(remote_paths.select("path", F.lit(2).alias("bits")))
        .groupBy("path")
        .agg(F.bit_or("bits").alias("bits"))
    )
    return (
        with_send(sides, policy, overrides)
        .groupBy("unit")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count_if(F.col("bits") == 2).alias("server_only"),
            F.bool_and("send").alias("all_on"),
            F.bool_or("send").alias("any_on"),
        )
    )
