"""Files of a folder: a listing made in tasks, a level of folders at a time."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

FOUND = "path string, is_dir boolean, size long, mtime long"
BATCH_ROWS = 65_536
TASK_BYTES = 64 << 20


def system_of(folder: str):
    """File system and path of a folder, for use without a Spark session."""
    from pyarrow import fs

    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def _children(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder of the batches, by path below ``root``."""
    from pyarrow import fs

    system, base = system_of(root)
    base = base.rstrip("/")
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base or "/"))
            for at in range(0, len(found), BATCH_ROWS):
                rows = [
                    ((f"{folder}/" if folder else "") + i.base_name, i.type == fs.FileType.Directory, i.size or 0,
                     (i.mtime_ns or 0) // 1_000_000)
                    for i in found[at:at + BATCH_ROWS]
                ]
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "is_dir", "size", "mtime"]
                )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mtime)`` of every file below ``root``, whatever its name and length.

    Folders of one level are listed by as many tasks as there are folders, then those found
    in them; each level is written, so a lost task lists its own folders again.  Checksum
    files (``.name.crc``), which the file system keeps for itself, are left out.
    """
    level = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        found = cut_lineage(level.repartition("path").mapInArrow(lambda b: _children(root, b), FOUND))
        levels.append(found.filter("not is_dir").drop("is_dir"))
        level = found.filter("is_dir").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionAll, levels)
    return files.filter(~F.col("path").rlike(r"(^|/)\.[^/]*\.crc\z"))


def left_out(path: Column) -> Column:
    """Whether Spark's file sources pass a file over because of its name or a folder's."""
    part = F.split(path, "/")
    return F.exists(
        part, lambda p: (p.startswith("_") & ~p.contains("=")) | p.startswith(".") | p.endswith("._COPYING_")
    )


def matches_name(path: Column, glob: str) -> Column:
    """The file's name matches a glob of ``*``, ``?`` and ``[...]``."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike(fnmatch.translate(glob).replace(r"\Z", r"\z"))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Adds ``content`` to a listing; only where it is asked for the files are opened.

    Tasks get about ``TASK_BYTES`` each.
    """
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    @F.pandas_udf("binary")
    def read(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        system, base = system_of(root)
        for some in paths:
            out = []
            for path in some:
                with system.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                    out.append(file.read())
            yield pd.Series(out, dtype=object)

    spread = files.repartition(total // TASK_BYTES + 1)
    empty = spread.filter("size = 0").withColumn("content", F.lit(b""))
    return spread.filter("size > 0").withColumn("content", read("path")).unionByName(empty)
