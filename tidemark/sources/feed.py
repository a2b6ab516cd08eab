"""The change feed of a durable store as a streaming source.

Offsets are the ``_local_seq`` of committed parts: a micro-batch reads the parts committed
since the last one, each part's files as tasks of their own, and nothing else of the store.
Every committed version of a doc comes once, also over restarts from a checkpoint, or its
newest one where parts were folded meanwhile; parts without a commit row are never seen,
and removals are no rows (as in ``changes_since``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.files import system_of
from tidemark.sources.store import DocStore

NAME = "tidemark_changes"


class PartFile(InputPartition):
    def __init__(self, path: str, after: int):
        self.path, self.after = path, after


class FeedReader(DataSourceStreamReader):
    def __init__(self, folder: str, since: int, schema: StructType):
        self.folder, self.since, self.schema = folder.rstrip("/"), since, schema

    def _commits(self) -> list[tuple[int, int, int]]:
        """``(gen, part, seq)`` of every committed part of the newest generation."""
        import pyarrow.dataset as ds

        system, path = system_of(self.folder)
        table = ds.dataset(f"{path}/commits", filesystem=system, format="parquet").to_table(columns=["gen", "part", "seq"])
        rows = {(r["gen"], r["part"], r["seq"]) for r in table.to_pylist()}
        return sorted(r for r in rows if r[0] == max(rows)[0])

    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        return {"seq": max([self.since, *(seq for *_, seq in self._commits())])}

    def partitions(self, start: dict, end: dict) -> list[PartFile]:
        from pyarrow import fs

        system, path = system_of(self.folder)
        found = []
        for gen, part, seq in self._commits():
            if start["seq"] < seq <= end["seq"]:
                folder = fs.FileSelector(f"{path}/docs/gen={gen}/part={part}", recursive=True)
                for info in system.get_file_info(folder):
                    if info.path.endswith(".parquet"):
                        found.append(PartFile(info.path, start["seq"]))
        return found

    def read(self, partition: PartFile) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = system_of(self.folder)
        want = to_arrow_schema(self.schema)
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=list({*want.names, "_gone", "_local_seq"})):
                new = pc.and_(pc.invert(batch.column("_gone")), pc.greater(batch.column("_local_seq"), partition.after))
                kept = batch.filter(new).select(want.names)
                if kept.num_rows:
                    yield kept.cast(want)


class ChangeFeed(DataSource):
    """``readStream.format("tidemark_changes")`` with options ``path`` and ``since``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("since", "0")), schema)


def stream_changes(spark: SparkSession, folder: str, since: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Docs of the store in ``folder`` as they are committed, after ``since``."""
    spark.dataSource.register(ChangeFeed)
    docs = DocStore(spark, folder).docs()
    schema = (docs if columns is None else docs.select(*columns)).schema
    return spark.readStream.format(NAME).schema(schema).option("path", folder).option("since", since).load()
