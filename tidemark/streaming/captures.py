"""History runs over renames as a stream: timers that move from path to path.

A state per path can't follow a rename, and which paths belong together is known only as
renames come.  So each micro-batch finds the groups of paths that its renames join, by the
distributed component search, brings the timers of those paths and the events of the
batch together by group, and folds every group in time order.  Timers go back under the
paths that hold them then, so the next batch may join them in other groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import cut_lineage
from tidemark.streaming.state import Committed
from tidemark.streaming.timers import RUNS, Capture, History, capture_rows, rename_groups, with_group

BUFFER = (
    T.StructType().add("path", "string").add("old", "string").add("at", "long").add("_rank", "integer")
    .add("changed", "boolean")
)
TIMERS = (
    T.StructType().add("path", "string").add("armed", "long").add("due", "long").add("last", "long")
    .add("dirty", "boolean")
)
COMMITS = T.StructType().add("no", "long").add("batch_id", "long").add("watermark", "long")
FAR = 1 << 60


class CaptureState(Committed):
    """Timers, events not yet behind the watermark, and the runs of a capture stream.

    The watermark is the newest event time less ``delay_ms``; events are folded once it has
    passed them, in time order whatever their arrival.  One that comes later than that
    counts at the watermark, none is dropped.  A path without a pending run, an unseen
    change or an open window is forgotten.  Every batch commits once; a replay is a no-op.
    """

    COMMITS = COMMITS

    def __init__(self, spark, folder: str, quiet_ms: int, interval_ms: int, delay_ms: int = 10_000):
        super().__init__(spark, folder)
        self.quiet, self.interval, self.delay = quiet_ms, interval_ms, delay_ms

    def _rows(self, name: str, schema: T.StructType, top) -> DataFrame:
        if top is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/no={top['no']}")

    def runs(self) -> DataFrame:
        """``(path, run_at)`` of all committed batches."""
        top = self.head()
        if top is None:
            return self.spark.createDataFrame([], RUNS)
        rows = self.spark.read.schema(T.StructType([*RUNS.fields, T.StructField("no", T.LongType())])).parquet(f"{self.folder}/runs")
        return rows.filter(F.col("no") <= top["no"]).drop("no")

    def apply(self, events: DataFrame, batch_id: int) -> bool:
        """Folds one batch of events; False when it was done before."""
        return self._advance(capture_rows(events), batch_id, False)

    def close(self) -> None:
        """Runs what is left, once no event comes any more."""
        top = self.head()
        if top is not None:
            self._advance(self.spark.createDataFrame([], BUFFER), top["batch_id"] + 1, True)

    def _advance(self, rows: DataFrame, batch_id: int, last: bool) -> bool:
        top = self.head()
        if top is not None and batch_id <= top["batch_id"]:
            return False
        no, passed = (0, -FAR) if top is None else (top["no"] + 1, top["watermark"])
        fresh = rows.withColumn("at", F.greatest("at", F.lit(passed)))
        held = cut_lineage(
            fresh.select([F.col(f.name).cast(f.dataType) for f in BUFFER]).unionByName(self._rows("buffer", BUFFER, top))
        )
        newest = held.agg(F.max("at")).first()[0]
        mark = FAR if last else max(passed, -FAR if newest is None else newest - self.delay)
        ready = held.filter(F.col("at") <= mark)
        out = cut_lineage(self._folded(ready, self._rows("timers", TIMERS, top), mark))
        out.filter("run_at is not null").select(*RUNS.names).write.mode("overwrite").parquet(f"{self.folder}/runs/no={no}")
        out.filter("run_at is null").select(*TIMERS.names).write.mode("overwrite").parquet(f"{self.folder}/timers/no={no}")
        held.filter(F.col("at") > mark).write.mode("overwrite").parquet(f"{self.folder}/buffer/no={no}")
        row = self.spark.range(1).select(
            F.lit(no).cast("bigint").alias("no"), F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.lit(mark).cast("bigint").alias("watermark"),
        )
        for old in self._committed(row, no)[:-1]:
            for name in ("timers", "buffer", "commits"):
                self._remove(f"{name}/no={old['no']}")
        return True

    def _folded(self, ready: DataFrame, timers: DataFrame, mark: int) -> DataFrame:
        """Runs (with ``run_at``) and next timers (without) of all groups."""
        groups = rename_groups(ready)
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in (*BUFFER, *TIMERS)}
        steps = with_group(ready, groups).select(
            "_key", *BUFFER.names, *[none[c] for c in TIMERS.names if c != "path"]
        )
        states = with_group(timers, groups).select(
            "_key", "path", *[none[c] for c in BUFFER.names if c not in ("path", "_rank")], F.lit(-1).alias("_rank"),
            *[c for c in TIMERS.names if c != "path"]
        )
        met = steps.unionByName(states).repartition("_key").sortWithinPartitions(
            # A group's timers come first, then its events in time order.
            "_key", F.col("at").asc_nulls_first(), "_rank", "path"
        )
        quiet, interval = self.quiet, self.interval

        def left(group: History) -> Iterator[tuple]:
            # All events up to the mark are in: what is due by then runs.
            for path, at in group.finish(mark + 1):
                yield path, at, None, None, None, None
            for path, s in group.paths.items():
                open_ = s.last is not None and s.last + interval > mark
                if s.armed is not None or s.due is not None or s.dirty or open_:
                    yield path, None, s.armed, s.due, s.last, s.dirty

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = ["path", "run_at", "armed", "due", "last", "dirty"]
            key, group = None, None
            for frame in frames:
                out: list[tuple] = []
                for r in frame.itertuples(index=False):
                    if r.key != key:
                        if group is not None:
                            out += left(group)
                        key, group = r.key, History(quiet, interval)
                    if r.rank < 0:
                        state = group.paths[r.path] = Capture(quiet, interval)
                        state.armed, state.due, state.last = (None if pd.isna(v) else int(v) for v in (r.armed, r.due, r.last))
                        state.dirty = bool(r.dirty)
                    else:
                        out += [(path, at, None, None, None, None) for path, at in group.step(r)]
                yield _frame(out, columns)
            if group is not None:
                yield _frame(list(left(group)), columns)

        return met.withColumnsRenamed({"_key": "key", "_rank": "rank"}).mapInPandas(
            run, "path string, run_at long, armed long, due long, last long, dirty boolean"
        )


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    for name in columns[1:-1]:
        frame[name] = frame[name].astype("Int64")
    frame["dirty"] = frame["dirty"].astype("boolean")
    return frame


def stream_captures(
    events: DataFrame, state: CaptureState, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Streaming ``captures``: history runs of a stream of events land in ``state.runs()``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch, batch_id)  # written there, before its first use

    return (
        events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
