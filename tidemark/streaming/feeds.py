"""Change-feed jobs: continuous pull, echo removal, sequence checks, lag."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import ids
from tidemark.operators.skew import previous_row
from tidemark.schemas import ECHO_TTL_MS
from tidemark.session import cut_lineage
from tidemark.streaming.state import PullState, SchemaMismatch, check_schema, check_sequence

__all__ = [
    "EchoFilter", "PullState", "PushQueue", "SchemaMismatch", "check_schema", "check_sequence", "detect_recreate",
    "feed_lag", "stream_config_pull", "stream_logs", "stream_pull", "stream_push_candidates", "stream_suppress_echoes",
    "suppress_echoes",
]

def _now(table):
    """A table, or what a callable gives when it is asked."""
    return table() if callable(table) else table


def stream_pull(
    changes: DataFrame,
    state: PullState,
    checkpoint: str,
    unpushed_ids: DataFrame | Callable[[], DataFrame],
    chunks: DataFrame | Callable[[], DataFrame],
    trigger: dict | None = None,
    remote: DataFrame | Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Continuous pull of a change stream into ``state``.

    Side tables are read per batch; give callables where their files change.  A sequence
    that runs backwards means the remote was recreated: the file feed fails (see
    :func:`check_sequence`).
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        state.apply(cut_lineage(batch), batch_id, _now(unpushed_ids), _now(chunks), _now(remote), "file")

    return (
        changes.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_config_pull(
    feed: Callable[[int], DataFrame], state: PullState, checkpoint: str, trigger: dict | None = None
) -> int:
    """Pull of a settings feed that starts itself anew, once, when the remote was recreated.

    ``feed(epoch)`` is the remote's change stream from sequence 0.  When a sequence runs
    backwards, the state commits a new epoch with the cursor at 0, the stream ends, and a new
    one with a checkpoint of its own reads the feed from the start; up to the sequence that
    gave the recreation away the remote has authority over local clocks.  Running backwards
    in the new epoch fails the job.  Runs until the trigger ends it, resumes in the epoch
    the state is in, and returns that epoch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        state.apply_config(cut_lineage(batch), batch_id)

    while True:
        epoch = state.epoch()
        query = (
            feed(epoch).writeStream.foreachBatch(each)
            .option("checkpointLocation", f"{checkpoint.rstrip('/')}/epoch={epoch}")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
        try:
            query.awaitTermination()
            return epoch
        except StreamingQueryException:
            if state.epoch() == epoch:
                raise


def _number(df: DataFrame, column: str):
    """A sequence column as a number; text sequences by their numeric prefix."""
    return ids.seq_number(column) if df.schema[column].dataType.typeName() == "string" else F.col(column)


def detect_recreate(batches: DataFrame, feed: str, slices: int | None = None) -> DataFrame:
    """``(batch_no, last_seq, action)`` over a table of feed batches.

    ok; reset: the first regression of a settings feed, pulled again from 0 with
    ``recreate``; fail: any regression of a file feed, or a second one.
    """
    one = batches.select("batch_no", _number(batches, "last_seq").alias("last_seq"), F.lit(0).alias("_g"))
    seen = previous_row(one, ["_g"], ["batch_no"], {"last_seq": "_cursor"}, slices)
    back = seen.withColumn("_back", F.coalesce(F.col("last_seq") < F.col("_cursor"), F.lit(False)))
    first = back.filter("_back").agg(F.min("batch_no").alias("_first"))
    joined = back.withColumn("_k", F.lit(1)).join(F.broadcast(first.withColumn("_k", F.lit(1))), "_k")
    again = F.when(F.lit(feed == "config") & (F.col("batch_no") == F.col("_first")), "reset").otherwise("fail")
    return joined.select("batch_no", "last_seq", F.when(F.col("_back"), again).otherwise("ok").alias("action"))


def suppress_echoes(
    changes: DataFrame, pull_writes: DataFrame, now: int, ttl_ms: int = ECHO_TTL_MS
) -> tuple[DataFrame, DataFrame]:
    """``(kept, records)``: changes (``id, seq``) no newer than what a pull wrote
    under the same id are dropped; records of seen ids and expired ones go."""
    latest = pull_writes.groupBy("id").agg(F.max_by(F.struct("seq", "added_at"), "added_at").alias("w"))
    written = latest.select("id", F.col("w.seq").alias("_w"), F.col("w.added_at").alias("added_at"))
    kept = (
        changes.join(written.select("id", "_w"), "id", "left")
        .filter(F.col("_w").isNull() | (F.col("seq") > F.col("_w")))
        .drop("_w")
    )
    left = (
        written.join(changes.select("id").distinct(), "id", "left_anti")
        .filter(F.lit(now) - F.col("added_at") <= ttl_ms)
        .select("id", F.col("_w").alias("seq"), "added_at")
    )
    return kept, left


def _fed(rows: DataFrame, delay: str, **columns) -> DataFrame:
    """One input of a keyed job: its event time marked, then its columns, ``at`` in ms."""
    marked = rows.withWatermark("ts", delay)
    return marked.select(*[c.alias(n) for n, c in columns.items()], F.unix_millis("ts").alias("at"), "ts")


class EchoFilter(StatefulProcessor):
    """Per id: the newest pull write, forgotten once seen or when its time is over."""

    def __init__(self, ttl_ms: int = ECHO_TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "seq bigint, at bigint")

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.written.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, at = self.written.get() if self.written.exists() else (None, None)
        before = at
        seen = False
        frames = list(rows)  # one id's rows of one batch; a write may follow its echo
        for frame in frames:
            writes = frame[frame["is_write"]].sort_values(["at", "seq"])
            if len(writes) and (at is None or writes["at"].iloc[-1] >= at):
                seq, at = int(writes["seq"].iloc[-1]), int(writes["at"].iloc[-1])
        for frame in frames:
            changes = frame[~frame["is_write"]]
            seen = seen or len(changes) > 0
            if seq is not None:
                changes = changes[changes["seq"] > seq]
            if len(changes):
                yield changes[["id", "seq"]]
        if seen:
            self._forget()
        elif at != before:
            self._forget()
            self.written.update((seq, at))
            self.handle.registerTimer(at + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.written.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_suppress_echoes(
    changes: DataFrame, pull_writes: DataFrame, ttl_ms: int = ECHO_TTL_MS, delay: str = "10 seconds"
) -> DataFrame:
    """Streaming :func:`suppress_echoes`; both inputs are streams of ``id, seq, ts``.

    A write and its echo in one micro-batch are matched as well.  Records expire by event
    time: once the watermark, which follows the slower of the two inputs, is ``ttl_ms``
    past the write.  ``ts`` is when a row entered its log; Spark drops rows that come more
    than ``delay`` behind the watermark.
    """
    both = _fed(pull_writes, delay, id=F.col("id"), seq=F.col("seq"), is_write=F.lit(True)).unionByName(
        _fed(changes, delay, id=F.col("id"), seq=F.col("seq"), is_write=F.lit(False))
    )
    return both.groupBy("id").transformWithStateInPandas(
        statefulProcessor=EchoFilter(ttl_ms),
        outputStructType=T.StructType().add("id", "string").add("seq", "long"),
        outputMode="append",
        timeMode="EventTime",
    )


class PushQueue(StatefulProcessor):
    """Per id: its doc, the newest pull write, and whether it waits to be pushed again."""

    def __init__(self, since: int, wait_ms: int):
        self.since, self.wait = since, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "push", "seq bigint, alive boolean, written bigint, queued_at bigint, judge_at bigint"
        )

    def _judge(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, alive, written, queued_at, judge_at = self.state.get() if self.state.exists() else (None, False, None, None, None)
        newest, due = seq, judge_at
        for frame in rows:
            docs = frame[frame["what"] == "doc"]
            if len(docs) and (newest is None or docs["seq"].max() > newest):
                row = docs.loc[docs["seq"].idxmax()]
                newest, alive = int(row["seq"]), bool(row["flag"])
            writes = frame[frame["what"] == "write"]
            if len(writes):
                written = max(int(writes["seq"].max()), -1 if written is None else written)
            queue = frame[frame["what"] == "queue"].sort_values(["at", "flag"], ascending=[True, False])
            if len(queue) and (queued_at is None or queue["at"].iloc[-1] >= abs(queued_at)):
                # Leaving is kept as a negative time, so that an older entry can't undo it.
                at, enters = int(queue["at"].iloc[-1]), bool(queue["flag"].iloc[-1])
                queued_at, judge_at = (at, at + self.wait) if enters else (-at, None)
        changed = newest is not None and newest != seq and newest > self.since
        if changed and alive and (written is None or newest > written):
            judge_at = None  # this push is the queued id's next try as well
            yield pd.DataFrame({"_id": [key[0]], "origin": ["change"]})
        if judge_at != due:
            self._judge(judge_at)
        self.state.update((newest, alive, written, queued_at, judge_at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, alive, written, queued_at, _ = self.state.get()
        if not alive:
            queued_at = -abs(queued_at)
        self.state.update((seq, alive, written, queued_at, None))
        yield pd.DataFrame({"_id": [key[0]], "origin": ["retry" if alive else "zombie"]})

    def close(self) -> None:
        pass


def stream_push_candidates(
    docs: DataFrame, pull_writes: DataFrame, queue: DataFrame, since: int = 0, wait_ms: int = 1000, delay: str = "10 seconds"
) -> DataFrame:
    """Streaming ``push_candidates``: ``(_id, origin)`` with origin change, retry or zombie.

    ``docs`` (``_id, _local_seq, ts``, optional ``_deleted``) is the local feed,
    ``pull_writes`` has ``id, seq, ts``, and ``queue`` (``id, queued, ts``) tells which ids
    enter or leave the set of ids still to be pushed.  A changed doc that no pull wrote goes
    out at once.  A queued id is judged ``wait_ms`` after it was queued, by event time: again
    if its doc is there and did not go out meanwhile, else it is a zombie and leaves the set.
    A try that fails is queued anew.
    """
    removed = F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in docs.columns else F.lit(False)
    fed = [
        _fed(docs.withColumnRenamed("_id", "id"), delay, id=F.col("id"), what=F.lit("doc"), seq=F.col("_local_seq"),
             flag=~removed & ids.is_replicated("id")),
        _fed(pull_writes, delay, id=F.col("id"), what=F.lit("write"), seq=F.col("seq"), flag=F.lit(True)),
        _fed(queue, delay, id=F.col("id"), what=F.lit("queue"), seq=F.lit(0).cast("bigint"), flag=F.col("queued")),
    ]
    return fed[0].unionByName(fed[1]).unionByName(fed[2]).groupBy("id").transformWithStateInPandas(
        statefulProcessor=PushQueue(since, wait_ms),
        outputStructType=T.StructType().add("_id", "string").add("origin", "string"),
        outputMode="append",
        timeMode="EventTime",
    )


def feed_lag(ticks: DataFrame, grace_ms: int = 60_000, slices: int | None = None) -> DataFrame:
    """``(store, ts, lag, state)`` per health tick.

    ``ticks``: ``store, ts, remote_seq, consumed_seq, last_bytes_at``.  busy: bytes
    arrived within the grace time; stalled: lagging while the remote did not
    move since the last tick that was not busy; else healthy.
    """
    for column in ("remote_seq", "consumed_seq"):
        ticks = ticks.withColumn(column, _number(ticks, column))
    lag = F.col("remote_seq") - F.col("consumed_seq")
    busy = F.coalesce(F.col("ts") - F.col("last_bytes_at") < grace_ms, F.lit(False))
    rows = ticks.withColumn("lag", lag).withColumn("_busy", busy)
    quiet = previous_row(
        rows.filter(~F.col("_busy")), ["store"], ["ts"], {"remote_seq": "_seen"}, slices
    )
    stalled = (F.col("lag") != 0) & (F.col("remote_seq") == F.col("_seen"))
    return quiet.select(
        "store", "ts", "lag", F.when(stalled, "stalled").otherwise("healthy").alias("state")
    ).unionAll(rows.filter("_busy").select("store", "ts", "lag", F.lit("busy")))


def stream_logs(logs: DataFrame) -> DataFrame:
    """Running per-level counts of a log stream (update or complete mode)."""
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("entries"))
