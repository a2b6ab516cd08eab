"""Debounced firings per path: batch forms and a stateful stream.

Events are ``(ts, path, old_path, kind)``; kinds modify and create arm a path,
delete cancels it, rename cancels the old path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.components import components
from tidemark.operators.skew import previous_row, running_max
from tidemark.session import cut_lineage

ARM, CANCEL = "arm", "cancel"


def steps(events: DataFrame) -> DataFrame:
    """``(path, at, what, target)`` in epoch milliseconds: one row per path touched.

    A rename cancels its old path and names the new one as ``target``.
    """
    at = F.floor(F.unix_micros("ts") / 1000)
    kind = F.col("kind")
    old = F.col("old_path") if "old_path" in events.columns else F.lit(None).cast("string")
    path = F.when(kind == "rename", old).otherwise(F.col("path"))
    what = F.when(kind.isin("modify", "create"), ARM).when(kind.isin("delete", "rename"), CANCEL)
    return events.select(
        path.alias("path"), at.alias("at"), what.alias("what"),
        F.when(kind == "rename", F.col("path")).alias("target"),
    ).filter(F.col("what").isNotNull())


def _following(rows: DataFrame, slices: int | None) -> DataFrame:
    """Adds ``next_at`` and ``next_what``: the next step on the same path."""
    back = rows.withColumn("_neg", -F.col("at")).withColumn(
        # At one instant an arm comes before a cancel.
        "_tie", F.when(F.col("what") == ARM, 1).otherwise(0)
    )
    return previous_row(
        back, ["path"], ["_neg", "_tie"], {"at": "next_at", "what": "next_what"}, slices
    ).drop("_neg", "_tie")


def debounce(events: DataFrame, quiet_ms: int, mode: str = "push", slices: int | None = None) -> DataFrame:
    """``(path, fire_at, next_at)``: one firing per burst, at last event + quiet.

    An armed path fires unless the next step on it comes within ``quiet_ms``;
    that step re-arms or cancels, so one look ahead decides each event.  In
    ``history`` mode a rename hands a pending burst on to the new path, however
    long the chain of renames (:func:`captures`); ``next_at`` is NULL there.
    """
    if mode == "history":
        return captures(events, quiet_ms, 0, slices).select(
            "path", F.col("run_at").alias("fire_at"), F.lit(None).cast("bigint").alias("next_at")
        )
    ahead = _following(steps(events), slices)
    fires = (F.col("what") == ARM) & (
        F.col("next_at").isNull() | (F.col("next_at") - F.col("at") > quiet_ms)
    )
    return ahead.filter(fires).select("path", (F.col("at") + quiet_ms).alias("fire_at"), "next_at")


RUNS = T.StructType().add("path", "string").add("run_at", "long")


def _segments(rows: DataFrame, gap_ms: int, slices: int | None) -> DataFrame:
    """Adds ``_from``: the start of the row's run of rows of one ``_key`` without a gap.

    Timers of different segments know nothing of each other, so a busy key is
    spread over as many tasks as it has segments.
    """
    rows = cut_lineage(rows)
    before = previous_row(rows, ["_key"], ["at", "_rank", "path"], {"at": "_before"}, slices)
    opens = F.when(F.col("_before").isNull() | (F.col("at") - F.col("_before") > gap_ms), F.col("at"))
    return running_max(before, ["_key"], ["at", "_rank", "path"], opens, "_from", slices).drop("_before")


def _folded(rows: DataFrame, fold) -> DataFrame:
    """Streams whole segments through ``fold``, an object with ``step`` and ``finish``."""
    ordered = rows.repartition("_key", "_from").sortWithinPartitions("_key", "_from", "at", "_rank", "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, state = None, None
        for frame in frames:
            out: list[tuple[str, int]] = []
            for r in frame.itertuples(index=False):
                if (r.key, r.start) != segment:
                    if state is not None:
                        out += state.finish()
                    segment, state = (r.key, r.start), fold()
                out += state.step(r)
            yield pd.DataFrame(out, columns=["path", "run_at"])
        if state is not None:
            yield pd.DataFrame(state.finish(), columns=["path", "run_at"])

    return ordered.withColumnsRenamed({"_key": "key", "_from": "start", "_rank": "rank"}).mapInPandas(run, RUNS)


def min_interval(
    firings: DataFrame, interval_ms: int, resets: DataFrame | None = None, slices: int | None = None
) -> DataFrame:
    """``(path, run_at)``: push firings thinned to one run per ``interval_ms``.

    A firing too early is delayed to last run + interval, and the next event on
    the path (``next_at``) cancels the delayed run.  ``resets`` (``path, at``:
    deletes, renames away) forget the last run.  For history see :func:`captures`.

    Two intervals without a row leave no timer and no window open, so the fold is
    sequential only between such gaps.
    """
    rows = firings.select("path", F.col("fire_at").alias("at"), "next_at", F.lit(1).alias("_rank"))
    if resets is not None:
        rows = rows.unionAll(resets.select("path", "at", F.lit(None).cast("bigint"), F.lit(0)))
    rows = _segments(rows.withColumn("_key", F.col("path")), 2 * interval_ms, slices)

    class Push:
        def __init__(self) -> None:
            self.gate, self.path = Gate(interval_ms, "push"), None

        def step(self, r) -> list[tuple[str, int]]:
            self.path = r.path
            if not r.rank:
                return [(r.path, t) for t in self.gate.reset(int(r.at))]
            nxt = None if pd.isna(r.next_at) else int(r.next_at)
            return [(r.path, t) for t in self.gate.fire(int(r.at), nxt)]

        def finish(self) -> list[tuple[str, int]]:
            return [(self.path, t) for t in self.gate.finish()]

    return _folded(rows, Push)


def captures(events: DataFrame, quiet_ms: int, interval_ms: int, slices: int | None = None) -> DataFrame:
    """``(path, run_at)``: history runs, debounced and thinned, with renames.

    A burst runs ``quiet_ms`` after its last event; a run sooner than
    ``interval_ms`` after the last one is delayed, and a later burst takes its
    place.  Only a run that finds a change (optional event column ``changed``,
    default true) restarts the window.  A rename moves the window and the unseen
    change to the new path and, when a burst or a delayed run was pending, arms
    the new path anew; a delete forgets everything.

    Paths that renames join share a key and one fold; its state is the timers of
    the paths of one segment, and the key itself comes from a distributed
    component search, so chains may have any length.
    """
    rows = capture_rows(events)
    rows = with_group(rows, rename_groups(rows))
    rows = _segments(rows, quiet_ms + 2 * interval_ms, slices)
    return _folded(rows, lambda: History(quiet_ms, interval_ms))


def capture_rows(events: DataFrame) -> DataFrame:
    """``(path, old, at, _rank, changed)`` of the events that history looks at."""
    kind = F.col("kind")
    old = F.col("old_path") if "old_path" in events.columns else F.lit(None).cast("string")
    changed = F.coalesce(F.col("changed"), F.lit(True)) if "changed" in events.columns else F.lit(True)
    rank = F.when(kind.isin("modify", "create"), 0).when(kind == "rename", 1).when(kind == "delete", 2)
    return events.select(
        "path", F.when(kind == "rename", old).alias("old"), F.floor(F.unix_micros("ts") / 1000).alias("at"),
        rank.alias("_rank"), changed.alias("changed"),
    ).filter(F.col("_rank").isNotNull())


def rename_groups(rows: DataFrame) -> DataFrame | None:
    """``(_path, _joined)`` of the paths that renames join, None without any.

    Paths go by a 64-bit hash: two that share one would only be folded side by side.
    """
    renames = rows.filter("old is not null and old <> path")
    if renames.isEmpty():
        return None
    found = components(
        renames.select(F.xxhash64("path").alias("a"), F.xxhash64("old").alias("b")), contract=True
    )
    return cut_lineage(found).withColumnsRenamed({"id": "_path", "component": "_joined"})


def with_group(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds ``_key``: the group of a path, or the hash of the path itself."""
    own = rows.withColumn("_path", F.xxhash64("path"))
    if groups is None:
        return own.withColumnRenamed("_path", "_key")
    return own.join(groups, "_path", "left").withColumn("_key", F.coalesce("_joined", "_path")).drop("_joined", "_path")


class History:
    """Timers of the paths of one group; renames move them from path to path."""

    def __init__(self, quiet_ms: int, interval_ms: int) -> None:
        self.quiet, self.interval = quiet_ms, interval_ms
        self.paths: dict[str, Capture] = {}

    def _at(self, path: str, now: int) -> tuple[Capture, list[tuple[str, int]]]:
        state = self.paths.setdefault(path, Capture(self.quiet, self.interval))
        return state, [(path, t) for t in state.until(now)]

    def step(self, r) -> list[tuple[str, int]]:
        now = int(r.at)
        state, out = self._at(r.path, now)
        if r.rank == 0:
            state.armed, state.dirty = now + self.quiet, state.dirty or bool(r.changed)
        elif r.rank == 2:
            self.paths.pop(r.path)
        elif r.old is not None and r.old != r.path:
            gone, more = self._at(r.old, now)
            out += more
            self.paths.pop(r.old)
            state.last = gone.last if gone.last is not None else state.last
            state.dirty = gone.dirty
            if gone.armed is not None or gone.due is not None:
                state.armed = now + self.quiet
        return out

    def finish(self, now: int | None = None) -> list[tuple[str, int]]:
        """Runs everything due before ``now``, or all that is left."""
        return [(p, t) for p, s in self.paths.items() for t in s.until(now)]


class Capture:
    """Debounce and minimum interval of one path's history."""

    def __init__(self, quiet_ms: int, interval_ms: int):
        self.quiet, self.interval = quiet_ms, interval_ms
        self.armed = self.due = self.last = None
        self.dirty = False

    def _ran(self, at: int) -> int:
        if self.dirty:
            self.last, self.dirty = at, False
        return at

    def until(self, now: int | None) -> list[int]:
        """Runs what is due; an event at the same instant beats the quiet time only."""
        out = []
        while True:
            armed = self.armed if self.armed is not None and (now is None or self.armed < now) else None
            due = self.due if self.due is not None and (now is None or self.due <= now) else None
            if due is not None and (armed is None or due <= armed):
                self.due = None
                out.append(self._ran(due))
            elif armed is not None:
                self.armed = None
                if self.last is None or armed - self.last >= self.interval:
                    out.append(self._ran(armed))
                else:
                    self.due = self.last + self.interval
            else:
                return out


class Gate:
    """Minimum interval between runs of one path."""

    def __init__(self, interval_ms: int, mode: str, last: int | None = None,
                 due: int | None = None, due_changed: bool = True):
        self.interval, self.mode = interval_ms, mode
        self.last, self.due, self.due_changed = last, due, due_changed

    def _ran(self, at: int, changed: bool) -> int:
        if self.mode == "push" or changed:
            self.last = at
        return at

    def until(self, now: int) -> list[int]:
        """The delayed run, when its time has come."""
        if self.due is None or self.due > now:
            return []
        at, self.due = self.due, None
        return [self._ran(at, self.due_changed)]

    def fire(self, at: int, next_at: int | None, changed: bool = True) -> list[int]:
        out = self.until(at)
        if self.last is None or at - self.last >= self.interval:
            self.due = None
            return out + [self._ran(at, changed)]
        due = self.last + self.interval
        # In push mode an event before the delayed run cancels it.
        cancelled = self.mode == "push" and next_at is not None and next_at < due
        self.due, self.due_changed = (None if cancelled else due), changed
        return out

    def reset(self, at: int) -> list[int]:
        out = self.until(at)
        self.last = self.due = None
        return out

    def finish(self) -> list[int]:
        return self.until(self.due) if self.due is not None else []


class PathTimers(StatefulProcessor):
    """Debounce, then minimum interval, by event-time timers; one state per path."""

    def __init__(self, quiet_ms: int, interval_ms: int = 0, mode: str = "push"):
        self.quiet, self.interval, self.mode = quiet_ms, interval_ms, mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("timers", "armed bigint, last bigint, due bigint")

    def _load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (None, None, None)

    def _save(self, armed, gate: Gate) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if armed is not None:
            self.handle.registerTimer(armed)
        if gate.due is not None:
            self.handle.registerTimer(gate.due)
        if armed is None and gate.last is None and gate.due is None:
            self.state.clear()
        else:
            self.state.update((armed, gate.last, gate.due))

    def _advance(self, armed, gate: Gate, now: int) -> tuple:
        """Runs everything due strictly before the step at ``now``."""
        out = []
        if armed is not None and armed < now:
            out += gate.fire(armed, None)
            armed = None
        if gate.due is not None and gate.due <= now:
            out += gate.until(now)
        return armed, out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        armed, last, due = self._load()
        gate = Gate(self.interval, self.mode, last, due)
        out: list[int] = []
        frame = pd.concat(list(rows)).sort_values(["at", "what"])
        for at, what in zip(frame["at"].tolist(), frame["what"].tolist()):
            armed, ran = self._advance(armed, gate, at)
            out += ran
            if self.mode == "push" and gate.due is not None and at < gate.due:
                gate.due = None
            if what == ARM:
                armed = max(armed or 0, at + self.quiet)
            else:
                armed = None
                gate.last = gate.due = None
        self._save(armed, gate)
        if out:
            yield pd.DataFrame({"path": [key[0]] * len(out), "run_at": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Nothing before the watermark comes any more, and a delayed run that this
        # firing starts may be due already: its own timer could miss the last batch.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        armed, last, due = self._load()
        gate = Gate(self.interval, self.mode, last, due)
        armed, out = self._advance(armed, gate, now + 1)
        self._save(armed, gate)
        if out:
            yield pd.DataFrame({"path": [key[0]] * len(out), "run_at": out})

    def close(self) -> None:
        pass


def stream_timers(
    events: DataFrame, quiet_ms: int, interval_ms: int = 0, mode: str = "push", delay: str = "10 seconds"
) -> DataFrame:
    """Streaming :func:`debounce` (``interval_ms=0``) or debounce plus
    :func:`min_interval`, with a watermark ``delay`` on the event time.

    History follows renames from path to path, which a state per path can't: see
    ``stream_captures``.
    """
    if mode != "push":
        raise ValueError(f"no state per path for mode {mode!r}")
    rows = steps(events.withWatermark("ts", delay).withColumn("ts", F.col("ts")))
    return rows.groupBy("path").transformWithStateInPandas(
        statefulProcessor=PathTimers(quiet_ms, interval_ms, mode),
        outputStructType=RUNS,
        outputMode="append",
        timeMode="EventTime",
    )
