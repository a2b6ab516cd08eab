"""Debounce and interval rules on a hand-made timeline; sequence checks."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import feeds, timers

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE = int(T0.timestamp() * 1000)
SCHEMA = "ts timestamp, path string, old_path string, kind string"


def events(spark, *rows):
    return spark.createDataFrame(
        [(T0 + timedelta(milliseconds=ms), p, o, k) for ms, p, o, k in rows], SCHEMA
    )


def fired(df):
    return sorted((r["path"], r["fire_at"] - BASE) for r in df.collect())


def test_debounce_burst_boundary_and_cancel(spark):
    df = events(
        spark, (0, "a", None, "modify"), (100, "a", None, "modify"), (301, "a", None, "create"),
        (0, "b", None, "modify"), (50, "b", None, "delete"), (0, "c", None, "modify"), (50, "d", "c", "rename"),
    )
    assert fired(timers.debounce(df, 200, slices=4)) == [("a", 300), ("a", 501)]
    history = timers.debounce(df, 200, "history", slices=4)
    assert fired(history) == [("a", 300), ("a", 501), ("d", 250)]


def test_rename_chain_hands_the_burst_on(spark):
    df = events(spark, (0, "a", None, "modify"), (50, "b", "a", "rename"), (90, "c", "b", "rename"))
    assert fired(timers.debounce(df, 200, "history", slices=4)) == [("c", 290)]


def test_gate_modes():
    push = timers.Gate(1000, "push")
    assert push.fire(0, 400) == [0]
    assert push.fire(600, 700) == []  # delayed to 1000, cancelled by the event at 700
    assert push.fire(900, None) == [] and push.finish() == [1000]
    keep = timers.Gate(1000, "history")
    assert keep.fire(0, 400) == [0]
    assert keep.fire(600, 700) == [] and keep.fire(1500, None) == [1000]
    assert keep.finish() == [2000]
    still = timers.Gate(1000, "history")
    assert still.fire(0, None, changed=False) == [0] and still.fire(10, None) == [10]


def test_sequence_check():
    assert feeds.check_sequence(5, 5, "file") == "ok"
    assert feeds.check_sequence(4, 5, "config") == "reset"
    for feed, resets in (("file", 0), ("config", 1)):
        with pytest.raises(RuntimeError):
            feeds.check_sequence(4, 5, feed, resets)


def test_pull_batch_replay_changes_nothing(spark, tmp_path):
    doc = ("file:a", 2, ["c"], 1, 1, 1, False, {"x": 1})
    from tidemark.schemas import CHANGES, FILE_DOCS

    changes = spark.createDataFrame([("file:a", 3, False, doc)], CHANGES)
    none = spark.createDataFrame([], "_id string")
    chunks = spark.createDataFrame([], "_id string, content binary")
    state = feeds.PullState(spark, str(tmp_path))
    state.start(spark.createDataFrame([], FILE_DOCS))
    assert state.apply(changes, 0, none, chunks) is True
    before = state.docs().collect()
    assert state.apply(changes, 0, none, chunks) is False
    assert state.docs().collect() == before and len(before) == 1
    assert [r["reason"] for r in state.pending_apply().collect()] == ["missing-chunks"]
    state.compact()
    assert state.docs().collect() == before and state.head()["last_seq"] == 3


def plain_runs(rows, quiet, interval):
    """Clock-by-clock push timers: rows are (ms, path, kind)."""
    out = []
    for path in {p for _, p, _ in rows}:
        armed = due = last = None

        def advance(now, armed, due, last):
            # The debounce timer loses a tie against an event, the delayed run wins it.
            while True:
                a = armed if armed is not None and armed < now else None
                d = due if due is not None and due <= now else None
                if a is None and d is None:
                    return armed, due, last
                if d is not None and (a is None or d <= a):
                    out.append((path, d))
                    last, due = d, None
                    continue
                armed = None
                if last is None or a - last >= interval:
                    out.append((path, a))
                    last, due = a, None
                else:
                    due = last + interval

        for at, kind in sorted((t, k) for t, p, k in rows if p == path):
            armed, due, last = advance(at, armed, due, last)
            due = None
            if kind == "modify":
                armed = at + quiet
            else:
                armed = last = None
        advance(10**9, armed, due, last)
    return sorted(out)


def test_min_interval_against_plain_timers(spark):
    import random

    rng = random.Random(11)
    rows = []
    for path in "abcd":
        for t in sorted(rng.sample(range(6000), 60)):
            rows.append((t, path, "modify" if rng.random() < 0.85 else "delete"))
    df = events(spark, *[(t, p, None, k) for t, p, k in rows])
    resets = timers.steps(df).filter("what = 'cancel'").select("path", "at")
    got = timers.min_interval(timers.debounce(df, 60, slices=4), 400, resets, slices=4)
    assert sorted((r["path"], r["run_at"] - BASE) for r in got.collect()) == plain_runs(rows, 60, 400)


def test_long_rename_chain(spark):
    rows = [(0, "p0", None, "modify")] + [(50 * i, f"p{i}", f"p{i - 1}", "rename") for i in range(1, 41)]
    assert fired(timers.debounce(events(spark, *rows), 200, "history", slices=4)) == [("p40", 2200)]


def runs(df):
    return sorted((r["path"], r["run_at"] - BASE) for r in df.collect())


def test_rename_carries_window_and_delayed_run(spark):
    # a runs at 50; renamed at 300, so b's burst at 600 waits for the window of a.
    df = events(spark, (0, "a", None, "modify"), (300, "b", "a", "rename"), (600, "b", None, "modify"))
    assert runs(timers.captures(df, 50, 1000, slices=4)) == [("a", 50), ("b", 1050)]
    # A delayed run (due 1050) is handed on as a fresh burst of the new path.
    df = events(spark, (0, "a", None, "modify"), (300, "a", None, "modify"), (900, "b", "a", "rename"))
    assert runs(timers.captures(df, 50, 1000, slices=4)) == [("a", 50), ("b", 1050)]
    # A delete forgets the window; far events are a segment of their own.
    df = events(spark, (0, "a", None, "modify"), (300, "a", None, "delete"), (400, "a", None, "modify"), (90_000, "a", None, "modify"))
    assert runs(timers.captures(df, 50, 1000, slices=4)) == [("a", 50), ("a", 450), ("a", 90_050)]


def test_unchanged_runs_leave_the_window_open(spark):
    df = events(spark, (0, "a", None, "modify"), (300, "a", None, "modify")).withColumn("changed", F.lit(False))
    assert runs(timers.captures(df, 50, 1000, slices=4)) == [("a", 50), ("a", 350)]


def test_history_has_no_state_per_path(spark):
    with pytest.raises(ValueError):
        timers.stream_timers(events(spark, (0, "a", None, "modify")), 50, mode="history")


def test_captures_in_batches_equal_the_whole(spark, tmp_path):
    import random

    from tidemark.streaming.captures import CaptureState

    rng = random.Random(4)
    rows, at, names = [], 0, list("abcd")
    for k in range(160):
        at += rng.choice([1, 7, 40, 120, 900])
        path = rng.choice(names)
        if rng.random() < 0.15:
            names[names.index(path)] = new = f"{path[0]}{k}"
            rows.append((at, new, path, "rename"))
        else:
            rows.append((at, path, None, "delete" if rng.random() < 0.1 else "modify"))
    want = runs(timers.captures(events(spark, *rows), 50, 400, slices=4))
    state = CaptureState(spark, str(tmp_path), 50, 400, delay_ms=100)
    batch, at = 0, 0
    while at < len(rows):
        upto = at + rng.randint(1, 60)
        some = rows[at:upto]
        rng.shuffle(some)  # within the delay the order of arrival doesn't matter
        some = sorted(some, key=lambda r: r[0] // 90)
        assert state.apply(events(spark, *some), batch) and not state.apply(events(spark, *some), batch)
        batch, at = batch + 1, upto
    before = runs(state.runs())
    assert set(before) <= set(want) and len(before) > len(want) // 2
    state.close()
    assert runs(state.runs()) == want
    assert sorted(p.name for p in (tmp_path / "timers").iterdir()) == [f"no={batch - 1}", f"no={batch}"]


def test_late_events_count_at_the_watermark(spark, tmp_path):
    from tidemark.streaming.captures import CaptureState

    state = CaptureState(spark, str(tmp_path), 50, 0, delay_ms=10)
    state.apply(events(spark, (1000, "a", None, "modify")), 0)
    state.apply(events(spark, (10, "late", None, "modify")), 1)
    state.close()
    assert runs(state.runs()) == [("a", 1050), ("late", 1040)]


def test_retry_rows_leave_the_set(spark, tmp_path):
    from tidemark.schemas import CHANGES, FILE_DOCS

    def doc(id_, chunk, n, version=2):
        return (id_, version, [chunk], 1, 1, 1, False, {"x": n})

    def changes(*rows):
        return spark.createDataFrame([(d[0], seq, False, d) for seq, d in rows], CHANGES)

    none = spark.createDataFrame([], "_id string")
    chunks = lambda *names: spark.createDataFrame([(n, b"1") for n in names], "_id string, content binary")
    pending = lambda: sorted((r["id"], r["attempts"]) for r in state.pending_apply().collect())
    state = feeds.PullState(spark, str(tmp_path))
    state.compact()
    state.start(spark.createDataFrame([], FILE_DOCS))
    state.apply(changes((1, doc("file:a", "c1", 1)), (2, doc("file:b", "c2", 1))), 0, none, chunks())
    assert pending() == [("file:a", 0), ("file:b", 0)]
    # a's next version is complete; b is tried again and stays.
    state.apply(changes((3, doc("file:a", "c3", 2))), 1, none, chunks("c3"))
    assert pending() == [("file:b", 1)]
    # b's chunk has come by itself.
    state.apply(changes((4, doc("file:z", "c3", 1))), 2, none, chunks("c2", "c3"))
    assert pending() == []
    with pytest.raises(feeds.SchemaMismatch):
        state.apply(changes((5, doc("file:y", "c3", 1, version=9))), 3, none, chunks("c3"))
    assert state.head()["batch_id"] == 2
    for _ in range(3):
        state.compact()
    assert pending() == [] and state.docs().count() == 3
    # The newest commit and the one before stay, and the versions that they name.
    assert sorted(p.name for p in (tmp_path / "commits").iterdir()) == ["no=2", "no=3"]
    assert sorted(p.name for p in (tmp_path / "pending").iterdir()) == ["v=2", "v=3"]


def test_pull_batch_opens_only_its_buckets(spark, tmp_path):
    from tidemark.schemas import CHANGES, FILE_DOCS

    def doc(i, n=1):
        return (f"file:{i}", 2, [f"c{i}.{n}"], 1, 1, 1, False, {"x": n})

    state = feeds.PullState(spark, str(tmp_path), buckets=16)
    docs = spark.createDataFrame([(*doc(i), 1, 1) for i in range(400)], FILE_DOCS)
    state.start(docs)
    none = spark.createDataFrame([], "_id string")
    chunks = spark.createDataFrame([(f"c7.{n}", b"1") for n in range(9)], "_id string, content binary")
    first = state.head()["versions"]
    one = spark.createDataFrame([("file:7", 5, False, doc(7, 2))], CHANGES)
    wanted = one.select(F.col("id").alias("_id"))
    opened = state.docs(wanted).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in opened}) == 1 and len(set(first)) == 1
    assert state.apply(one, 0, none, chunks, feed="file")
    after = state.head()["versions"]
    assert sum(a != b for a, b in zip(first, after)) == 1
    got = {r["_id"]: r["chunks"] for r in state.docs().collect()}
    assert len(got) == 400 and got["file:7"] == ["c7.2"] and got["file:8"] == ["c8.1"]
    # The bucket's first version goes once two commits have passed it by.
    for n in (3, 4):
        again = spark.createDataFrame([("file:7", 5 + n, False, doc(7, n))], CHANGES)
        assert state.apply(again, n, none, chunks, feed="file")
    bucket = next(b for b, (x, y) in enumerate(zip(first, after)) if x != y)
    assert not (tmp_path / "docs" / "v=0" / f"bucket={bucket}").exists()
    assert state.docs(wanted).first()["chunks"] == ["c7.4"] and state.docs().count() == 400
    with pytest.raises(RuntimeError, match="backwards"):
        state.apply(one, 9, none, chunks, feed="file")
    # Outgrown buckets are laid out anew.
    before = sorted(map(str, state.docs().collect()))
    state.buckets = 64
    state.compact()
    assert len(state.head()["versions"]) == 64 and sorted(map(str, state.docs().collect())) == before
    assert state.apply(spark.createDataFrame([("file:9", 50, False, doc(9, 2))], CHANGES), 10, none, chunks)
    assert state.docs().count() == 400 and [r["id"] for r in state.pending_apply().collect()] == ["file:9"]


def test_text_sequences(spark):
    rows = spark.createDataFrame([(0, "5-x"), (1, "12-g"), (2, "9-y")], "batch_no long, last_seq string")
    got = {r["batch_no"]: (r["last_seq"], r["action"]) for r in feeds.detect_recreate(rows, "file", slices=2).collect()}
    assert got == {0: (5, "ok"), 1: (12, "ok"), 2: (9, "fail")}


def test_rename_groups_of_one_batch_take_few_rounds(spark, monkeypatch):
    from tidemark.operators import components as search

    rounds = []
    star = search._star
    monkeypatch.setattr(search, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    rows = [(float(i), f"p{c}.{i + 1}", f"p{c}.{i}", "rename") for c in range(5) for i in range(40)]
    rows.append((99.0, "alone", None, "modify"))
    taken = timers.capture_rows(events(spark, *rows).coalesce(1))
    keyed = timers.with_group(taken, timers.rename_groups(taken)).collect()
    keys = {}
    for r in keyed:
        keys.setdefault(r["path"].split(".")[0], set()).add(r["_key"])
    assert all(len(k) == 1 for k in keys.values()) and len(set().union(*keys.values())) == 6
    assert sum(rounds) == 1  # a chain within a chunk is a star before the first round


@pytest.mark.parametrize("chunk", [7, 200_000])
def test_contracted_components(spark, monkeypatch, chunk):
    import random

    from tidemark.operators import components as search

    monkeypatch.setattr(search, "CHUNK_EDGES", chunk)
    rng = random.Random(chunk)
    pairs = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(3, 3), (-5, -5)]
    pairs += [(i, i + 1) for i in range(1000, 1090)]
    least = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    rows = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    for contract in (False, True):
        assert {r["id"]: r["component"] for r in search.components(rows, contract).collect()} == least
