"""Applying a reconcile plan, by hand-made paths and by planning again."""

import hashlib

from pyspark.sql import functions as F

from tidemark.plans import apply, reconcile
from tidemark.schemas import FILE_DOCS
from tidemark.sources.store import DocStore

DEVICE = "me"
BASES = "path_key string, vclock map<string,bigint>, chunks array<string>, size long, mtime long, deleted boolean"
DISK = "path string, mtime long, ctime long, size long, content binary"
NONE = "_id string, content binary"


def ids(body):
    return [f"chunk:s256:{hashlib.sha256(body.encode()).hexdigest()}"]


def doc(path, body, clock, deleted=False, seq=1):
    return (f"file:{path}", 2, ids(body), 10, 10, len(body), deleted, clock, 1, seq)


def base(path, body, clock):
    return (path.lower(), clock, ids(body), len(body), 5, False)


def file(path, body, mtime=5):
    return (path, mtime, mtime, len(body), bytearray(body.encode()))


def tables(spark):
    docs = [
        doc("same.md", "same", {"me": 1}), doc("edit.md", "old", {"me": 1}), doc("gone.md", "gone", {"me": 2}),
        doc("pull.md", "theirs", {"me": 1, "you": 1}), doc("restore.md", "fresh", {"you": 1}),
        doc("clash.md", "yours", {"you": 1}), doc("dead.md", "dead", {"me": 1, "you": 1}, True),
        doc("Twin.md", "twin", {"me": 2}), doc("twin.md", "twin", {"me": 1}), doc("waits.md", "moved", {"you": 3}),
    ]
    bases = [
        base("same.md", "same", {"me": 1}), base("edit.md", "old", {"me": 1}), base("gone.md", "gone", {"me": 2}),
        base("pull.md", "mine", {"me": 1}), base("clash.md", "first", {"me": 1}), base("dead.md", "dead", {"me": 1}),
        base("twin.md", "twin", {"me": 1}), base("waits.md", "here", {"you": 3}),
    ]
    disk = [
        file("same.md", "same"), file("edit.md", "newer"), file("pull.md", "mine"), file("clash.md", "mine"),
        file("new.md", "new"), file("dead.md", "dead"), file("big.md", "x" * 3000), file("Twin.md", "twin"), file("twin.md", "twin"),
        file("out/skip.tmp", "tmp"), file("small.md", "now small"),
    ]
    return (
        spark.createDataFrame(disk, DISK), spark.createDataFrame(docs, FILE_DOCS), spark.createDataFrame(bases, BASES),
        {"theirs": "theirs", "fresh": "fresh"},
    )


def planned(disk, docs, bases, manifest):
    return reconcile.reconcile_plan(disk, docs, bases, manifest, DEVICE, with_doc=True)


def run(spark, disk, docs, bases):
    # "waits.md" is no path of this plan: a job of its own is at work on it.
    manifest = disk.select("path")
    plan = planned(disk, docs, bases, manifest).filter("path <> 'waits.md'")
    skipped = spark.createDataFrame([("small.md", 9.0), ("big.md", 9.0)], "path_key string, size_mb double")
    return plan, apply.apply_plan(
        plan, disk, docs, bases, DEVICE, skipped, exclude_re=r"[.]tmp$", max_mb=2000 / (1 << 20)
    )


def test_apply(spark):
    disk, docs, bases, _ = tables(spark)
    plan, done = run(spark, disk, docs, bases)
    actions = {r["path"]: r["action"] for r in plan.collect() if r["action"] != "collision-resolved"}
    assert actions == {
        "same.md": "align", "edit.md": "push", "gone.md": "delete", "pull.md": "pull", "restore.md": "restore",
        "clash.md": "conflict-edit", "new.md": "push", "dead.md": "delete-apply", "big.md": "push",
        "twin.md": "dedup-file", "out/skip.tmp": "push", "small.md": "push",
    }
    got = {r["_id"][5:]: (r["vclock"], r["deleted"], r["expected_vclock"]) for r in done.docs.collect()}
    assert got == {
        "edit.md": ({"me": 2}, False, {"me": 1}), "gone.md": ({"me": 3}, True, {"me": 2}), "new.md": ({"me": 1}, False, {}),
        "small.md": ({"me": 1}, False, {}), "twin.md": ({"me": 2}, True, {"me": 1}),
    }
    assert {r["_id"] for r in done.chunks.collect()} == {x for b in ("newer", "new", "now small") for x in ids(b)}
    assert {(r["path"], r["op"], r["size"]) for r in done.disk.collect()} == {
        ("pull.md", "write", 6), ("restore.md", "write", 5), ("dead.md", "delete", None), ("twin.md", "delete", None)
    }
    told = {r["path_key"]: (r["vclock"], r["size"], r["deleted"]) for r in done.baselines.collect()}
    assert told == {
        "edit.md": ({"me": 2}, 5, False), "gone.md": ({"me": 3}, 0, True), "new.md": ({"me": 1}, 3, False),
        "small.md": ({"me": 1}, 9, False), "pull.md": ({"me": 1, "you": 1}, 6, False), "restore.md": ({"you": 1}, 5, False),
        "dead.md": ({"me": 1, "you": 1}, 0, True), "twin.md": ({"me": 2}, 4, False),
    }
    assert {(r["path"], r["size_mb"]) for r in done.skipped.collect()} == {("big.md", 0.0), ("small.md", None)}
    assert {(r["path"], r["kind"]) for r in done.conflicts.collect()} == {("clash.md", "edit-vs-edit")}
    assert done.quarantined.isEmpty()


def test_a_second_plan_has_nothing_left(spark, tmp_path):
    disk, docs, bases, bodies = tables(spark)
    _, done = run(spark, disk, docs, bases)
    store = DocStore(spark, str(tmp_path))
    store.start(docs, spark.createDataFrame([], NONE), baselines=bases)
    for _ in range(2):
        assert apply.settle(store, 1, disk, done, 10**6).isEmpty()
    written = spark.createDataFrame([(ids(b)[0], bytearray(b.encode())) for b in bodies.values()], "c string, content binary")
    ops = store.written("disk", 1)
    now = apply.changed(
        disk.join(ops.filter("op = 'delete'"), "path", "left_anti"),
        ops.filter("op = 'write'").join(written, F.col("chunks")[0] == F.col("c")).select(
            "path", "mtime", F.col("mtime").alias("ctime"), "size", "content"),
        "path",
    )
    after = store.table("baselines", "path_key")
    left = {r["path"]: r["action"] for r in planned(now, store.docs(), after, store.written("manifest", 1)).collect()}
    # Files that may not be pushed are found again; what another job does is left to it.
    assert {p: a for p, a in left.items() if a != "align"} == {
        "clash.md": "conflict-edit", "big.md": "push", "out/skip.tmp": "push", "waits.md": "delete",
    }
    assert {r["path_key"] for r in after.filter("path_key = 'waits.md' and size = 4").collect()} == {"waits.md"}
    needed = reconcile.reconcile_needed(now, store.docs(), store.written("manifest", 1), store.table("cursor", "name"))
    assert needed.first()["needed"] is False
    # Someone else wrote a doc meanwhile: nothing of the run is kept.
    other = DocStore(spark, f"{tmp_path}/other")
    other.start(docs.withColumn("vclock", F.create_map(F.lit("you"), F.lit(9).cast("long"))), spark.createDataFrame([], NONE), baselines=bases)
    assert not apply.settle(other, 1, disk, done, 10**6).isEmpty() and other.last() == 0


def test_baselines_of_named_paths_only(spark):
    disk, docs, bases, _ = tables(spark)
    keys = spark.createDataFrame([("pull.md",)], "path_key string")
    rows = {r["path_key"]: r["label"] for r in reconcile.update_baselines(bases, docs, disk, "establish", keys).collect()}
    assert rows.pop("pull.md") == "established" and set(rows.values()) == {"unchanged"} and "waits.md" in rows


def test_a_replay_reads_no_docs_and_baselines_fold_once(spark, tmp_path, monkeypatch):
    disk, docs, bases, _ = tables(spark)
    folded = []
    fold = reconcile.with_path_key
    monkeypatch.setattr(reconcile, "with_path_key", lambda df, *a: folded.append(df.columns) or fold(df, *a))
    _, done = run(spark, disk, docs, bases)
    # The docs as they are after the run are folded once, not again in each mode.
    assert not [c for c in folded if "path_key" in c]
    store = DocStore(spark, str(tmp_path))
    store.start(docs, spark.createDataFrame([], NONE), baselines=bases)
    assert apply.settle(store, 1, disk, done, 10**6).isEmpty()
    assert store.docs(columns=["_local_seq"]).columns == ["_id", "_local_seq"]
    assert sorted(map(tuple, store.docs(columns=["_local_seq"]).collect())) == sorted(
        map(tuple, store.docs().select("_id", "_local_seq").collect())
    )
    monkeypatch.setattr(store, "docs", None)
    assert apply.settle(store, 1, disk, done, 10**6).isEmpty() and store.last() == 1
