"""Chunking round trip, hot keys, repair invariant, and line churn by brute force."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.content import is_diffable_text, lcs_length
from tidemark.operators import chunking, integrity
from tidemark.operators.skew import newest_cut, previous_row, salted_join


def test_split_and_reassemble_is_identity(spark):
    bodies = {"file:empty": b"", "file:one": b"x", "file:rnd": os.urandom(1000), "file:rep": b"ab" * 64}
    files = spark.createDataFrame(list(bodies.items()), "_id string, content binary")
    pieces = chunking.split_into_chunks(files.withColumnRenamed("_id", "doc"), 16)
    docs = chunking.file_fingerprints(files, 16)
    assert pieces.filter("doc = 'file:empty'").count() == 1
    for hot in (1_000_000, 3):  # 3: the repeated chunk is salted
        out = chunking.reassemble(docs, chunking.dedup_chunks(pieces), hot_rows=hot)
        assert {r["_id"]: bytes(r["content"]) for r in out.collect()} == bodies
    x64 = chunking.file_fingerprints(files, 16, "x64").filter("_id = 'file:one'").first()
    assert x64["chunks"][0].startswith("chunk:x64:") and len(x64["chunks"][0]) == 26


def test_missing_and_null_content(spark):
    docs = spark.createDataFrame([("file:a", ["c1", "c2", "c1"], 3, False)], "_id string, chunks array<string>, size int, deleted boolean")
    chunks = spark.createDataFrame([("c1", None), ("c2", b"y")], "_id string, content binary")
    assert integrity.missing_chunks(docs, chunks).first()["missing"] == ["c1", "c1"]
    row = chunking.reassemble(docs, chunks).first()
    assert row["status"] == "missing-chunks" and row["missing"] == ["c1", "c1"]


def test_repair_leaves_no_one_sided_chunk(spark):
    rng = random.Random(7)
    body = {f"b{i}": str(i).encode() for i in range(40)}
    table = spark.createDataFrame([(v,) for v in body.values()], "content binary").select(
        F.concat(F.lit("chunk:s256:"), F.sha2("content", 256)).alias("_id"), "content"
    ).collect()
    local = spark.createDataFrame([r for r in table if rng.random() < 0.6], table and "_id string, content binary")
    remote = spark.createDataFrame([r for r in table if rng.random() < 0.6], "_id string, content binary")
    owners = spark.createDataFrame([(f"file:{i}", [rng.choice(table)[0] for _ in range(3)], False) for i in range(9)], "_id string, chunks array<string>, deleted boolean")
    plan = integrity.repair_plan(integrity.chunk_presence(owners, local, remote))
    done = integrity.apply_repair(plan, local, remote)
    after = integrity.chunk_presence(owners, done.local_chunks, done.remote_chunks)
    assert after.filter("in_local <> in_remote").count() == 0


def test_diffable_text_boundary(spark):
    rows = [(0, b"plain"), (1, b"a\x00b"), (2, b"x" * 8191 + "é".encode()), (3, b"x" * 8190 + "é".encode()), (4, b"\xff")]
    df = spark.createDataFrame(rows, "i int, content binary").select("i", is_diffable_text("content").alias("ok"))
    assert {r["i"]: r["ok"] for r in df.collect()} == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_lcs_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.randrange(4) for _ in range(rng.randrange(12))]
        y = [rng.randrange(4) for _ in range(rng.randrange(12))]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(np.array(x), np.array(y)) == t[-1][-1]


def test_salted_join_equals_plain_join(spark):
    many = spark.range(600).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    one = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(many, one, "k", ["id"], how, hot_rows=40).collect()))
        assert a == sorted(map(str, many.join(one, "k", how).collect()))


def test_previous_row_equals_lag(spark):
    from pyspark.sql.window import Window

    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).alias("t"), "id")
    got = previous_row(df, ["k"], ["t", "id"], {"id": "p"}, slices=9)
    want = df.withColumn("p", F.lag("id").over(Window.partitionBy("k").orderBy("t", "id")))
    assert sorted(map(str, got.select("k", "t", "id", "p").collect())) == sorted(map(str, want.select("k", "t", "id", "p").collect()))


def test_newest_cut_keeps_exactly_n(spark):
    df = spark.range(1000).select((F.col("id") % 13 * 1000).alias("t"), "id")
    want = sorted(((r["t"], r["id"]) for r in df.collect()), reverse=True)
    for n in (1, 76, 77, 500, 999):
        got = df.filter(newest_cut(df, ["t", "id"], n, fanout=8)).collect()
        assert sorted(((r["t"], r["id"]) for r in got), reverse=True) == want[:n]
    assert newest_cut(df, ["t", "id"], 1000) is None


def test_read_disk(spark, tmp_path):
    from tidemark.sources.scan import read_disk

    want = {
        "a b/c+d é.md": b"hello", "e.md": b"", ".config/x": b"hidden", "_y": b"under", ".config/deep/_z/w.md": b"w",
        "k=1/_x=2.md": b"named", "empty/.keep": b"", "a b/t.tmp": b"tmp",
    }
    for name, body in want.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "a b" / ".c+d é.md.crc").write_bytes(b"checksum")
    (tmp_path / "no files here").mkdir()

    def found(**options):
        rows = read_disk(spark, str(tmp_path), **options).collect()
        assert len(rows) == len({r["path"] for r in rows})
        return {r["path"]: (r["size"], bytes(r["content"])) for r in rows}

    assert found() == {n: (len(b), b) for n, b in want.items()}
    assert set(found(path_glob="*.md")) == {n for n in want if n.endswith(".md")}
    # Names and sizes come without opening a file.
    plan = read_disk(spark, str(tmp_path)).select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan and "ArrowEvalPython" not in plan


def test_read_disk_strips_only_the_root(spark, tmp_path):
    from tidemark.sources.scan import read_disk

    root = tmp_path / "vault"
    deep = root / "n" / str(root).lstrip("/")
    deep.mkdir(parents=True)
    (deep / "a b+c%20é.md").write_text("x")
    (root / "top.md").write_text("yy")
    for given in (str(root), f"{root}/", f"file:{root}"):
        rows = {r["path"]: r["size"] for r in read_disk(spark, given).collect()}
        assert rows == {"top.md": 2, f"n/{str(root).lstrip('/')}/a b+c%20é.md": 1}


def test_scope_patterns_follow_the_engine_that_runs_them(spark):
    from tidemark.functions import ids

    assert ids.valid_regex(r"(?<y>\d+)\p{L}+") == r"(?<y>\d+)\p{L}+"
    assert ids.valid_regex(r"(?P<y>\d)") is None and ids.valid_regex("(") is None and ids.valid_regex("") is None
    assert ids.end_of_text(r"a$|[$]\$b$") == r"a\z|[$]\$b\z"


def test_missing_chunks_by_bytes_column(spark):
    from tidemark.operators.integrity import missing_chunks

    files = spark.createDataFrame([("file:a", ["c1", "c2", "c3"], False)], "_id string, chunks array<string>, deleted boolean")
    stored = spark.createDataFrame([("c1", 3), ("c2", None)], "_id string, bytes long")
    assert [(r["_id"], r["missing"]) for r in missing_chunks(files, stored).collect()] == [("file:a", ["c2", "c3"])]


def test_error_kinds_by_name(spark):
    from tidemark.operators.logs import classify_errors

    rows = [(None, "gone", "AbortError", None), (500, "x", "EncryptionError", False), (None, "x", "EncryptionError", True), (404, "x", None, None)]
    table = spark.createDataFrame(rows, "status int, message string, name string, retriable boolean")
    assert [r["error_kind"] for r in classify_errors(table).collect()] == ["aborted", "schema-mismatch", "unknown", "not-found"]


def test_every_plan_takes_the_stores_hash(spark):
    from tidemark.functions import content
    from tidemark.operators.config import config_scan  # noqa: F401 (takes alg as well)
    from tidemark.plans import reconcile
    from tidemark.schemas import BASELINES, FILE_DOCS

    bodies = {f"n/{i}.md": (b"x" * (1000 * i) + bytes([i])) for i in range(4)} | {"n/empty.md": b""}
    disk = spark.createDataFrame(
        [(p, 5, len(b), bytearray(b)) for p, b in bodies.items()], "path string, mtime bigint, size bigint, content binary"
    )
    told = {r["path"]: r["c"] for r in disk.select("path", content.chunk_list("content", 512, "x64").alias("c")).collect()}
    pieces = {r["path"]: r["chunks"] for r in chunking.file_fingerprints(disk.select("path", "content"), 512, "x64").collect()}
    assert told == pieces and all(c.startswith("chunk:x64:") for cs in told.values() for c in cs)
    docs = spark.createDataFrame(
        [(f"file:{p}", 2, told[p], 9, 9, len(b), False, {"dev-a": 1}, 1, 1) for p, b in bodies.items()], FILE_DOCS
    )
    known = spark.createDataFrame([(p, {"dev-a": 1}, told[p], len(b), 4, False) for p, b in bodies.items()], BASELINES)
    actions = lambda alg: {r["action"] for r in reconcile.reconcile_plan(
        disk, docs, known, None, "dev-a", chunk_bytes=512, alg=alg).collect()}
    assert actions("x64") == {"align"} and "align" not in actions("s256")
    edited = lambda alg: {r["unpushed"] for r in reconcile.has_unpushed(disk, docs, known, None, 512, alg).collect()}
    assert edited("x64") == {False} and edited("s256") == {True}
