"""Keyed streams and the store's feed: several runs over growing inputs."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.schemas import CHANGES, FILE_DOCS
from tidemark.sources.feed import stream_changes
from tidemark.sources.store import DocStore
from tidemark.streaming import feeds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def drain(spark, tmp_path):
    """Runs a stream to its end and returns all rows it ever gave."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run(df):
        q = (
            df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check")
            .trigger(availableNow=True).start(f"{tmp_path}/rows")
        )
        q.awaitTermination()
        return sorted(map(tuple, spark.read.schema(df.schema).parquet(f"{tmp_path}/rows").collect()))

    return run


def feed(spark, tmp_path, name, schema):
    """A stream of the files written so far, and a function that adds rows."""

    def add(*rows):
        frame = spark.createDataFrame([(*r[:-1], float(r[-1])) for r in rows], schema + ", at double")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def read():
        rows = spark.readStream.schema(schema + ", at double").parquet(f"{tmp_path}/{name}")
        return rows.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).drop("at")

    return add, read


def test_stream_echoes(spark, tmp_path, drain):
    wrote, writes = feed(spark, tmp_path, "w", "id string, seq long")
    changed, changes = feed(spark, tmp_path, "c", "id string, seq long")
    run = lambda: drain(feeds.stream_suppress_echoes(changes(), writes(), ttl_ms=60_000))
    wrote(("x", 5, 10), ("y", 2, 10), ("late", 9, 10), ("gone", 9, 10))
    changed(("x", 5, 11), ("x", 6, 12), ("y", 1, 11), ("z", 1, 11))
    assert run() == [("x", 6), ("z", 1)]
    # The record of a seen id is gone; one that is not seen waits for its echo.
    changed(("y", 1, 30), ("late", 9, 31))
    wrote(("x", 7, 30))
    assert run() == [("x", 6), ("y", 1), ("z", 1)]
    # Both inputs have to be past the end of a record.
    changed(("q", 1, 200))
    run()
    changed(("gone", 8, 201), ("x", 7, 202))
    assert run() == [("q", 1), ("x", 6), ("y", 1), ("z", 1)]
    wrote(("p", 1, 203))
    run()
    wrote(("gone", 9, 204))
    changed(("x", 7, 205))
    assert ("x", 7) in run()


def test_stream_push_candidates(spark, tmp_path, drain):
    doc, docs = feed(spark, tmp_path, "d", "_id string, _local_seq long, _deleted boolean")
    wrote, writes = feed(spark, tmp_path, "w", "id string, seq long")
    queue, queued = feed(spark, tmp_path, "q", "id string, queued boolean")
    run = lambda: drain(feeds.stream_push_candidates(docs(), writes(), queued(), since=2, wait_ms=5000))
    doc(("file:old", 1, False, 1), ("file:new", 5, False, 1), ("file:echo", 6, False, 1), ("file:dead", 7, True, 1), ("meta:x", 8, False, 1))
    wrote(("file:echo", 6, 1))
    queue(("file:old", True, 1), ("file:new", True, 1), ("file:dead", True, 1), ("file:lost", True, 1), ("file:echo", True, 1),
          ("file:left", True, 1), ("file:left", False, 2))
    assert run() == [("file:new", "change")]
    later = [("file:echo", "retry"), ("file:dead", "zombie"), ("file:lost", "zombie"), ("file:old", "retry")]
    doc(("file:x", 1, False, 100))
    wrote(("file:x", 1, 100))
    queue(("file:x", False, 100))
    assert run() == sorted([("file:new", "change"), *later])
    # A failed try is queued anew; a zombie that is a doc again is a change.
    queue(("file:old", True, 101))
    doc(("file:lost", 9, False, 101))
    run()
    # A restarted query moves its watermark once every input has rows again.
    doc(("file:x", 1, False, 300))
    wrote(("file:x", 1, 300))
    queue(("file:x", False, 300))
    assert run() == sorted([("file:new", "change"), *later, ("file:lost", "change"), ("file:old", "retry")])


def config_doc(name, n):
    return (f"config:{name}", 3, [f"c{n}"], 1, 1, 1, False, {"x": n})


def test_settings_feed_starts_anew_once(spark, tmp_path):
    def put(folder, *rows):
        spark.createDataFrame([(d[0], seq, False, d) for seq, d in rows], CHANGES).write.mode("append").parquet(f"{tmp_path}/{folder}")

    def read(epoch):
        return spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/{'anew' if epoch else 'old'}")

    def held():
        return {r["_id"]: r["chunks"] for r in state.docs().collect()}

    state = feeds.PullState(spark, f"{tmp_path}/state")
    run = lambda: feeds.stream_config_pull(read, state, f"{tmp_path}/check")
    put("old", (7, config_doc("a", 1)), (8, config_doc("b", 1)))
    assert run() == 0 and held() == {"config:a": ["c1"], "config:b": ["c1"]}
    # A tie of clocks with other content: only a recreated remote has authority.
    other = ("config:a", 3, ["other"], 1, 1, 1, False, {"x": 1})
    put("anew", (1, other), (2, config_doc("c", 1)))
    put("old", (2, other))
    assert run() == 1
    assert held() == {"config:a": ["other"], "config:b": ["c1"], "config:c": ["c1"]}
    assert state.head()["last_seq"] == 2 and state.epoch() == 1
    # Behind the sequence of the reset the authority is over.
    put("anew", (3, ("config:c", 3, ["tie"], 1, 1, 1, False, {"x": 1})), (4, config_doc("d", 1)))
    assert run() == 1 and held()["config:c"] == ["c1"] and "config:d" in held()
    # Running backwards again fails, and nothing is taken.
    put("anew", (2, config_doc("e", 1)))
    with pytest.raises(StreamingQueryException, match="backwards"):
        run()
    assert "config:e" not in held() and state.epoch() == 1


def test_store_feed(spark, tmp_path, drain):
    def docs(*rows):
        return spark.createDataFrame([(i, 2, ["c"], 1, 1, 1, False, {"x": n}, 1, seq) for i, n, seq in rows], FILE_DOCS)

    def edit(*rows):
        return docs(*[(i, n, 0) for i, n in rows]).withColumn("expected_vclock", F.lit(None).cast("map<string,bigint>"))

    none = spark.createDataFrame([], "_id string, content binary")
    store = DocStore(spark, f"{tmp_path}/store")
    store.start(docs(("a", 1, 3), ("b", 1, 4), ("c", 1, 9)), none)
    run = lambda: drain(stream_changes(spark, f"{tmp_path}/store", 3).select("_id", F.col("vclock")["x"], "_local_seq"))
    first = [("b", 1, 4), ("c", 1, 9)]
    assert run() == first and run() == first
    store.apply(1, edit(("a", 2), ("d", 1)), none)
    store.apply(2, edit().limit(0), none, spark.createDataFrame([("b",)], "_id string"))
    store.apply(3, edit(("a", 3)), none)
    # A part without its commit row is not there.
    store.docs().withColumn("_gone", F.lit(False)).write.parquet(f"{tmp_path}/store/docs/gen=0/part=4")
    second = sorted([*first, ("a", 2, 10), ("d", 1, 10), ("a", 3, 11)])
    assert run() == second and run() == second
    # Folding the parts gives no row again; later ones go on.
    store.compact()
    assert run() == second
    store.apply(4, edit(("c", 5)), none)
    store.compact()
    assert run() == sorted([*second, ("c", 5, 12)])
