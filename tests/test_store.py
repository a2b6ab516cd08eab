"""The durable store: whole batches, replays, removals."""

from pyspark.sql import functions as F

from tidemark.schemas import FILE_DOCS
from tidemark.sources.store import DocStore


def docs(spark, *rows):
    """(id, value of the clock)"""
    return spark.createDataFrame([(i, 2, ["c"], 1, 1, 1, False, {"x": n}, 1, 1) for i, n in rows], FILE_DOCS)


def chunks(spark, *names):
    return spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "_id string, content binary")


def state(store):
    return (
        sorted((r["_id"], r["vclock"]["x"], r["_version"]) for r in store.docs().collect()),
        sorted(r["_id"] for r in store.chunks().collect()),
    )


def test_batches(spark, tmp_path):
    store = DocStore(spark, str(tmp_path))
    assert store.last() is None
    store.start(docs(spark, ("a", 1), ("b", 1)), chunks(spark, "c1", "c2"))
    store.start(docs(spark, ("z", 1)), chunks(spark))
    assert state(store) == ([("a", 1, 1), ("b", 1, 1)], ["c1", "c2"])
    expect = lambda df, n: df.withColumn("expected_vclock", F.create_map(F.lit("x"), F.lit(n).cast("long")))
    # A stored clock differs from the expected one: nothing of the batch is kept.
    found = store.apply(1, expect(docs(spark, ("a", 5)), 4), chunks(spark, "c9"))
    assert [r["_id"] for r in found.collect()] == ["a"] and store.last() == 0
    assert state(store) == ([("a", 1, 1), ("b", 1, 1)], ["c1", "c2"])
    gone = spark.createDataFrame([("b",), ("c2",)], "_id string")
    for _ in range(2):
        assert store.apply(1, expect(docs(spark, ("a", 5)), 1), chunks(spark, "c1", "c3"), gone).isEmpty()
        assert state(store) == ([("a", 5, 2)], ["c1", "c3"])
    # Removed things can come back, and a part without its commit row is not seen.
    fresh = docs(spark, ("b", 7)).withColumn("expected_vclock", F.lit(None).cast("map<string,bigint>"))
    store.apply(2, fresh, chunks(spark, "c2"))
    store.docs().limit(0).write.parquet(f"{tmp_path}/docs/gen=0/part=9")
    assert state(store) == ([("a", 5, 2), ("b", 7, 1)], ["c1", "c2", "c3"])
    # Folded parts are the same store; older generations go.
    for _ in range(3):
        store.compact()
        assert state(store) == ([("a", 5, 2), ("b", 7, 1)], ["c1", "c2", "c3"]) and store.last() == 2
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == ["gen=2", "gen=3"]
    store.apply(3, fresh.withColumn("_id", F.lit("d")), chunks(spark, "c1", "c9"), gone)
    assert state(store) == ([("a", 5, 2), ("d", 7, 1)], ["c1", "c3", "c9"])


def test_a_batch_opens_only_its_buckets(spark, tmp_path):
    store = DocStore(spark, str(tmp_path), buckets=16)
    store.start(docs(spark, *[(f"d{i}", 1) for i in range(300)]), chunks(spark, *[f"c{i}" for i in range(300)]))
    named = spark.createDataFrame([("d7",)], "_id string")
    assert len({f.rsplit("/", 2)[1] for f in store.docs(named).inputFiles()}) == 1
    asked = spark.createDataFrame([("c7",)], "_id string")
    assert len({f.rsplit("/", 2)[1] for f in store.chunks(asked).inputFiles()}) == 1
    edit = docs(spark, ("d7", 2)).withColumn("expected_vclock", F.lit(None).cast("map<string,bigint>"))
    assert store.apply(1, edit, chunks(spark, "c7", "new")).isEmpty()
    head = store.commits()[-1]
    assert len(head["docs"]) == 1 and len(head["chunks"]) == 1 and head["buckets"] == 16
    docs_now, chunks_now = state(store)
    assert len(docs_now) == 300 and ("d7", 2, 2) in docs_now and sorted([*[f"c{i}" for i in range(300)], "new"]) == chunks_now
    store.buckets = 4
    store.compact()
    assert state(store) == (docs_now, chunks_now) and store.commits()[-1]["buckets"] == 4
