"""A durable document store: parts of Parquet in hash buckets, one commit row per batch."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import broadcast_if_small
from tidemark.sources.scan import apply_batch

COMMITS = (
    T.StructType().add("gen", "long").add("part", "long").add("seq", "long").add("base", "boolean")
    .add("buckets", "integer").add("docs", T.ArrayType(T.IntegerType())).add("chunks", T.ArrayType(T.IntegerType()))
    .add("schemas", T.MapType(T.StringType(), T.StringType()))
)
CONFLICT_ROWS = "_id string, stored string, expected string"
BUCKET_ROWS = 50_000
MAX_BUCKETS = 100_000
BUCKETED = ("docs", "chunks")  # by their ``_id``


class DocStore:
    """Docs and chunks of a folder, changed by atomic batches.

    A batch writes its own parts first and one commit row last; readers follow committed
    parts only, so a batch is seen whole or not at all, and a batch number that was
    committed before is a no-op.  A batch writes what it changes, not the store: docs it
    wrote or removed, and chunks that were absent.

    Parts lie in buckets of a hash of the id, and a commit row tells which buckets its part
    has.  A batch opens the buckets of the ids it names, of chunks the id column alone.
    :meth:`compact` folds all parts into one and fits the number of buckets to the store.
    A commit row also holds the largest ``_local_seq``, which the change feed reads on from.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def commits(self) -> list:
        """Commit rows of the current generation, oldest first; the first is its base."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").dropDuplicates(["gen", "part"])
            newest = rows.agg(F.max("gen")).first()[0]
            return rows.filter(F.col("gen") == newest).orderBy("part").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def last(self) -> int | None:
        """Number of the newest committed batch; None before the first."""
        rows = self.commits()
        return rows[-1]["part"] if rows else None

    def _path(self, gen: int, name: str, part: int) -> str:
        return f"{self.folder}/{name}/gen={gen}/part={part}"

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")

    def _commit(self, gen: int, part: int, seq: int, base: bool, buckets: int, tables: dict[str, DataFrame]) -> None:
        held, schemas = {}, {}
        for name, rows in tables.items():
            path = self._path(gen, name, part)
            schemas[name] = rows.schema.json()
            if name not in BUCKETED:
                rows.write.mode("overwrite").parquet(path)
                continue
            rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.partitionBy("bucket").mode(
                "overwrite").parquet(path)
            # Folder names and footers only.
            told = self.spark.read.schema("bucket int").parquet(path).distinct().collect()
            held[name] = sorted(r[0] for r in told)
        row = [(gen, part, seq, base, buckets, held["docs"], held["chunks"], schemas)]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def start(self, docs: DataFrame, chunks: DataFrame, **tables: DataFrame) -> None:
        """The first content; no-op when the store has any."""
        if self.commits():
            return
        alive = F.lit(False).alias("_gone")
        told = docs.agg(F.count(F.lit(1)), F.coalesce(F.max("_local_seq"), F.lit(0))).first()
        more = {name: rows.select("*", alive) for name, rows in tables.items()}
        first = {"docs": docs.select("*", alive), "chunks": chunks.select("_id", "content", alive)}
        self._commit(0, 0, told[1], True, self._buckets_for(max(told[0], chunks.count())), {**first, **more})

    def _buckets_for(self, rows: int) -> int:
        return self.buckets or max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))

    def _bucketed(self, name: str, commits: list, named: Iterable[int] | None = None) -> DataFrame:
        """Rows of the committed parts, of the buckets ``named`` where given, with ``part``."""
        only = None if named is None else set(named)
        paths = [
            f"{self._path(c['gen'], name, c['part'])}/bucket={b}"
            for c in commits for b in c[name] if only is None or b in only
        ]
        schema = T.StructType.fromJson(json.loads(commits[0]["schemas"][name])).add("part", "long")
        if not paths:
            return self.spark.createDataFrame([], schema)
        root = f"{self.folder}/{name}/gen={commits[0]['gen']}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths).drop("bucket")

    def _parts(self, name: str) -> DataFrame:
        commits = self.commits()
        if name in BUCKETED:
            return self._bucketed(name, commits)
        root = f"{self.folder}/{name}/gen={commits[0]['gen']}"
        rows = self.spark.read.option("basePath", root).parquet(root).withColumn("part", F.col("part").cast("long"))
        return rows.filter(F.col("part").isin([c["part"] for c in commits]) | (F.col("part") <= commits[0]["part"]))

    @staticmethod
    def _latest(rows: DataFrame, key: str) -> DataFrame:
        body = F.struct(*[c for c in rows.columns if c not in (key, "part")])
        latest = rows.groupBy(key).agg(F.max_by(body, "part").alias("d")).select(key, "d.*")
        return latest.filter(~F.col("_gone")).drop("_gone")

    @staticmethod
    def _present(rows: DataFrame) -> DataFrame:
        """Chunks put after their last removal; bodies meet a list of removals only."""
        gone = rows.filter("_gone").groupBy("_id").agg(F.max("part").alias("_last"))
        kept = rows.filter(~F.col("_gone")).join(broadcast_if_small(gone), "_id", "left")
        return kept.filter(F.col("_last").isNull() | (F.col("part") >= F.col("_last"))).select("_id", "content")

    def docs(self, wanted: DataFrame | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """Newest version of each doc that was not removed; of ``wanted`` ids only their buckets.

        With ``columns`` only these are read beside the id, and the rest of the docs stays shut.
        """
        def read(rows: DataFrame) -> DataFrame:
            return self._latest(rows if columns is None else rows.select("_id", *columns, "part", "_gone"), "_id")

        return self._of("docs", read, wanted)

    def chunks(self, wanted: DataFrame | None = None) -> DataFrame:
        return self._of("chunks", self._present, wanted)

    def _of(self, name: str, read, wanted: DataFrame | None) -> DataFrame:
        commits = self.commits()
        if wanted is None:
            return read(self._bucketed(name, commits))
        named = wanted.select(self._bucket(commits[0]["buckets"])).distinct().collect()
        rows = read(self._bucketed(name, commits, [r[0] for r in named]))
        return rows.join(broadcast_if_small(wanted.select("_id").distinct()), "_id", "left_semi")

    def table(self, name: str, key: str) -> DataFrame:
        """Newest row per key of a table that batches carry along."""
        return self._latest(self._parts(name), key)

    def written(self, name: str, part: int) -> DataFrame:
        """What one committed batch wrote to a table."""
        return self._parts(name).filter((F.col("part") == part) & ~F.col("_gone")).drop("_gone", "part")

    def apply(
        self, part: int, new_docs: DataFrame, new_chunks: DataFrame, deletes: DataFrame | None = None,
        tables: dict[str, DataFrame] | None = None,
    ) -> DataFrame:
        """Commits one batch (:func:`apply_batch`); returns its conflicts, and writes
        nothing where there are any.  ``tables`` are rows of other tables of the same
        commit, with ``_gone`` where a key is taken out."""
        commits = self.commits()
        head = commits[-1] if commits else None
        if head is not None and part <= head["part"]:
            return self.spark.createDataFrame([], CONFLICT_ROWS)
        ids = new_docs.select("_id") if deletes is None else new_docs.select("_id").unionAll(deletes.select("_id"))
        asked = new_chunks.select("_id") if deletes is None else new_chunks.select("_id").unionAll(deletes.select("_id"))
        before, stored = self.docs(ids), self.chunks(asked)
        done = apply_batch(before, stored, new_docs, new_chunks, deletes, head["seq"] + 1)
        if not done.conflicts.isEmpty():
            return done.conflicts
        written = done.docs.join(broadcast_if_small(new_docs.select("_id").distinct()), "_id", "left_semi")
        docs = written.select(*before.columns, F.lit(False).alias("_gone"))
        put = new_chunks.select("_id", "content").dropDuplicates(["_id"])
        kept = stored.select("_id")
        if deletes is not None:
            gone = deletes.select("_id").distinct()
            kept = kept.join(gone, "_id", "left_anti")
            docs = docs.unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        chunks = put.join(kept, "_id", "left_anti").withColumn("_gone", F.lit(False))
        if deletes is not None:
            named = gone.join(stored.select("_id"), "_id", "left_semi")
            chunks = chunks.unionByName(named.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        seq = head["seq"] if new_docs.isEmpty() else head["seq"] + 1
        self._commit(head["gen"], part, seq, False, head["buckets"], {"docs": docs, "chunks": chunks, **(tables or {})})
        return done.conflicts

    def compact(self, tables: Iterable[str] = ()) -> None:
        """Folds all parts into the base of a new generation, other ``tables`` as they are.

        The generation before stays for readers that hold it; older ones go.
        """
        commits = self.commits()
        gen, head = commits[-1]["gen"] + 1, commits[-1]
        alive = F.lit(False).alias("_gone")
        docs, chunks = self.docs(), self.chunks()
        buckets = self._buckets_for(max(docs.count(), self._bucketed("chunks", commits).count()))
        for name in tables:
            self._parts(name).write.partitionBy("part").mode("overwrite").parquet(f"{self.folder}/{name}/gen={gen}")
        self._commit(
            gen, head["part"], head["seq"], True, buckets,
            {"docs": docs.select("*", alive), "chunks": chunks.select("*", alive)},
        )
        for name in (*BUCKETED, *tables):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/gen={gen - 2}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
