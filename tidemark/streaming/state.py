"""State of a continuous pull: docs in hash buckets, each in one committed version."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ids
from tidemark.plans.pull import (
    config_pull_plan, only_ids, pending_apply_rows, pending_apply_step, pending_conflicts_review, pull_plan,
)
from tidemark.schemas import CLOCK, CONFIG_SCHEMA_VERSION, FILE_SCHEMA_VERSION, IDS
from tidemark.session import cut_lineage

DOCS = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("vclock", CLOCK),
        T.StructField("chunks", IDS),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)
# Retry rows carry what their next try looks at, so that no bucket is opened for them.
PENDING = (
    T.StructType().add("id", "string").add("reason", "string").add("attempts", "integer")
    .add("chunks", IDS).add("deleted", "boolean")
)
CONFLICT = T.StructType().add("id", "string").add("kind", "string").add("doc", DOCS)
COMMITS = T.StructType(
    [
        T.StructField("no", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("last_seq", T.LongType()),
        T.StructField("versions", T.ArrayType(T.LongType())),
        T.StructField("epoch", T.LongType()),
        T.StructField("until", T.LongType()),
        T.StructField("committed_at", T.LongType()),
    ]
)
EMPTY = -1  # version of a bucket that never held a doc
BUCKET_DOCS = 50_000
MAX_BUCKETS = 100_000
START = -1  # batch id of the seed


class SchemaMismatch(RuntimeError):
    """A change carries a document of a schema version this code does not know."""


def _wrong_version(changes: DataFrame) -> Column:
    """The id of a file or settings doc of another schema version, else NULL."""
    doc = changes.schema["doc"].dataType if "doc" in changes.columns else None
    if doc is None or "schema_version" not in doc.names:
        return F.lit(None).cast("string")
    version = F.when(ids.is_config("id"), CONFIG_SCHEMA_VERSION).when(ids.is_file("id"), FILE_SCHEMA_VERSION)
    wrong = (
        F.col("doc").isNotNull() & ~F.col("deleted") & version.isNotNull()
        & ~F.col("doc.schema_version").eqNullSafe(version)
    )
    return F.when(wrong, F.col("id"))


def check_schema(changes: DataFrame) -> None:
    """Raises :class:`SchemaMismatch` on a wrong version among file and settings docs."""
    _refuse(changes.agg(F.min(_wrong_version(changes))).first()[0])


def _refuse(wrong: str | None) -> None:
    if wrong is not None:
        raise SchemaMismatch(f"unknown schema version of {wrong}")


def check_sequence(last_seq: int, cursor: int, feed: str, resets: int = 0) -> str:
    """``ok``, or ``reset`` (settings feed, once); otherwise the feed fails."""
    if last_seq >= cursor:
        return "ok"
    if feed == "config" and resets == 0:
        return "reset"
    raise RuntimeError(f"{feed} feed ran backwards: {last_seq} after {cursor}")


class FeedReset(RuntimeError):
    """The remote was recreated: its feed is to be read from the start."""


class Committed:
    """Versions of a job's tables in a folder, of which the newest commit row names the valid ones."""

    COMMITS: T.StructType

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def commits(self) -> DataFrame:
        """The newest commits; an empty table before the first."""
        try:
            reader = self.spark.read.schema(self.COMMITS).option("recursiveFileLookup", "true")
            return reader.parquet(f"{self.folder}/commits")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.COMMITS)
            raise

    def head(self):
        """Newest commit, or None."""
        return self.commits().orderBy(F.desc("no")).first()

    def _committed(self, row: DataFrame, no: int) -> list:
        """Writes a commit row; returns the ones before, oldest first."""
        before = sorted(self.commits().collect(), key=lambda r: r["no"])
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/no={no}")
        return [r for r in before if r["no"] < no]

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class PullState(Committed):
    """Docs, retry rows and cursor of a continuous pull, visible together.

    Docs lie in buckets of a hash of their id.  A batch reads the buckets of the ids it
    names, writes those of the docs it accepts anew, and commits one row with the version
    of every bucket; buckets it does not touch are neither read nor written.  Readers follow
    the newest commit, so a batch is seen whole or not at all, and a replayed batch id is a
    no-op.  The commit before stays readable; what only older ones hold is deleted.  The
    driver sees bucket numbers and versions (at most ``MAX_BUCKETS``), never ids.
    """

    COMMITS = COMMITS

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        super().__init__(spark, folder)
        self.buckets = buckets

    def epoch(self) -> int:
        """How often the feed was started anew."""
        top = self.head()
        return 0 if top is None else top["epoch"]

    def _commit(
        self, no: int, batch_id: int, last_seq: int, versions: list[int], epoch: int = 0, until: int = 0
    ) -> None:
        row = self.spark.range(1).select(
            F.lit(no).cast("bigint").alias("no"), F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.lit(last_seq).cast("bigint").alias("last_seq"),
            F.split(F.lit(",".join(map(str, versions))), ",").cast("array<bigint>").alias("versions"),
            F.lit(epoch).cast("bigint").alias("epoch"), F.lit(until).cast("bigint").alias("until"),
            F.unix_millis(F.current_timestamp()).alias("committed_at"),
        )
        kept = self._committed(row, no)
        if len(kept) > 1:
            self._forget(kept[:-1], [kept[-1]["versions"], versions])

    def _forget(self, old: list, live: list[list[int]]) -> None:
        """Deletes what the commits ``old`` hold and no live one does."""
        used = {(len(v), b, n) for v in live for b, n in enumerate(v)}
        numbers = {n for v in live for n in v}
        for commit in old:
            mine = commit["versions"]
            for n in set(mine) - numbers:
                self._remove(f"docs/v={n}")
            for b, n in enumerate(mine):
                if n in numbers and (len(mine), b, n) not in used:
                    self._remove(f"docs/v={n}/bucket={b}")
            for name in (f"pending/v={commit['no']}", f"conflicts/v={commit['no']}", f"commits/no={commit['no']}"):
                self._remove(name)

    @staticmethod
    def _bucket(key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write_docs(self, rows: DataFrame, no: int, buckets: int) -> list[int]:
        """Writes whole buckets as version ``no``; returns their numbers."""
        path = f"{self.folder}/docs/v={no}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in DOCS], self._bucket("_id", buckets).alias("bucket"))
        placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        # Footers and folder names only.
        written = self.spark.read.schema(T.StructType().add("bucket", "integer")).parquet(path)
        return [r[0] for r in written.distinct().collect()]

    def _read_docs(self, versions: list[int], buckets: Iterable[int]) -> DataFrame:
        paths = [f"{self.folder}/docs/v={versions[b]}/bucket={b}" for b in buckets if versions[b] != EMPTY]
        return self.spark.read.schema(DOCS).parquet(*paths) if paths else self.spark.createDataFrame([], DOCS)

    def _buckets_for(self, rows: int) -> int:
        return self.buckets or max(1, min(MAX_BUCKETS, rows // BUCKET_DOCS))

    def _layout(self, docs: DataFrame, no: int, buckets: int) -> list[int]:
        versions = [EMPTY] * buckets
        for b in self._write_docs(docs, no, buckets):
            versions[b] = no
        return versions

    def start(self, docs: DataFrame, last_seq: int = 0) -> None:
        """Seed an empty state with the docs held so far; no-op when seeded."""
        if self.head() is not None:
            return
        docs = cut_lineage(docs.select([F.col(f.name).cast(f.dataType) for f in DOCS]))
        self._commit(0, START, last_seq, self._layout(docs, 0, self._buckets_for(docs.count())))

    def docs(self, wanted: DataFrame | None = None) -> DataFrame:
        """Current docs; of ``wanted`` ids only their buckets are opened."""
        top = self.head()
        if top is None:
            return self.spark.createDataFrame([], DOCS)
        n = len(top["versions"])
        if wanted is None:
            return self._read_docs(top["versions"], range(n))
        named = [r[0] for r in wanted.select(self._bucket("_id", n)).distinct().collect()]
        return only_ids(self._read_docs(top["versions"], named), wanted)

    def _rows(self, name: str, schema: T.StructType, top) -> DataFrame:
        if top is None or top["no"] == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v={top['no']}")

    def pending_apply(self) -> DataFrame:
        return self._rows("pending", PENDING, self.head()).select("id", "reason", "attempts")

    def pending_conflict(self) -> DataFrame:
        return self._rows("conflicts", CONFLICT, self.head()).select("id", "kind")

    def _retried(self, before: DataFrame, plan: DataFrame, accepted: DataFrame, chunks: DataFrame) -> DataFrame:
        """The apply set after this batch: its own rows, one more try of the others, and
        rows of changed ids whose new version was not taken."""
        taken = accepted.select(F.col("_id").alias("id"), "chunks", "deleted")
        own = pending_apply_rows(plan, chunks).join(taken, "id")
        if before.isEmpty():
            return own
        touched = plan.select(F.col("_id").alias("id"))
        others = before.join(touched, "id", "left_anti")
        docs = others.select(F.col("id").alias("_id"), "chunks", "deleted")
        again = pending_apply_step(others.select("id", "reason", "attempts"), docs, chunks)
        tried = again.filter("outcome = 'retry'").drop("outcome").join(others.select("id", "chunks", "deleted"), "id")
        held = before.join(touched, "id", "left_semi").join(taken.select("id"), "id", "left_anti")
        return own.unionByName(tried).unionByName(held)

    def _reviewed(self, before: DataFrame, plan: DataFrame, local: DataFrame, remote: DataFrame | None) -> DataFrame:
        """The conflict set after this batch; a changed id is judged anew."""
        mine = local.select(F.col("_id").alias("id"), F.struct(*DOCS.names).alias("doc"))
        found = plan.filter(F.col("pending_kind").isNotNull()).select(
            F.col("_id").alias("id"), F.col("pending_kind").alias("kind")
        ).join(mine, "id", "left").select("id", "kind", "doc")
        if before.isEmpty():
            return found
        others = before.join(plan.select(F.col("_id").alias("id")), "id", "left_anti")
        if remote is not None:
            seen = others.filter("doc is not null").select("doc.*")
            dropped = pending_conflicts_review(others.select("id", "kind"), seen, remote).filter("decision = 'drop'")
            others = others.join(dropped.select("id"), "id", "left_anti")
        return found.unionByName(others.select("id", "kind", "doc"))

    def apply(
        self,
        changes: DataFrame,
        batch_id: int,
        unpushed_ids: DataFrame,
        chunks: DataFrame,
        remote: DataFrame | None = None,
        feed: str | None = None,
    ) -> bool:
        """Plan and commit one batch of changes; False when it was done before.

        A file or settings doc of another schema version, or with ``feed`` a sequence that
        ran backwards, stops the batch before anything is written.  Both retry sets are
        worked through: what this batch makes complete or moot leaves them.
        """
        def planned(local: DataFrame, top) -> DataFrame:
            return pull_plan(changes, local, unpushed_ids)

        return self._applied(changes, batch_id, planned, feed, chunks, remote)

    def apply_config(self, changes: DataFrame, batch_id: int) -> bool:
        """As :meth:`apply` for a settings feed, whose docs have no retry sets.

        The first sequence that runs backwards commits a new epoch and raises
        :class:`FeedReset`; a second one fails.
        """
        def planned(local: DataFrame, top) -> DataFrame:
            return config_pull_plan(changes, local, recreate=top["last_seq"] < top["until"])

        return self._applied(changes, batch_id, planned, "config")

    def _applied(
        self, changes: DataFrame, batch_id: int, planned: Callable, feed: str | None,
        chunks: DataFrame | None = None, remote: DataFrame | None = None,
    ) -> bool:
        top = self.head()
        if top is None:
            self.start(self.spark.createDataFrame([], DOCS))
            top = self.head()
        n = len(top["versions"])
        told = changes.agg(
            F.min(_wrong_version(changes)).alias("wrong"), F.max("seq").alias("newest"),
            F.collect_set(self._bucket("id", n)).alias("buckets"),
        ).first()
        _refuse(told["wrong"])
        if batch_id <= top["batch_id"]:
            return False
        versions, no, epoch, until = list(top["versions"]), top["no"] + 1, top["epoch"], top["until"]
        if feed is not None and told["newest"] is not None and top["batch_id"] > START:
            if check_sequence(told["newest"], top["last_seq"], feed, epoch) == "reset":
                for name, schema in (("pending", PENDING), ("conflicts", CONFLICT)):
                    self._rows(name, schema, top).write.mode("overwrite").parquet(f"{self.folder}/{name}/v={no}")
                self._commit(no, START, 0, versions, epoch + 1, told["newest"])
                raise FeedReset(f"{told['newest']} after {top['last_seq']}")
        local = self._read_docs(versions, told["buckets"])
        named = only_ids(local, changes.select(F.col("id").alias("_id")))
        plan = cut_lineage(planned(named, top))
        taken = F.when(F.col("accepted"), self._bucket("_id", n))
        written = plan.agg(F.collect_set(taken)).first()[0]
        fields = [F.col(f.name) if f.name in plan.columns else F.lit(None).alias(f.name) for f in DOCS]
        accepted = plan.filter("accepted").select(*fields).select([F.col(f.name).cast(f.dataType) for f in DOCS])
        if written:
            kept = self._read_docs(versions, written).join(accepted.select("_id"), "_id", "left_anti")
            self._write_docs(kept.unionByName(accepted), no, n)
            for b in written:
                versions[b] = no
        pending, conflicts = self._rows("pending", PENDING, top), self._rows("conflicts", CONFLICT, top)
        if chunks is not None:
            pending = self._retried(pending, plan, accepted, chunks)
            conflicts = self._reviewed(conflicts, plan, named, remote)
        pending.write.mode("overwrite").parquet(f"{self.folder}/pending/v={no}")
        conflicts.write.mode("overwrite").parquet(f"{self.folder}/conflicts/v={no}")
        # A batch of nothing but removed rows moves the cursor as well.
        last = max(top["last_seq"], told["newest"] or 0)
        self._commit(no, batch_id, last, versions, epoch, until)
        return True

    def compact(self) -> None:
        """Lays the docs out anew where they have outgrown their buckets twice."""
        top = self.head()
        if top is None:
            return
        docs = self.docs()
        buckets = self._buckets_for(docs.count())
        if buckets < 2 * len(top["versions"]):
            return
        no = top["no"] + 1
        for name, schema in (("pending", PENDING), ("conflicts", CONFLICT)):
            self._rows(name, schema, top).write.mode("overwrite").parquet(f"{self.folder}/{name}/v={no}")
        self._commit(no, top["batch_id"], top["last_seq"], self._layout(docs, no, buckets), top["epoch"], top["until"])
