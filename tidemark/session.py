"""Session helpers: where durable intermediate results may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local temporary folder is used only where the session names none *and*
    runs in local mode (tests); a cluster without the setting is an error,
    because executors could not read a machine-local path.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def work_dir(spark: SparkSession) -> str:
    """Where this application writes what it needs only while it runs."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; call it between jobs, when no
    DataFrame that still has to be read stands on them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Ends the growth of a plan that is used several times, survives executor
    loss, and gives Catalyst real sizes: a short table is broadcast by its
    measured size, a long one is shuffled.  :func:`clear` deletes such tables.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
