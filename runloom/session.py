"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings the library expects on a cluster.  AQE re-plans joins on measured sizes and
#: splits skewed partitions; everything else is the Spark default.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(app: str = "runloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with :data:`RECOMMENDED` settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("runloom.shared.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="runloom-")
        spark.conf.set("runloom.shared.dir", root)
    return root


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/runloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never used before."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application; call it when every result that reads them is saved.

    Returns whether there were any.  Other applications that share the folder keep theirs.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and files.delete(folder, True)


def stored(df: DataFrame, label: str, *counts: Column) -> tuple[DataFrame, list[int]]:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and gives the planner
    the true size, so that it broadcasts what is small and shuffles what is not.  ``counts``
    are aggregates observed while writing; they cost no further job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    observed: list[int] = []
    if counts:
        watch = Observation()
        df = df.observe(watch, *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    df.write.parquet(path)
    if counts:
        seen = watch.get
        observed = [seen.get(f"c{i}") or 0 for i in range(len(counts))]
    return spark.read.schema(df.schema).parquet(path), observed
