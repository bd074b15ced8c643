"""The run log as a stream: states, counts, sessions, de-duplicated transitions.

Late rows: the watermark trails the newest event by ``LATENESS``; what arrives later is
dropped by Spark and counted in the query's progress.  All queries read what is there and end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.runlog import parse_line, stamped_state, stamped_time, state_stamp
from runloom.session import scratch_path

LATENESS = "10 minutes"

#: State on executors' disks instead of the heap; partial session merges before the shuffle.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def _conf(spark: SparkSession, settings: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Drained(NamedTuple):
    """What a stream gave: its rows, how many rows it read, how many of its state rows came too late, how many rows of state it had at
    the end of each of its last batches, and the folder with its state.

    Late rows are counted by Spark where state is kept, after rows of one key in one task have been combined.
    """

    rows: DataFrame
    n_read: int
    n_late: int
    state_rows: list[int]
    checkpoint: str


class _Progress:
    """Sums over the progress of a query, taken from its recent reports often enough to miss none."""

    RECENT = 100

    def __init__(self):
        self.query: StreamingQuery | None = None
        self.last = -1
        self.n_read = self.n_late = 0
        self.state_rows: deque[int] = deque(maxlen=self.RECENT)

    def take(self) -> None:
        for p in self.query.recentProgress if self.query else []:
            if p["batchId"] > self.last:
                self.last = p["batchId"]
                self.n_read += p["numInputRows"]
                self.n_late += sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
                self.state_rows.append(sum(o["numRowsTotal"] for o in p["stateOperators"]))


def drain(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """The rows of :func:`run_to_end`."""
    return run_to_end(stream, label, mode).rows


def run_to_end(stream: DataFrame, label: str, mode: str) -> Drained:
    """Run a stream over everything available; the rows of each micro-batch, with ``batch_id``.

    Batches are tables in the shared folder.  A batch that is replayed overwrites itself, so
    each row counts once.  The number of state partitions follows the cores of the cluster.  A source without any file is an error.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    seen: set[bool] = set()
    progress = _Progress()

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        seen.add(True)
        if batch_id % (progress.RECENT // 4) == 0:
            progress.take()

    settings = {
        **STATE_CONF, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.numRecentProgressUpdates": str(progress.RECENT),
    }
    with _conf(spark, settings):
        progress.query = query = (
            stream.writeStream.outputMode(mode).foreachBatch(store)
            .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    if not seen:
        raise ValueError(f"the source of {label} matched no file")
    progress.take()
    schema = stream.schema.add("batch_id", "long")
    rows = spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    return Drained(rows, progress.n_read, progress.n_late, list(progress.state_rows), f"{out}/state")


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Last row of each key over all micro-batches of an update-mode stream."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def final(batches: DataFrame) -> DataFrame:
    """Rows of the last micro-batch of a complete-mode stream."""
    last = batches.agg(F.max("batch_id")).scalar()
    return batches.where(F.col("batch_id") == last).drop("batch_id")


def parquet_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)  # a stream reads folders only


def task_states(events: DataFrame) -> DataFrame:
    """Latest state of every task (run_id, task, ts, state) in each hour of its activity: the newest time wins, at equal times
    the more severe state.  :func:`newest_states` reduces the batches.

    A built-in aggregate, combined before the shuffle, so one very busy task is no bottleneck.  An hour leaves the state when the
    watermark passes its end: what the task says later is newer, and what comes from before is too late to be read.
    """
    newest = F.max(state_stamp(F.col("ts"), F.col("state")))
    return events.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour"), "run_id", "task").agg(newest.alias("stamp")).select(
        "run_id", "task", stamped_state(F.col("stamp")).alias("state"), stamped_time(F.col("stamp")).alias("ts")
    )


def newest_states(batches: DataFrame) -> DataFrame:
    """The state of every task (run_id, task, state, ts) at the end of an update-mode stream of :func:`task_states`."""
    newest = batches.groupBy("run_id", "task").agg(F.max(state_stamp(F.col("ts"), F.col("state"))).alias("stamp"))
    return newest.select("run_id", "task", stamped_state(F.col("stamp")).alias("state"), stamped_time(F.col("stamp")).alias("ts"))


def run_counts(events: DataFrame, every: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per pool in tumbling (or sliding) windows."""
    return (
        events.withWatermark("ts", LATENESS).groupBy(F.window("ts", every, slide), "pool")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "pool", "n")
    )


def run_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Bursts of activity of each run, ended by a pause of ``gap``; in append mode once the watermark has passed
    their end.  Those still open are read by :func:`open_sessions`."""
    return (
        events.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap), "run_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("run_id", F.col("session_window.start").alias("session_start"),
                F.col("session_window.end").alias("session_end"), "n")
    )


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that an append-mode stream of :func:`run_sessions` still has open, with the columns of that stream."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        "value.run_id", F.col("value.session_window.start").alias("session_start"), F.col("value.session_window.end").alias("session_end"),
        F.col("value.count").alias("n"))


def distinct_transitions(events: DataFrame) -> DataFrame:
    """Each state of a task once per hour, however often it is reported.  The hour carries the
    watermark and is part of the key, so old keys leave the state.

    Streaming de-duplication has no partial step before its shuffle.  Repeats are therefore
    removed per source partition first, so that one transition reported by most of the rows is
    spread, and then once more over all.
    """
    key = ["run_id", "task", "state", "hour"]
    return (
        events.select("run_id", "task", "state", F.date_trunc("hour", "ts").alias("hour"),
                      F.pmod(F.spark_partition_id(), F.lit(64)).alias("_salt"))
        .withWatermark("hour", "70 minutes").dropDuplicates([*key, "_salt"])
        .select(*key).dropDuplicates(key)
    )


def log_tail(spark: SparkSession, path: str) -> DataFrame:
    """New lines of log files: (file, block, at, ts, logger, message, opens).

    A line that continues a record (a trace, a tag) has no time and logger of its own; ``file``, ``block`` and ``at`` give its place
    within one micro-batch of its file, from which the batch form (``fill_forward``) takes them over.
    """
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("at", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows

    lines = spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.mapInArrow(numbered, "file string, block long, value string, at long").withColumn("p", parse_line(F.col("value")))
    return lines.select(
        "file", "block", "at", F.col("p.ts").alias("ts"), F.col("p.logger").alias("logger"),
        F.coalesce("p.message", "value").alias("message"), F.col("p.message").isNotNull().alias("opens"))


def tail_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stateless stream to Parquet, exactly once."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


