"""Sharding by a two-pass external shuffle.

First pass: every record goes to one of many buckets by a seeded hash; the number of buckets follows the bytes, so
that a bucket fits in a task's memory.  Second pass: each bucket is put in a canonical order, shuffled by Fisher-Yates with
a generator seeded by its number, and written.  A bucket's records take the positions after those of all
earlier buckets, known from counts alone, and shards are equal runs of positions: their row counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runloom.session import scratch_path

SHARDS = 40
SEED = 17
#: Bytes of text in a bucket, about; and the bytes that each record counts on top of its text.
BUCKET_BYTES = 4 << 20
RECORD_BYTES = 16
LAW = "rows"


def size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long")


def _bucket(buckets: int, seed: int) -> Column:
    # the text is part of the hash, so that rows that share an id spread as well
    return F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)), F.lit(buckets)).cast("int")


def shuffled(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (int, long), in random order within and among the shards.

    Positions depend on the rows, ``shards``, ``bucket_bytes`` and ``seed`` only.  Rows that are equal in id and text are
    ordered by nothing else and may swap.  Columns named shard or slot are replaced.  No rows give none.
    """
    docs = docs.drop("shard", "slot")
    all_rows = docs.agg(F.sum(size()).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows, buckets = max(all_rows["rows"], 1), max(1, -(-(all_rows["bytes"] or 0) // bucket_bytes))
    placed = docs.withColumn("_bucket", _bucket(buckets, seed)).withColumn("_hash", F.xxhash64("text"))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each bucket: the input's bytes over bucket_bytes
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_first"))

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("doc_id", "ascending"), ("_hash", "ascending")])
        order = np.arange(bucket.num_rows)
        np.random.default_rng([seed, bucket["_bucket"][0].as_py()]).shuffle(order)
        return bucket.take(pa.array(order)).append_column("_at", pa.array(np.arange(bucket.num_rows), pa.int64()))

    # the bucket's first position comes with the rows: a join after the groups would shuffle all texts once more
    placed = placed.join(first, "_bucket")
    mixed = placed.groupBy("_bucket").applyInArrow(
        fisher_yates, StructType([*placed.schema.fields, StructField("_at", LongType())]))
    # shard s holds the positions from ceil(s * rows / shards) on
    place = mixed.withColumn("_pos", F.col("_first") + F.col("_at")).withColumn("_shard", F.expr(f"_pos * {shards} div {rows}"))
    begin = F.expr(f"(_shard * {rows} + {shards - 1}) div {shards}")
    return place.select(
        *docs.columns, F.col("_shard").cast("int").alias("shard"), (F.col("_pos") - begin).alias("slot"))


def write(docs: DataFrame, path: str | None = None, shards: int = SHARDS) -> str:
    """Write the shuffled rows below ``path`` (a fresh shared folder if none), a folder for each shard."""
    path = path or scratch_path(docs.sparkSession, "shards")
    shuffled(docs, shards).write.partitionBy("shard").parquet(path)
    return path


def manifest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Write the shards, read them back and return ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    A null text counts 16 bytes and has crc32 0.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    path = write(narrow, None, shards)
    back = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    return back.select(
        "doc_id", size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
