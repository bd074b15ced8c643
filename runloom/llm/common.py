"""Helpers shared by the operators: reading tables, running totals, lists that stay small."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.session import stored

#: Rows of one list that meet in one task; longer lists are cut into blocks of about this size.
BLOCK_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Hand Python ``rows`` rows at a time in what is executed here: texts may be long, and Spark counts rows only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, out: str, label: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows that precede each row within its key.

    The rows are range-partitioned by key and order and written once, so that the number of a row's
    partition is a fact that no later retry can change.  Each partition sums its own rows; what came
    before it is one small row for each key and partition.  No key needs a task of its own.
    Nulls form a key of their own and come first in an order.  ``order`` should be total; rows that tie
    are put in an arbitrary order among themselves.
    """
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    kept, _ = stored(cut, label)
    sums = kept.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long")).alias("_carry"),
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = kept.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(carry, match, "left").select(*df.columns, (F.col("_own") + F.col("_carry")).alias(out))


def dealt(postings: DataFrame, keys: Sequence[str], row: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal the rows of inverted lists to cells, so that any two rows of a list meet in one cell.

    A list of up to ``block_rows`` rows is one cell.  A longer one is cut into blocks by a hash of ``row``
    and each pair of blocks is a cell; every row carries its block ``_own`` and its cell ``_lo``, ``_hi``.
    In a cell of two blocks only rows of different blocks are to be compared: the others have met.
    The result is partitioned and sorted by cell.
    """
    long = (
        postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
        .select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    )
    blocks = F.coalesce("_blocks", F.lit(1))
    placed = postings.join(long, list(keys), "left").withColumn(
        "_own", F.pmod(F.xxhash64(row), blocks).cast("int"))
    both = placed.withColumn(
        "_other", F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))))
    cell = both.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    cell = cell.drop("_blocks", "_other")
    return cell.repartition(*keys, "_lo", "_hi").sortWithinPartitions(*keys, "_lo", "_hi")


def cells(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Regroup sorted batches so that no cell spans two of them; with it the start of each cell."""
    held: list[pd.DataFrame] = []

    def starts(frame: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(frame), dtype=bool)
        for c in [*keys, "_lo", "_hi"]:
            column = frame[c].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        change[:1] = True
        return np.flatnonzero(change)

    for batch in batches:
        if not len(batch):
            continue
        frame = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
        at = starts(frame)
        if len(at) > 1:
            yield frame.iloc[: at[-1]], at[:-1]
        held = [frame.iloc[at[-1]:]]
    if held:
        yield held[0].reset_index(drop=True), np.zeros(1, dtype=np.int64)


def star_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest row number of each row's component, for links ``i``-``j`` among ``n`` rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of links ``a``-``b`` (longs): ``node`` and ``root``, its component's least node.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the least
    node near it, then every node ties its smaller neighbours to the least of them.  Rounds grow with the
    logarithm of the number of nodes, and each is written to the shared folder.  Only counts and
    checksums reach the driver.  Links may repeat or join a node to itself; nulls link nothing.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    check = [F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31)))]
    now, seen = stored(pairs, label, *check)
    while True:
        sides = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(lowest, "hi")
        small = met.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            lowest.select("hi", F.col("m").alias("lo"))).distinct()
        now, after = stored(small, label, *check)
        if after == seen:
            break
        seen = after
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
