"""Order-dependent columns are those of plain windows, with null keys and null order values too."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.functions.ordered import fill_forward, next_value, row_rank, running_sum
from runloom.operators import runlog


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    data = [
        (rng.choice(["hot", "hot", None, f"k{i % 5}"]), rng.choice([None, *range(60)]), i, rng.choice([None, None, f"v{i}"]),
         rng.choice([None, *range(-5, 6)]))
        for i in range(400)
    ]
    return spark.createDataFrame(data, "k string, t int, i int, v string, d int").repartition(5).cache()


ORDER = ["t", "i"]


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_same_as_plain_window(table, width):
    slices = [F.floor(F.col("t") / width), F.floor(F.when(F.col("t").isNull(), F.col("i")) / width)]
    plain = Window.partitionBy("k").orderBy(*ORDER)
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    want = table.select(
        "i", F.row_number().over(plain).alias("rank"), F.sum("d").over(upto).alias("total"),
        F.last("v", ignorenulls=True).over(upto).alias("filled"), F.lead("v").over(plain).alias("next"),
    )
    ranked = row_rank(table, ["k"], ORDER, slices, "rank").select("i", "rank")
    summed = running_sum(table, ["k"], ORDER, slices, F.col("d"), "total").select("i", "total")
    filled = fill_forward(table, ["k"], ORDER, slices, ["v"]).select("i", F.col("v").alias("filled"))
    following = next_value(table, ["k"], ORDER, slices, "v", "next").select("i", "next")
    got = ranked.join(summed, "i").join(filled, "i").join(following, "i")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_launch_order_with_missing_times(spark):
    """Two staged rows without a time, a million lines apart."""
    rows = [(1, "a", None, 1, "running"), (1, "b", None, 1_000_001, "running"), (1, "c", datetime(2024, 1, 1), 5, "running")]
    events = spark.createDataFrame(rows, "run_id long, task string, ts timestamp_ntz, line_no long, state string")
    assert {(r.task, r.staged_pos) for r in runlog.launch_rank(events).collect()} == {("a", 1), ("b", 2), ("c", 3)}
