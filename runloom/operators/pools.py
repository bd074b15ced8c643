"""Resource pools: which pool a task goes to and how labels match the configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import memory_bytes


def pool_assignment(
    tasks: DataFrame, pools: DataFrame, defined: DataFrame, default_label: str | None = None
) -> DataFrame:
    """Pool of each task (run_id, task_id, executor, site).

    With at most one defined label or at most one configured pool everything goes to 'all'.
    Otherwise: the task's label (``executor``, else the older ``site``) if configured, else the
    default label if it is both defined and configured, else 'all'.
    """
    n_defined = defined.select("label").distinct().agg(F.count(F.lit(1))).scalar()
    n_pools = pools.agg(F.count(F.lit(1))).scalar()
    usable_default = (
        defined.where(F.col("label") == F.lit(default_label))
        .join(pools.select("label"), "label", "left_semi").agg(F.min("label")).scalar()
    )
    wanted = F.coalesce("executor", "site")
    known = pools.select(F.col("label").alias("found"))
    joined = tasks.withColumn("wanted", wanted).join(known, F.col("wanted") == F.col("found"), "left")
    return joined.select(
        "run_id", "task_id", "wanted",
        F.when((n_defined <= 1) | (n_pools <= 1), "all")
        .otherwise(F.coalesce("found", usable_default, F.lit("all"))).alias("assigned"),
    )


def pool_overlap(defined: DataFrame, pools: DataFrame) -> DataFrame:
    """Each label with the sides that know it."""
    left = defined.select("label").distinct().withColumn("in_pipeline", F.lit(True))
    right = pools.select("label").distinct().withColumn("in_config", F.lit(True))
    return left.join(right, "label", "full").select(
        "label", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_pipeline", "in_config")]
    )


def pool_match_report(defined: DataFrame, pools: DataFrame) -> DataFrame:
    """How the labels of the pipeline and of the configuration fit together, as one row."""
    p, c = F.col("in_pipeline"), F.col("in_config")
    counts = pool_overlap(defined, pools).agg(
        F.count_if(p & c).alias("n_both"), F.count_if(p & ~c).alias("n_only_pipeline"),
        F.count_if(~p & c).alias("n_only_config"),
    )
    single_p = F.col("n_both") + F.col("n_only_pipeline") <= 1
    single_c = F.col("n_both") + F.col("n_only_config") <= 1
    case = (
        F.when(single_p & single_c, "single/single").when(single_p, "single/multi").when(single_c, "multi/single")
        .when(F.col("n_both") == 0, "none")
        .when((F.col("n_only_pipeline") == 0) & (F.col("n_only_config") == 0), "perfect")
        .otherwise("some")
    )
    return counts.select("n_both", "n_only_pipeline", "n_only_config", case.alias("match"))


def resource_profiles(tasks: DataFrame, pools: DataFrame) -> DataFrame:
    """Distinct resource requests (cpu, memory) and the number of tasks of each.

    Tasks are counted per label before the join, which then has one row per label.
    """
    per_label = tasks.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    sized = pools.select(F.col("label").alias("pool"), F.col("cpu").cast("long").alias("cpu"), memory_bytes(F.col("mem")).alias("mem_bytes"))
    return per_label.join(sized, "pool", "left").groupBy("cpu", "mem_bytes").agg(F.sum("n").alias("n_tasks"))


def resource_rollup(tasks: DataFrame) -> DataFrame:
    """Tasks by pool and kind, with totals (null)."""
    return tasks.rollup("pool", "kind").agg(F.count(F.lit(1)).alias("n_tasks"))
