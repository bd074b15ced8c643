"""Writers.  Rows are rebalanced on the partition columns first: AQE splits a value that owns
many rows over several files and packs small ones together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_sink(events: DataFrame, path: str) -> None:
    """Log records as Parquet by run and day."""
    dated = events.withColumn("run_date", F.to_date("ts"))
    dated.hint("rebalance", "run_name", "run_date").write.partitionBy("run_name", "run_date").mode("append").parquet(path)


def log_text_sink(lines: DataFrame, path: str, order: list[str]) -> None:
    """Log lines as text files by run, each in the given order."""
    (
        lines.hint("rebalance", "run_name").sortWithinPartitions("run_name", *order)
        .select("run_name", "line").write.partitionBy("run_name").mode("append").text(path)
    )


def matrix_text_sink(lines: DataFrame, path: str) -> None:
    """Matrix lines (matrix_id, row_id, line) as text, one file per matrix, header first."""
    (
        lines.repartition("matrix_id").sortWithinPartitions("matrix_id", "row_id")
        .select("matrix_id", "line").write.partitionBy("matrix_id").mode("append").text(path)
    )


def config_sink(configs: DataFrame, path: str, buckets: int = 16) -> None:
    """Configurations (config_id, json), one line each, by bucket of the id.  The document is nested as it is, not quoted as a text."""
    bucket = F.pmod(F.xxhash64("config_id"), F.lit(buckets)).cast("int")
    (
        configs.select(bucket.alias("bucket"), F.concat(
            F.lit('{"config_id":'), F.regexp_extract(F.to_json(F.struct("config_id")), r'^\{"config_id":(.*)\}$', 1), F.lit(',"config":'), "json", F.lit("}")
        ).alias("value"))
        .hint("rebalance", "bucket").write.partitionBy("bucket").mode("append").text(path)
    )


def graph_sink(elements: DataFrame, path: str) -> None:
    """Graph elements (run_id, element, json) as JSON lines by kind of element."""
    elements.select("element", F.col("json").alias("value")).hint("rebalance", "element").write.partitionBy(
        "element"
    ).mode("append").text(path)
