"""Readers for matrices, logs, captured streams, configuration files and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.ordered import fill_forward, row_rank
from runloom.functions.text import strip, words
from runloom.operators.config import parse_config
from runloom.operators.matrix import split_line
from runloom.operators.runlog import capture_names, parse_line


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a position (block, at) that increases along each file.

    Files are split as usual: ``block`` is the offset of the split a line came from and ``at``
    counts the lines within it.  Partition columns of the folder are kept.
    """
    lines = spark.read.text(path)
    return lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def matrix_scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every matrix file under ``path``: (file, row_no, header, cells).

    The first line of a file is its header.  Lines are numbered first, and a line is a header because its number is
    the first: positions, which depend on how files were split, are never compared between two scans.
    """
    lines = read_lines(spark, path)
    numbered = row_rank(lines, ["file"], ["block", "at"], [F.col("block")], "row_no")
    headers = numbered.where("row_no = 1").select("file", split_line(F.col("value")).alias("header"))
    return numbered.where("row_no > 1").join(headers, "file").select(
        *[c for c in lines.columns if c not in ("value", "block", "at")], (F.col("row_no") - 1).alias("row_no"), "header",
        split_line(F.col("value")).alias("cells"))


def matrix_literal_scan(spark: SparkSession, path: str) -> DataFrame:
    """Argument vectors of header-less matrix files."""
    lines = read_lines(spark, path)
    return lines.withColumn("argv", words(F.col("value"))).drop("value")


def log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with time and logger.  Lines that continue a record (tags, traces) take both
    from the line that opened it; ``opens`` tells them apart."""
    lines = read_lines(spark, path)
    parsed = lines.withColumn("p", parse_line(F.col("value"))).select(
        *[c for c in lines.columns if c != "value"],
        F.col("p.ts").alias("ts"), F.col("p.logger").alias("logger"),
        F.coalesce("p.message", "value").alias("message"), F.col("p.message").isNotNull().alias("opens"),
    )
    filled = fill_forward(
        parsed, ["file"], ["block", "at"], [F.col("block")], ["ts", "logger"]
    )
    return filled


def capture_scan(spark: SparkSession, path: str) -> DataFrame:
    """Captured streams from files named ``<task>.<stream>``; empty files are dropped."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")
    )
    return capture_names(files)


def config_scan(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON configuration files; the configuration id is the file name.  A malformed file is
    ``{}`` with ``valid = false``, or fails the query if ``strict``."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("config_id"), F.col("value").alias("json")
    )
    return parse_config(files, strict)


def manifest_scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files that exist under ``path``, without reading them."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    )
