"""The corpus pipeline: from raw documents to shuffled shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runloom.llm import contamination, language_id, mixing, shards, simhash_dedup
from runloom.llm.common import table
from runloom.session import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Those without a letter, and null texts, are rejected.  The model learns from labelled documents that are not held out; without any
    all documents with a letter stay.
    """
    learn = docs.select("doc_id", "text", "lang").where(~language_id.held_out(docs["doc_id"]))
    model = language_id.train(learn)
    found = language_id.predict(docs, model, "_")
    told = found["_lang_pred"] != language_id.UNKNOWN if model.languages else found["text"].rlike(r"\p{L}")
    return found.where(told).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row for each reading."""
    return mixing.mixed(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in random order with ``shard`` and ``slot``, one slot each."""
    return shards.shuffled(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stages use a trained model and fingerprints that SQL lacks; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
