"""Packing by powers of two.

A document of n tokens is cut into ``n // SEQUENCE`` pieces of full length and one piece for each bit of the rest, longest first.
Each piece is a sequence by itself, so no sequence crosses documents, none is padded, and the sequences of one length form a
bucket from which batches of equal shape are read.  Documents are independent: one pass over the texts codes, cuts and
numbers them, and nothing is shuffled.

A packed table has the rows ``sequence_id, doc_id, start, length, doc_tokens, ids``; ``ids`` are little-endian unsigned integers of
two bytes, or four where the vocabulary needs them.  Sequence ids are unique and put the buckets one after the other, longest
first: four bits for the bucket, 24 for the task that wrote the piece, 35 for its number there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import piece_ids
from runloom.llm.common import small_batches
from runloom.session import scratch_path

SEQUENCE = 2048
END = 1
#: Tokens that a task hands on at once, about.
_TOKENS = 1 << 18
_TASK_BITS, _NUMBER_BITS = 24, 35


def lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """The lengths of the pieces of ``n`` tokens; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _width(path: str) -> str:
    return "<u2" if piece_ids.tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def packed(docs: DataFrame, path: str, longest: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row for each piece of ``docs`` under the tokenizer file ``path``; see the module.

    Null and empty texts have the end token alone.  Documents of any length are cut whole, with as many pieces as they need.
    Rows that share an id or a text, null ids among them, are documents of their own.  No rows give none; further columns
    of ``docs`` are ignored, whatever their names.
    """
    if longest & (longest - 1) or not 0 < longest <= 1 << 15:
        raise ValueError("the longest sequence is a power of two, at most 32768")
    width, top = _width(path), longest.bit_length() - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = piece_ids.of_file(path).of
        task = TaskContext.get().partitionId()
        number = [0] * (top + 1)
        rows: list[tuple] = []
        held = 0

        def handed() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["sequence_id", "doc_id", "start", "length", "doc_tokens", "ids"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(code(text) if isinstance(text, str) else np.zeros(0, dtype="<u4"), np.uint32(end)).astype(width)
                doc, start = None if pd.isna(doc) else int(doc), 0
                for size in lengths(len(ids), longest):
                    bucket = top - (size.bit_length() - 1)
                    sequence = (bucket << _TASK_BITS | task) << _NUMBER_BITS | number[bucket]
                    number[bucket] += 1
                    rows.append((sequence, doc, start, size, len(ids), ids[start:start + size].tobytes()))
                    start += size
                    held += size
                    if held >= _TOKENS:
                        yield handed()
                        rows, held = [], 0
        if rows:
            yield handed()

    return docs.select("doc_id", "text").mapInPandas(
        run, "sequence_id long, doc_id long, start long, length long, doc_tokens long, ids binary")


def write(docs: DataFrame, path: str, folder: str | None = None, longest: int = SEQUENCE) -> str:
    """Write the packed table below ``folder`` (a fresh shared one if none); returns it."""
    folder = folder or scratch_path(docs.sparkSession, "packed")
    with small_batches(docs.sparkSession):
        packed(docs, path, longest).write.parquet(folder)
    return folder


def buckets(pieces: DataFrame) -> DataFrame:
    """``length, n_sequences, first_sequence, last_sequence``: a bucket is a range of sequence ids."""
    return pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.min("sequence_id").alias("first_sequence"), F.max("sequence_id").alias("last_sequence"))


def digest(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """A written table with the crc32 of each piece's ids, as unsigned integers of four bytes, in place of the ids.

    A piece begins its sequence: ``offset`` is 0.
    """
    width = _width(path)

    @F.pandas_udf("long")
    def crc32(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(b, dtype=width).astype("<u4").data) for b in ids], dtype="int64")

    return spark.read.parquet(folder).select(
        "doc_id", "start", "length", crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
