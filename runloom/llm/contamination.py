"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Only shingles that occur in some benchmark item can add to a containment, so a document is first reduced
to those: a bit table of fixed size, filled with the hashes of all benchmark shingles, lets through what may
be one, and an exact join drops the rest.  Documents with the same reduced set, as copies of one passage have, are
searched once.  Reduced sets and items are partitioned by size, because containment bounds the Jaccard
similarity only when the sizes are known to be near: within a partition the two are at most a factor of four apart, an
item that is contained to 0.8 has a similarity of 0.19 at least, and 64 MinHash values agree somewhere but for about 1 pair in
700,000.  A document that is more than four times an item's size in benchmark shingles, as one that holds many items, is matched with
it by the shingles themselves.  Every candidate is verified by exact containment of its shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import stored

SHINGLE_WORDS = 5
CONTAINED = 0.8
HASHES = 64
#: Bits of the table that lets shingles through, as a power of two; 8 MB whatever the benchmark's size.
TABLE_BITS = 26
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of a word, kept while it fits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        return value


_hashes = _Hashes()


def words(text: str | None) -> list[str]:
    """Lower-case words: the runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def shingle_hashes(parts: list[str], n: int) -> np.ndarray:
    total = len(parts) - n + 1
    if total < 1:
        return np.zeros(0, dtype=np.uint64)
    value = np.fromiter(map(_hashes.__getitem__, parts), dtype=np.uint64, count=len(parts))
    out = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + value[k:k + total]
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _shingles(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets, slots = [], []
            for text in batch["text"]:
                parts = words(text)
                k = min(n, len(parts)) or n  # a short item is one shingle
                sets.append(list({" ".join(parts[i:i + k]) for i in range(len(parts) - k + 1)}))
                slots.append(np.unique(_slot(shingle_hashes(parts, k))))
            yield pd.DataFrame({"item_id": batch["item_id"], "shingles": sets, "slots": slots})

    return run


def _hits(box, lengths: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = box.value
        for batch in batches:
            ids, hashes, sets = [], [], []
            for doc, own, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                parts = words(text)
                found = set()
                for k in lengths:
                    slot = _slot(shingle_hashes(parts, k))
                    at = np.flatnonzero(bits[slot >> 3] & (1 << (slot & 7)).astype(np.uint8))
                    found.update(" ".join(parts[i:i + k]) for i in at.tolist())
                if found:
                    ids.append(doc)
                    hashes.append(own)
                    sets.append(sorted(found))
            if ids:
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "text_hash": hashes, "hits": sets})

    return run


def _signature(column: str):
    return F.transform(
        F.sequence(F.lit(0), F.lit(HASHES - 1)),
        lambda j: F.array_min(F.transform(column, lambda x: F.xxhash64(x, j))))


def _size_class(size):
    return F.floor(F.log2(size.cast("double"))).cast("int")


def contained(docs: DataFrame, items: DataFrame, share: float = CONTAINED, n: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_hash, item_id, shared, item_shingles, containment`` for every document that holds an item.

    A document holds an item when it has at least ``share`` of the item's distinct ``n``-word shingles.  ``text_hash``
    (Spark's ``xxhash64`` of the text) tells rows with one id and different texts apart; equal rows give one.  An item
    of fewer than ``n`` words has one shingle, all its words, and is held where they stand in a row; documents are read with windows of
    those lengths as well if there are such items.  Null and empty texts have no shingle: they neither hold nor are held.  Texts of any
    length are read whole, extra columns are ignored, and no documents or no items give no rows.
    """
    spark = docs.sparkSession
    made, _ = stored(
        items.select("item_id", "text").mapInPandas(_shingles(n), "item_id long, shingles array<string>, slots array<long>")
        .where(F.size("shingles") > 0).dropDuplicates(), "benchmark")
    words_of = made.select(F.explode("slots").alias("s")).groupBy(F.shiftrightunsigned("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("bits"))
    n_words = F.size(F.split(F.element_at("shingles", 1), " "))
    lengths = sorted(r["k"] for r in made.select(n_words.alias("k")).distinct().collect())  # n and less
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    for r in words_of.collect():  # at most 2 ** (TABLE_BITS - 6) rows
        table[r["word"]] = r["bits"]
    box = spark.sparkContext.broadcast(table.astype("<i8").view(np.uint8))
    hits, _ = stored(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        .mapInPandas(_hits(box, lengths), "doc_id long, text_hash long, hits array<string>"), "hits")
    key = F.struct(F.xxhash64("hits"), F.md5(F.concat_ws("\n", "hits")))
    sets = hits.groupBy(key.alias("set_id")).agg(F.first("hits").alias("hits"))
    pieces = made.select(F.explode("shingles").alias("shingle")).distinct()
    reduced, _ = stored(
        sets.select("set_id", F.explode("hits").alias("shingle")).join(pieces, "shingle")
        .groupBy("set_id").agg(F.collect_list("shingle").alias("have"))
        .withColumn("class", _size_class(F.size("have"))), "reduced")
    own = made.select("item_id", "shingles", F.size("shingles").alias("n")).withColumn("class", _size_class(F.col("n")))
    keys = own.select("item_id", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"),
                      F.posexplode(_signature("shingles")).alias("j", "value"))
    by_hash = reduced.select("set_id", "class", F.posexplode(_signature("have")).alias("j", "value")).join(
        keys, ["class", "j", "value"]).select("set_id", "item_id")
    by_shingle = reduced.select("set_id", F.col("class").alias("c"), F.explode("have").alias("shingle")).join(
        own.select("item_id", "class", F.explode("shingles").alias("shingle")), "shingle").where("c > class + 1").select(
        "set_id", "item_id")
    shared = F.size(F.array_intersect("have", "shingles"))
    pairs = (
        by_hash.unionByName(by_shingle).distinct().join(reduced.select("set_id", "have"), "set_id").join(own, "item_id")
        .select("set_id", "item_id", shared.cast("long").alias("shared"), F.col("n").cast("long").alias("item_shingles"))
        .where(F.col("shared") >= share * F.col("item_shingles")))
    return hits.select("doc_id", "text_hash", key.alias("set_id")).distinct().join(pairs, "set_id").select(
        "doc_id", "text_hash", "item_id", "shared", "item_shingles",
        (F.col("shared") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contained(docs, items).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    marked = docs.withColumn("_text_hash", F.xxhash64("text"))
    return marked.join(
        bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left_anti"
    ).select(*docs.columns)
