"""Token ids in Huffman-coded files.

Documents are range-partitioned by id, and each partition becomes one file: blocks of whole documents, coded independently with one
canonical prefix code for the whole collection.  The code comes from the counts of all ids; code lengths are limited by
package-merge.  A block holds the bits, the offset of the bit at which every ``STRIDE``-th id starts, and the ids, lengths and
starts of its documents.  Decoding needs a table of ``2 ** MAX_BITS`` entries and runs all stretches between offsets side by side.

A file is a set of rows in Parquet, so that it lives in any store that Spark reaches: ``blocks`` (file, block, starts, bits, offsets,
documents) and ``code`` (id, length).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.llm import piece_ids
from runloom.llm.common import small_batches
from runloom.session import scratch_path, stored

MAX_BITS = 20
STRIDE = 64
BLOCK_IDS = 1 << 16
END = 1


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    kinds, layer = [], weight
    for _ in range(limit - 1):
        pairs = layer[: len(layer) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([weight, pairs])
        order = np.argsort(joined, kind="stable")
        kinds.append(order < len(weight))
        layer = joined[order]
    take, depth = 2 * len(used) - 2, np.zeros(len(used), dtype=np.int64)
    for single in reversed(kinds):
        alone = int(single[:take].sum())
        depth[:alone] += 1
        take = 2 * (take - alone)
    depth[:take] += 1
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by length, then id; and the used ids in that order."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    codes = np.zeros(len(lengths), dtype=np.uint64)
    if len(used):
        width = np.int64(1) << (size[-1] - size)
        first = np.concatenate([[0], np.cumsum(width)[:-1]])
        codes[used] = (first >> (size[-1] - size)).astype(np.uint64)
    return codes, used


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every string of as many bits as the longest code: the id it starts with and that id's length."""
    _, used = canonical(lengths)
    if not len(used):
        return np.zeros(1, dtype=np.uint32), np.zeros(1, dtype=np.uint8), 0
    deep = int(lengths[used].max())
    width = np.int64(1) << (deep - lengths[used].astype(np.int64))
    table = np.zeros(1 << deep, dtype=np.uint32)
    sizes = np.ones(1 << deep, dtype=np.uint8)
    ids = np.repeat(used.astype(np.uint32), width)
    table[: len(ids)] = ids
    sizes[: len(ids)] = lengths[ids]
    return table, sizes, deep


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits, padded by eight bytes, and the offset of every ``STRIDE``-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    total = int(end[-1]) if len(end) else 0
    word, shift = begin >> 5, begin & 31
    spread = codes[ids] << (64 - size - shift).astype(np.uint64)
    words = np.zeros((total >> 5) + 4, dtype=np.float64)
    # codes do not overlap, so that adding is the same as setting bits; sums stay below 2 ** 32 and exact
    words += np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), len(words))
    words += np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    return words.astype(np.uint64).astype(">u4").tobytes(), begin[::STRIDE].astype("<i8")


def decode(bits: bytes, offsets: np.ndarray, total: int, table: np.ndarray, sizes: np.ndarray, deep: int) -> np.ndarray:
    out = np.zeros((STRIDE, len(offsets)), dtype=np.uint32)
    raw = np.frombuffer(bits, dtype=">u4").astype(np.uint64)
    pairs = (raw[:-1] << np.uint64(32)) | raw[1:]
    at = offsets.astype(np.int64)
    last = (len(pairs) - 1) << 5
    back = np.int64(64 - deep)
    mask = np.uint64((1 << deep) - 1)
    for k in range(min(STRIDE, total)):
        window = (pairs[at >> 5] >> (back - (at & 31)).astype(np.uint64)) & mask
        out[k] = table[window]
        at = np.minimum(at + sizes[window], last)
    return out.T.reshape(-1)[:total]


def encode_whole(path: str, texts: list[str]) -> list[np.ndarray]:
    found = piece_ids.tokenizer(path).encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, dtype=np.uint32) for e in found]


def encode_by_piece(path: str, texts: list[str]) -> list[np.ndarray]:
    """The same ids as ``encode_whole``, several times faster."""
    return list(map(piece_ids.of_file(path).of, texts))


def _width(path: str) -> str:
    return "<u2" if piece_ids.tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, encoder: Callable = encode_by_piece, end: int = END) -> DataFrame:
    """Blocks of whole documents in id order, written once: ``file, block, start, doc_ids, sizes, ids``.

    A file is a range of ids; ``start`` counts the ids before a block in its file.  A block closes at ``BLOCK_IDS``.
    """
    width = _width(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = start = held = 0
        docs: list = []
        parts: list[np.ndarray] = []
        file = None

        def closed() -> pd.DataFrame:
            return pd.DataFrame({
                "file": [file], "block": [block], "start": [start], "doc_ids": [docs], "sizes": [[len(p) for p in parts]],
                "ids": [np.concatenate(parts).astype(width).tobytes()]})

        for batch in batches:
            file = batch["file"].iloc[0] if len(batch) else file
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for at in range(0, len(texts), 64):
                for doc, found in zip(ids[at:at + 64], encoder(path, texts[at:at + 64])):
                    docs.append(doc)
                    parts.append(np.append(found, np.uint32(end)))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield closed()
                        block, start, held, docs, parts = block + 1, start + held, 0, [], []
        if docs:
            yield closed()

    # rows of one id, null among them, may be many: they are dealt and ordered by a hash of their texts
    cut = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange("doc_id", "_hash")
    cut = cut.sortWithinPartitions("doc_id", "_hash", "text")
    with small_batches(docs.sparkSession):
        rows, _ = stored(
            cut.select("doc_id", "text", F.spark_partition_id().alias("file")).mapInPandas(
                run, "file int, block long, start long, doc_ids array<long>, sizes array<long>, ids binary"), "ids")
    return rows


def counts(rows: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs.  Tasks count their own rows; one row for each id they saw is added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                found = np.bincount(np.frombuffer(ids, dtype=width))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), dtype=np.int64))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    found = rows.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r["id"] for r in found), default=0), dtype=np.int64)
    for r in found:  # as many rows as the vocabulary has ids
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, path: str, folder: str | None = None, encoder: Callable = encode_by_piece) -> str:
    """Write ``docs`` in id order below ``folder`` (a fresh shared one if none); returns it.

    A null text has no ids but the end.  Rows with one id are ordered by a hash of the text; null ids come first.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    rows = tokenized(docs, path, encoder)
    width = _width(path)
    lengths = code_lengths(counts(rows, width))
    spark.createDataFrame(pd.DataFrame({"id": np.arange(len(lengths)), "length": lengths.astype(np.int32)})).coalesce(1).write.parquet(f"{folder}/code")
    box = spark.sparkContext.broadcast((canonical(lengths)[0], lengths))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    total = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    starts = rows.groupBy("file").agg(total).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("file_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, lengths = box.value
        for batch in batches:
            coded = [encode(np.frombuffer(ids, dtype=width), codes, lengths) for ids in batch["ids"]]
            yield batch.drop(columns="ids").assign(bits=[b for b, _ in coded], offsets=[o.tobytes() for _, o in coded])

    coded = rows.mapInPandas(
        run, "file int, block long, start long, doc_ids array<long>, sizes array<long>, bits binary, offsets binary")
    coded.join(starts, "file").write.parquet(f"{folder}/blocks")
    return folder


def read(spark: SparkSession, folder: str, digest: bool = True) -> DataFrame:
    """Documents decoded from files: ``doc_id, start, n_tokens, ids_crc32`` and, unless ``digest``, ``ids``."""
    code = spark.read.parquet(f"{folder}/code").orderBy("id").toPandas()
    lengths = code["length"].to_numpy().astype(np.uint8)
    box = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sizes, deep = decoding_table(box.value)
        for batch in batches:
            for r in batch.to_dict("records"):
                n = np.asarray(r["sizes"], dtype=np.int64)
                ids = decode(r["bits"], np.frombuffer(r["offsets"], dtype="<i8"), int(n.sum()), table, sizes, deep).astype("<u4")
                end = np.cumsum(n)
                out = pd.DataFrame({
                    "doc_id": pd.array(list(r["doc_ids"]), dtype="Int64"), "start": r["file_start"] + r["start"] + end - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(ids[a:b].data) for a, b in zip(end - n, end)]})
                if not digest:
                    out["ids"] = [ids[a:b] for a, b in zip(end - n, end)]
                yield out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest else ", ids array<long>")
    return spark.read.parquet(f"{folder}/blocks").mapInPandas(run, schema)
