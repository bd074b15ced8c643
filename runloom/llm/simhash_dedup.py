"""SimHash near-duplicates by tables of distances to reference fingerprints.

A fingerprint is the bitwise majority over the hashes of a text's shingles.  For every distinct
fingerprint the Hamming distances to a fixed set of reference fingerprints are computed once.  By the
triangle inequality two fingerprints at distance d differ by at most d in each coordinate, so a
pair whose coordinates differ more anywhere is discarded before its own distance is computed; the rest is verified.

Coordinates of random 64-bit words all lie near 32, so they cannot by themselves say which pairs
to look at.  Pairs therefore come from ``radius + 1`` inverted lists over equal parts of the word: two words within the
radius agree on at least one part.  Long lists are compared in blocks (``common.dealt``), and a cell hands on the
components it found, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm import common
from runloom.session import stored

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
REFERENCES = 16
_CHUNK = 1 << 18


def references(count: int = REFERENCES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, dtype=np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text that is null or has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    begin = [0, *accumulate(len(p) + 1 for p in parts)]
    step = min(words, len(parts))
    total = len(parts) - step + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        stop = min(total, at + _CHUNK)
        hashes = np.fromiter(
            (digest(joined[a:b - 1], SEED) for a, b in zip(begin[at:stop], begin[at + step:stop + step])),
            dtype="<u8", count=stop - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) and ``text_hash`` for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": value, "text_hash": batch["text_hash"]})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(
        run, "doc_id long, fp long, text_hash long")


def _postings(radius: int, count: int):
    pivots = references(count)
    parts = radius + 1
    edges = np.linspace(0, 64, parts + 1).astype(int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64)
            bits = fp.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ pivots[None, :]).astype(np.uint8)
            rows = [r.tobytes() for r in near]
            for p in range(parts):
                value = (bits >> np.uint64(edges[p])) & np.uint64((1 << int(edges[p + 1] - edges[p])) - 1)
                yield pd.DataFrame({"part": p, "value": value.astype(np.int64), "fp": fp, "near": rows})

    return run


def _links(radius: int):
    def verified(a: np.ndarray, b: np.ndarray, fp: np.ndarray, near: np.ndarray) -> np.ndarray:
        keep = np.arange(len(a))
        for c in range(near.shape[1]):
            if not len(keep):
                break
            keep = keep[np.abs(near[a[keep], c] - near[b[keep], c]) <= radius]
        return keep[np.bitwise_count(fp[a[keep]] ^ fp[b[keep]]) <= radius]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, start in common.cells(batches, ["part", "value"]):
            size = np.diff(np.append(start, len(frame)))
            if not len(size) or size.max() < 2:
                continue
            signed = frame["fp"].to_numpy(dtype=np.int64)
            fp = signed.view(np.uint64)
            near = np.frombuffer(b"".join(frame["near"]), dtype=np.uint8).reshape(len(frame), -1).astype(np.int16)
            own, mixed = frame["_own"].to_numpy(), (frame["_lo"] != frame["_hi"]).to_numpy()
            cell = np.repeat(np.arange(len(start)), size)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for step in range(1, int(size.max())):
                a = np.flatnonzero(cell[:-step] == cell[step:])
                if mixed.any():
                    a = a[~mixed[a] | (own[a] != own[a + step])]
                good = a[verified(a, a + step, fp, near)]
                if len(good):
                    found.append((good, good + step))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                label = common.star_labels(i, j, len(frame))
                tied = np.flatnonzero(label != np.arange(len(frame)))
                yield pd.DataFrame({"a": signed[tied], "b": signed[label[tied]]})

    return run


def groups(prints: DataFrame, radius: int = RADIUS, count: int = REFERENCES) -> DataFrame:
    """``fp`` and ``root`` for every distinct fingerprint; equal roots are one group."""
    distinct, _ = stored(prints.select("fp").distinct(), "fingerprints")
    postings = distinct.mapInPandas(_postings(radius, count), "part int, value long, fp long, near binary")
    links = common.dealt(postings, ["part", "value"], "fp").mapInPandas(_links(radius), "a long, b long")
    found = common.components(links, "fingerprint-links")
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row for each document: ``doc_id, fingerprint, component_id, kept``.

    Documents are linked when their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the
    least doc_id reachable by links.  A null text and one without words have fingerprint 0 and link like any other.
    Rows with equal ids and different texts are judged one by one; a null doc_id never is a component's id, unless
    the whole component has none.  Extra columns are ignored.  An empty table gives no rows.
    """
    prints, _ = stored(fingerprints(docs, words), "prints")
    root, _ = stored(groups(prints, radius), "groups")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc")).join(root, "fp")
    names = least.groupBy("root").agg(F.min("doc").alias("component_id"))
    known = root.join(names, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one from each group of near-duplicates: that of the least doc_id.

    Among rows with that id the one with the least hash of its text stays; a null id stays only when its group has no other.
    """
    prints, _ = stored(fingerprints(docs, words), "prints")
    root, _ = stored(groups(prints, radius), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w")
    best = prints.groupBy("fp").agg(first).join(root, "fp").groupBy("root").agg(F.min("w").alias("w"))
    winners = best.select(F.col("w.doc_id").alias("_doc"), F.col("w.text_hash").alias("_hash"))
    marked = docs.withColumn("_text_hash", F.xxhash64("text"))
    met = marked.join(winners, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return met.dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
