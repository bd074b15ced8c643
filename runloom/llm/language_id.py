"""Language identification with a string kernel.

The kernel of two texts counts the character n-grams of one to four letters that both contain (a blended spectrum,
presence only), divided by the geometric mean of their own counts.  N-grams are hashed to ``BUCKETS``.
Training texts are mapped by the Nystroem method to the space spanned by some of them, the landmarks, where kernel
ridge regression fits one score per language against the rest.  The kernel to a landmark is a scalar product of
presence vectors, so the landmarks and regression weights fold into one matrix without approximation, and a batch of
texts is scored by one product of its presence matrix with it.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

BUCKETS = 1 << 15
LONGEST = 4
#: The classifier is fitted on a sample: about so many texts of a language, and of all languages together.
TEXTS_PER_LANGUAGE = 250
MOST_TEXTS = 2000
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"
_ROWS = 128
#: Code points handled at once, so that a very long text needs no more memory than its own.
_PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str, row: np.ndarray) -> bool:
    """Set in ``row`` the buckets of the n-grams of ``text``; false if it has no letter.

    Letters are lower-cased, every run of other characters is one space.
    """
    letter, any_letter, held = _letters(), False, np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), _PIECE):
        points = np.frombuffer(text[at:at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        known = letter[points]
        any_letter |= bool(known.any())
        points = np.where(known, points, 32).astype(np.uint32)
        points = np.concatenate([held if at else np.array([32], dtype=np.uint32), points])
        gap = points == 32
        points = points[~(gap & np.append(False, gap[:-1]))]
        gram = np.zeros(len(points), dtype=np.uint32)
        for n in range(1, LONGEST + 1):
            if len(points) < n:
                break
            gram = gram[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1:]
            row[((gram + np.uint32(n)) * np.uint32(0x85EBCA77)) >> np.uint32(17)] = 1
        held = points[-(LONGEST - 1):]
    return any_letter


@dataclass
class Model:
    """``weights[bucket, language]``; the score of a text is its presence row times it, over its norm."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(texts), len(self.languages)))
        known = np.zeros(len(texts), dtype=bool)
        grid = np.zeros((min(_ROWS, len(texts)), BUCKETS), dtype=np.float32)
        for at in range(0, len(texts), _ROWS):
            part = texts[at:at + _ROWS]
            grid[:] = 0
            for i, text in enumerate(part):
                known[at + i] = bool(text) and presence(text, grid[i])
            block = grid[: len(part)]
            size = np.sqrt(np.maximum(block.sum(axis=1), 1))
            out[at:at + len(part)] = (block @ self.weights) / size[:, None]
        return out, known


def fit(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``rows``: presence vectors; ``languages``: theirs."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    unit = rows.astype(np.float32)
    unit /= np.sqrt(np.maximum(unit.sum(axis=1, keepdims=True), 1))
    pick = np.unique(np.linspace(0, len(unit) - 1, min(landmarks, len(unit))).astype(int))
    marks = unit[pick]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > value.max() * 1e-6
    half = vector[:, good] / np.sqrt(value[good])
    space = (unit @ marks.T).astype(np.float64) @ half
    share = {n: languages.count(n) for n in names}
    weight = np.array([1 / share[n] for n in languages])[:, None]
    target = np.array([[1.0 if n == m else -1.0 for m in names] for n in languages])
    gram = space.T @ (weight * space)
    solved = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), space.T @ (weight * target))
    return Model(names, (marks.T @ (half @ solved)).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, most: int = MOST_TEXTS) -> Model:
    """Fit on a sample by hash of about ``per_language`` rows of each ``lang`` (fewer, if ``most`` needs it).

    ``labelled`` has ``doc_id, text, lang``.  Only presence bits of the sample reach the driver, 4 KB for each text.
    """
    sizes = {r["lang"]: r["count"] for r in labelled.where("lang IS NOT NULL").groupBy("lang").count().collect()}
    if not sizes:
        return fit(np.zeros((0, BUCKETS), dtype=np.uint8), [])
    each = max(1, min(per_language, most // len(sizes)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(each / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    sample = labelled.where(F.col("lang").isNotNull()).where(chance < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = []
            for text in batch["text"]:
                row = np.zeros(BUCKETS, dtype=np.uint8)
                bits.append(np.packbits(row).tobytes() if text and presence(text, row) else None)
            yield pd.DataFrame({"lang": batch["lang"], "bits": bits})

    found = sample.mapInPandas(run, "lang string, bits binary").where("bits IS NOT NULL").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    # languages take turns, so that landmarks spread over all of them
    turn: dict[str, int] = defaultdict(int)
    nth = []
    for r in found:
        nth.append(turn[r["lang"]])
        turn[r["lang"]] += 1
    found = [found[i] for i in sorted(range(len(found)), key=nth.__getitem__)]
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), dtype=np.uint8).reshape(len(found), BUCKETS // 8)
    return fit(np.unpackbits(packed, axis=1), [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``raw``, the regression's value (near 1 for a sure case).

    A null text and one without a letter are ``und`` with score 0, as is every text when nothing was learned.
    ``prefix`` keeps the new names apart from those of ``docs``, which pass unchanged.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + n for n in ("lang_pred", "score", "raw")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = box.value
        for batch in batches:
            scores, known = model.scores(batch.column("text").to_pylist())
            if model.languages:
                best = scores.argmax(axis=1)
                raw = scores[np.arange(len(best)), best]
                label = np.where(known, np.array(model.languages, dtype=object)[best], UNKNOWN)
            else:
                raw, label = np.zeros(batch.num_rows), np.full(batch.num_rows, UNKNOWN, dtype=object)
            score = np.where(known & (label != UNKNOWN), np.clip((raw + 1) / 2, 0, 1), 0.0)
            new = [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(known, raw, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, *[
        StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), DoubleType()))]])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, held_out, lang_pred, score``.

    Learns from rows with a language that are not held out; a null doc_id is not held out.  Languages tied in score go to
    the first by name.  Repeated rows are predicted alike; extra columns are ignored; an empty table gives no rows.
    """
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where("NOT held_out"))
    return predict(marked.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
