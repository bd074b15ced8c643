"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form each of them goes back to.

Two such words share the first or the last ``m // 2`` letters, m being the length of the shorter one, because the difference lies behind
the ones or before the others.  Words are therefore dealt by (m, side, those letters), hashed to buckets of bounded size, and
compared inside a bucket by a bit-sliced position index: for a position p and a letter c, the set of words with c at p is a string of
bits.  A query of m letters runs down the positions and keeps three sets, each updated for all words of the bucket at once:

``same``     words that agree so far                     same' = same & X
``changed``  one letter replaced so far                  changed' = changed & X | same & ~X
``longer``   one letter skipped in the word so far       longer' = (longer | same) & Y

where X is the set of words with the query's letter at p and Y that with it at p + 1.  All queries of a bucket run side by side.  The
work of a bucket is the square of its words over 64, and buckets do not grow with the vocabulary; those of letters that very many
words share are cut into blocks, each pair of blocks a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import cells, dealt, small_batches
from runloom.session import stored

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One occurrence in so many loses a letter.
DAMAGED = 97
#: Words of a bucket, and letters that they have together, about.
BUCKET_WORDS, BUCKET_LETTERS = 1024, 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _damaged(doc_id: Column, run: Column) -> Column:
    """``run`` without one letter if ``DAMAGED`` divides the crc32 of ``<doc_id>:<run>``; a null id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % DAMAGED == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words of at least so many letters and occurrences in all texts.

    Occurrences are counted per task before the shuffle.  Null texts have no words; texts of any length are read whole; repeated
    rows count again; further columns are ignored.
    """
    text = F.translate("text", _UPPER, _LOWER)
    # a run with too few letters cannot become a word, and a maximal run is what the pattern finds first
    runs = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("_run"))
    words = each.select(_damaged(F.col("doc_id"), F.col("_run")).alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points by word and position; 0 behind the end."""
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)


def near_pairs(queries: list[str], words: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and words, of m letters and of m or m + 1, that differ by exactly one letter replaced or inserted."""
    if not queries or not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    asked, held = _letters(queries, m), _letters(words, m + 1)
    n_bits = -(-len(words) // 64) * 64
    length = np.count_nonzero(held, axis=1)

    def bits(rows: np.ndarray) -> np.ndarray:
        """Sets of words, given by one row of booleans each, as strings of bits."""
        wide = np.zeros((len(rows), n_bits), dtype=bool)
        wide[:, : len(words)] = rows
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def sliced(position: int) -> tuple[np.ndarray, np.ndarray]:
        """The index at a position: letters and, for each, the words that have it there; the last set is empty."""
        here = np.unique(held[:, position])
        return here, bits(np.append(here[:, None] == held[:, position], np.zeros((1, len(words)), dtype=bool), axis=0))

    def chosen(index: tuple[np.ndarray, np.ndarray], letters: np.ndarray) -> np.ndarray:
        here, sets = index
        at = np.minimum(np.searchsorted(here, letters), len(here) - 1)
        return sets[np.where(here[at] == letters, at, len(here))]

    same = np.repeat(bits(np.ones((1, len(words)), dtype=bool)), len(queries), axis=0)
    changed, longer = np.zeros_like(same), np.zeros_like(same)
    index = sliced(0)
    for p in range(m):
        x = chosen(index, asked[:, p])
        index = sliced(p + 1)
        longer |= same
        longer &= chosen(index, asked[:, p])
        changed &= x
        changed |= same & ~x
        same &= x
    short, long = bits((length == m)[None]), bits((length == m + 1)[None])
    found = (changed & short) | ((longer | same) & long)
    q, word = np.nonzero(found)
    inside = np.unpackbits(found[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, bit = np.nonzero(inside)
    return q[hit], word[hit] * 64 + bit


def _compared(side_by_side: pd.DataFrame) -> pd.DataFrame:
    """For one cell: the words with near words in it, how many, and the most frequent of those."""
    words = side_by_side["word"].tolist()
    m, side = int(side_by_side["m"].iloc[0]), side_by_side["side"].iloc[0]
    lo, hi = int(side_by_side["_lo"].iloc[0]), int(side_by_side["_hi"].iloc[0])
    own = side_by_side["_own"].to_numpy()
    short = np.array([len(w) == m for w in words])
    every = np.arange(len(words))
    left, right = [], []
    for a, b in ((lo, hi), (hi, lo))[: 1 if lo == hi else 2]:
        asked, held = every[short & (own == a)], every[own == b]
        if a > b:  # two words of m letters have met the other way round
            held = held[~short[held]]
        q, w = near_pairs([words[i] for i in asked], [words[i] for i in held], m)
        left.append(asked[q])
        right.append(held[w])
    i, j = np.concatenate(left), np.concatenate(right)
    if lo == hi:
        once = ~short[j] | (i < j)
        i, j = i[once], j[once]
    half = m // 2
    front = pd.factorize(pd.Series([w[:half] for w in words]))[0]
    back = pd.factorize(pd.Series([w[len(w) - half:] for w in words]))[0]
    # a pair belongs to the side that it shares, the front if both
    mine = front[i] == front[j] if side == "front" else (back[i] == back[j]) & (front[i] != front[j])
    i, j = i[mine], j[mine]
    i, j = np.append(i, j), np.append(j, i)
    n = side_by_side["n"].tolist()
    order = sorted(every.tolist(), key=lambda k: (-n[k], words[k]))
    rank = np.zeros(len(words), dtype=np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(words), len(words))
    np.minimum.at(best, i, rank[j])
    has = np.flatnonzero(np.bincount(i, minlength=len(words)))
    of = np.array(order, dtype=np.int64)[best[has]]
    return pd.DataFrame({
        "word": pd.Series([words[k] for k in has], dtype=object), "n_near": np.bincount(i, minlength=len(words))[has],
        "form": pd.Series([words[k] for k in of], dtype=object), "form_n": pd.Series([n[k] for k in of], dtype="int64")})


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` for the rows ``word, n`` that have near words: how many, and the one of largest n."""
    length = F.char_length("word")
    placed = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0").withColumn(
        "side", F.explode(F.array(F.lit("front"), F.lit("back"))))
    half = F.floor(F.col("m") / 2).cast("int")
    shared = F.when(F.col("side") == "front", F.left("word", half)).otherwise(F.right("word", half))
    placed = placed.withColumn("_shared", F.xxhash64(shared))
    # buckets by (m, side) so that each has about so many words and letters; stored, so that the planner knows how few rows that are: words of
    # k different lengths have k * k / 2 letters at least
    sizes, _ = stored(placed.groupBy("m", "side").agg(F.count(F.lit(1)).alias("_rows")).select(
        "m", "side", F.greatest(
            F.ceil(F.col("_rows") * (F.col("m") + 1) / BUCKET_LETTERS), F.ceil(F.col("_rows") / BUCKET_WORDS)).alias("_buckets")), "bucket-sizes")
    lists = placed.join(sizes, ["m", "side"]).select(
        "word", "n", "m", "side", F.pmod("_shared", "_buckets").alias("bucket"))
    keys = ["m", "side", "bucket"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in cells(batches, keys):
            for a, b in zip(starts, [*starts[1:], len(frame)]):
                yield _compared(frame.iloc[a:b])

    with small_batches(words.sparkSession, 4 * BUCKET_WORDS):
        found, _ = stored(
            dealt(lists, keys, "word", BUCKET_WORDS).select("word", "n", *keys, "_own", "_lo", "_hi").mapInPandas(
                run, "word string, n_near long, form string, form_n long"), "near-words")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the end of the chain of forms.

    Chains are halved each round by joining them with themselves; n at least doubles from a word to its form, so that a chain
    has no more links than the largest n has bits, and the rounds are the logarithm of that.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now, (moved,) = stored(
            now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            "roots", F.count_if("_moved"))
        now = now.drop("_moved")
        if not moved:
            return now


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = 2) -> DataFrame:
    """One row for each word of :func:`vocabulary`: ``word, n, n_near, form, form_n, root``.

    ``n_near`` counts the words that differ from it by one letter.  ``form`` is the most frequent of them (ties: the first in
    code point order) if it occurs ``times`` as often as the word at least; ``root`` is where the forms lead.  A table without words gives
    no rows.
    """
    if times < 2:
        raise ValueError("forms must occur twice as often at least, or they could go round in circles")
    words, _ = stored(vocabulary(docs, least_letters, least_count), "vocabulary")
    near = near_words(words)
    is_form = F.col("form_n") >= times * F.col("n")
    judged, _ = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "judged")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(*judged.columns, F.coalesce("root", "word").alias("root"))
