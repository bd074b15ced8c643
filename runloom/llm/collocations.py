"""Phrases that stick together, from a weighted de Bruijn graph of word sequences.

Nodes are sequences of three words, and an edge is a sequence of four: it leads from its first three words to its last three and
weighs as often as it occurs.  Edges are all that is counted over the texts, with a correction where a run of words ends.  Every
occurrence of three words either goes on along an edge or ends its run, so that

``f3(a b c) = sum over d of f4(a b c d) + runs that end in a b c``
``f2(a b)   = sum over c of f3(a b c)   + runs that end in a b``

A run is a piece of text between marks, cut also at words that are too rare to be in any phrase asked for: those are known from a
first count of all words, which also gives ``f1``.  Words are represented by 64-bit hashes of language and word, under the first seed for which no two words
of the collection share one, so that counts are exact and no dictionary is sent to the tasks; a table of bits of fixed size, filled with
the hashes of frequent words, lets through what may be frequent.

A node that one edge enters and one edge leaves, both with the node's whole flow, is unary: its words never occur but inside
that edge's.  Unary nodes are compacted away before phrases are compared, and :func:`passages` joins the edges across them to the
longest passages that are always repeated as a whole.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import small_batches
from runloom.session import stored

LEAST = 30
TOP = 2000
#: A phrase goes when so many percent of its occurrences lie inside one longer phrase.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Bits of the table of frequent words, as a power of two; 8 MB whatever the number of words.
TABLE_BITS = 26
#: Positions whose edges a task counts together, and different words whose counts it holds.
_POSITIONS, _WORDS = 1 << 20, 1 << 18
#: A word that makes up more than one in ``_HOT`` of all is hot: there are no more than ``_HOT`` of them.  What begins with two hot words is dealt
#: to ``_SALTS`` places; what begins with any other two is one in ``_HOT`` at most.
_HOT, _SALTS = 500, 64
#: Sorted rows that are added up together.
_ROWS = 1 << 17
_KEYS = ["a", "b", "c", "d"]
_MARK = b"\xff"  # no byte of UTF-8


def _byte_table() -> bytes:
    """Lower-cases A-Z, makes tabs blanks and every mark that ends a piece ``_MARK``."""
    table = bytearray(bytes(range(256)).lower())
    for mark in b".,;:!?\n\x0b\x0c\r":
        table[mark] = _MARK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


_BYTES = _byte_table()


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in order, with ``_MARK`` between pieces."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).replace(_MARK, b" \xff ").split()


def _lang() -> Column:
    return F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all texts; tasks add up what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bytes], int] = {}
        held: dict[str, dict[bytes, int]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.DictionaryArray.from_arrays(np.zeros(len(words), dtype=np.int32), [lang]).cast(pa.string()),
                    pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = held.setdefault(lang, {})
                get = words.get
                for w in tokens(text):
                    words[w] = get(w, 0) + 1
                words.pop(_MARK, None)
            if sum(map(len, held.values())) > _WORDS:
                yield from handed()
        yield from handed()

    each = docs.select(_lang(), "text").mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), "lang", "word")


def _language_seed(seed: int, lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), xxhash.xxh64_intdigest(struct.pack("<q", seed), 42))


def _separating_seed(words: DataFrame) -> int:
    """The first seed under which no two words, and no word and 0, share a hash."""
    for seed in count():
        found = words.select(_key(seed).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("distinct"), F.count_if(F.col("key") == 0).alias("zero")).first()
        if found["n"] == found["distinct"] and not found["zero"]:
            return seed
    raise AssertionError


def _table(frequent: DataFrame) -> np.ndarray:
    """Bits of the slots of ``key``; at most ``2 ** (TABLE_BITS - 6)`` rows reach the driver, whatever the number of words."""
    slot = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    rows = frequent.select(slot.alias("s")).groupBy(F.shiftrightunsigned("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    for r in rows.collect():
        table[r["word"]] = r["bits"]
    return table.view(np.uint8)


class _WordKeys(dict):
    """Keys of a language's words; 0 for marks and for words that are too rare.  Forgets all when full."""

    def __init__(self, seed: int, bits: np.ndarray):
        self.seed, self.bits = seed, bits

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        key = 0
        if word != _MARK:
            key = xxhash.xxh64_intdigest(word, self.seed)
            slot = key >> (64 - TABLE_BITS)
            if not self.bits[slot >> 3] >> (slot & 7) & 1:
                key = 0
        self[word] = key
        return key


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges and the ends of runs in a sequence of unsigned keys that ends with 0; rows of four keys, and counts.

    The end of a run is its last three words and 0, and also its last two words and 0, 0.
    """
    own, place = np.unique(np.append(keys, np.zeros(3, dtype=keys.dtype)), return_inverse=True)
    if len(own) > 1 << 16:  # four numbers of words fill 64 bits: cut at a run's end, near the middle
        ends = np.flatnonzero(keys[:-1] == 0)
        if len(ends):
            cut = int(ends[len(ends) // 2]) + 1
            halves = [_counted(part) for part in (keys[:cut], keys[cut:])]
            return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
    word = place[:-3] > 0
    after = [place[k:len(place) - 3 + k] for k in range(4)]
    two = word & (after[1] > 0)
    three = two & (after[2] > 0)
    edge = three & (after[3] > 0)
    last_two, last_three = two & (after[2] == 0), three & (after[3] == 0)
    after[3] = np.where(after[2] > 0, after[3], 0)  # behind a run's end another begins
    rows = [np.concatenate([a[edge], a[last_three], a[last_two]]) for a in after]
    if len(own) <= 1 << 16:
        packed = np.zeros(len(rows[0]), dtype=np.uint64)
        for r in rows:
            packed = packed << np.uint64(16) | r.astype(np.uint64)
        packed.sort()
        at = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.append(at, len(packed)))
        packed = packed[at]
        rows = [(packed >> np.uint64(s) & np.uint64(0xFFFF)).astype(np.int64) for s in (48, 32, 16, 0)]
    else:  # one run of more different words than that
        n = np.ones(len(rows[0]), dtype=np.int64)
    return np.stack([own[r] for r in rows], axis=1).view(np.int64), n


def edges(docs: DataFrame, seed: int, table: np.ndarray, hot: Sequence[int] = ()) -> DataFrame:
    """``a, b, c, d, n, salt``: edges, and the ends of runs with ``d``, or ``c`` and ``d``, 0.

    Each task adds up stretches of its texts; a row may come from several.  ``salt`` tells apart, by their third word, rows that begin with
    two of the ``hot`` keys; it is 0 for others.
    """
    box = docs.sparkSession.sparkContext.broadcast((table, np.array(sorted(hot), dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = box.value
        known = functools.cache(lambda lang: _WordKeys(_language_seed(seed, lang), bits))
        held, n = [], 0

        def handed() -> pa.RecordBatch:
            found, times = _counted(np.concatenate(held))
            salt = np.where(np.isin(found[:, 0], often) & np.isin(found[:, 1], often), 1 + found[:, 2] % _SALTS, 0).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(found[:, k]) for k in range(4)), pa.array(times, pa.int64()), pa.array(salt)], [*_KEYS, "n", "salt"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = tokens(text)
                words.append(_MARK)
                held.append(np.fromiter(map(known(lang).__getitem__, words), dtype=np.uint64, count=len(words)))
                n += len(words)
                if n >= _POSITIONS:
                    yield handed()
                    held, n = [], 0
        if held:
            yield handed()

    return docs.select(_lang(), "text").mapInArrow(run, "a long, b long, c long, d long, n long, salt int")


class _Sums:
    """Sums over the first ``width`` keys of sorted rows that come in stretches; the last group waits for the next stretch."""

    def __init__(self, width: int):
        self.width = width
        self.key, self.n = np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.key, keys[:, :self.width]])
        n = np.concatenate([self.n, n])
        if not len(n):
            return keys, n
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        keys, n = keys[at], np.add.reduceat(n, at)
        self.key, self.n = keys[-1:], n[-1:]
        return keys[:-1], n[:-1]


def graph(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """``a, b, c, d, n``: all phrases of two to four words (0 behind the last) that occur ``least`` times, from :func:`edges`.

    Edges are dealt and sorted by their first two words, so that one pass over them adds up the edges, the flow through their first nodes,
    and the flow of those nodes' first two words, and only frequent phrases leave it.  Pairs of hot words have rows in
    several places; what each of these found is added up at the end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = {4: _Sums(4), 3: _Sums(3), 2: _Sums(3)}
        held, n_held = [], 0

        def sums(rows: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([r.column(k).to_numpy() for r in rows]) for k in range(6)] if rows else [np.zeros(0, dtype=np.int64)] * 6
            keys, n, salt = np.stack(columns[:4], axis=1), columns[4], columns[5].astype(np.int64)
            pair = np.stack([columns[0], columns[1], salt], axis=1)
            for words, level in levels.items():
                mine = keys[:, words - 1] != 0
                found, total = level.add(*((pair, n) if words == 2 else (keys[mine], n[mine])))
                if last:
                    found, total = np.concatenate([found, level.key]), np.concatenate([total, level.n])
                kept = total >= least
                if words == 2:  # the third key is the salt
                    kept |= found[:, 2] > 0
                    found = found[:, :2]
                found = np.pad(found[kept], ((0, 0), (0, 4 - found.shape[1])))
                yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(4)), pa.array(total[kept])], [*_KEYS, "n"])

        for batch in batches:
            held.append(batch)
            n_held += batch.num_rows
            if n_held >= _ROWS:
                yield from sums(held, False)
                held, n_held = [], 0
        yield from sums(held, True)

    dealt = counted.repartition("a", "b", "salt")
    # a hash first: few rows have the same one, so that sorting seldom looks further
    in_order = dealt.withColumn("_h", F.xxhash64("a", "b")).sortWithinPartitions("_h", "a", "b", "salt", "c", "d").drop("_h")
    found = in_order.mapInArrow(run, "a long, b long, c long, d long, n long")
    return found.groupBy(*_KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _parts(key: list[Column]) -> Column:
    """For a phrase: its cuts as (k, first part, rest)."""
    a, b, c, d = key
    zero = F.lit(0).cast("long")

    def phrase(*words):
        words = [*words, zero, zero, zero][:3]
        return F.struct(*[w.alias(x) for w, x in zip(words, "abc")])

    def cut(k, left, right):
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))

    return F.when(c == 0, F.array(cut(1, phrase(a), phrase(b)))).when(
        d == 0, F.array(cut(1, phrase(a), phrase(b, c)), cut(2, phrase(a, b), phrase(c)))).otherwise(
        F.array(cut(1, phrase(a), phrase(b, c, d)), cut(2, phrase(a, b), phrase(c, d)), cut(3, phrase(a, b, c), phrase(d))))


def unary_nodes(found: DataFrame) -> DataFrame:
    """The nodes ``a, b, c`` that one edge enters and one leaves with all of the node's flow."""
    edge, node = found.where("d <> 0"), found.where("c <> 0 AND d = 0").select("a", "b", "c", F.col("n").alias("flow"))
    sides = edge.select("a", "b", "c", "n", F.lit(1).alias("out")).unionByName(
        edge.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c"), "n", F.lit(0).alias("out")))
    met = sides.groupBy("a", "b", "c").agg(
        F.max(F.when(F.col("out") == 1, F.col("n"))).alias("leaves"), F.max(F.when(F.col("out") == 0, F.col("n"))).alias("enters"))
    return node.join(met, ["a", "b", "c"]).where("leaves = flow AND enters = flow").select("a", "b", "c")


def passages(found: DataFrame) -> DataFrame:
    """Edges joined across unary nodes: ``a, b, c, d`` of each edge, ``n_words`` of its passage, ``place`` in it from 0, and the passage's
    first edge ``pa, pb, pc, pd``.

    Every edge points to the one before it if a unary node lies between; pointers are doubled each round, so that the rounds are the
    logarithm of the longest passage.  Edges of a ring have no first one; they are left out.
    """
    edge = found.where("d <> 0").select(F.struct(*_KEYS).alias("e"))
    node = unary_nodes(found).select(F.struct("a", "b", "c").alias("node"))
    first = F.struct(*[F.col("e")[x].alias(y) for x, y in zip("abc", "abc")])
    last = F.struct(*[F.col("e")[x].alias(y) for x, y in zip("bcd", "abc")])
    before = edge.select(last.alias("node"), F.col("e").alias("back")).join(node, "node")
    now, _ = stored(edge.withColumn("node", first).join(before, "node", "left").select(
        "e", "back", F.when(F.col("back").isNotNull(), 1).otherwise(0).cast("long").alias("place")), "passages")
    n_edges = max(found.where("d <> 0").count(), 1)
    for _ in range(n_edges.bit_length() + 1):
        onward = now.select(F.col("e").alias("back"), F.col("back").alias("_back"), F.col("place").alias("_place"))
        now, (open_,) = stored(now.join(onward, "back", "left").select(
            "e", F.when(F.col("_back").isNotNull(), F.col("_back")).otherwise(F.col("back")).alias("back"),
            (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"), F.col("_back").isNotNull().alias("_open")), "passages",
            F.count_if("_open"))
        now = now.drop("_open")
        if not open_:
            break
    ring = now.join(now.where("back IS NULL").select(F.col("e").alias("back"), F.lit(True).alias("_first")), "back", "left").where(
        "back IS NULL OR _first")
    head = ring.select("e", F.coalesce("back", "e").alias("p"), "place")
    size = head.groupBy("p").agg((F.max("place") + 4).alias("n_words"))
    return head.join(size, "p").select(
        *[F.col("e")[x].alias(x) for x in _KEYS], "n_words", "place", *[F.col("p")[x].alias(f"p{x}") for x in _KEYS])


def scored(found: DataFrame, covered: int = COVERED, scale: int = SCALE) -> DataFrame:
    """Phrases of two to four words that no longer phrase covers: ``a, b, c, d, n, l, r, score`` of their lowest-scoring cut.

    ``found`` is the table of :func:`graph` with the words themselves, ``b`` 0 there.  Products are decimals, so that they are exact beyond 64 bits.
    """
    wide = "decimal(20,0)"
    phrase = found.where("b <> 0")
    # a unary node is covered by the edge that leaves it: compacted
    phrase = phrase.join(unary_nodes(found).withColumn("d", F.lit(0).cast("long")), _KEYS, "left_anti")
    zero = F.lit(0).cast("long")

    def inner(*words: str) -> Column:
        cells = [F.col(w) for w in words] + [zero] * (4 - len(words))
        return F.struct(*[w.alias(x) for w, x in zip(cells, _KEYS)])

    held = F.when(F.col("d") == 0, F.array(inner("a", "b"), inner("b", "c"))).otherwise(
        F.array(inner("a", "b", "c"), inner("b", "c", "d"), inner("a", "b"), inner("b", "c"), inner("c", "d")))
    longest = found.where("c <> 0").select("n", F.explode(held).alias("p")).groupBy("p").agg(F.max("n").alias("_longer")).select("p.*", "_longer")
    free = phrase.join(longest, _KEYS, "left").where(
        F.col("_longer").isNull() | (F.col("_longer").cast(wide) * 100 < F.col("n").cast(wide) * covered)).select(*_KEYS, "n")
    cuts = free.select(*_KEYS, F.col("n").alias("whole"), F.explode(_parts([F.col(x) for x in _KEYS])).alias("cut"))
    sides = cuts.select(*_KEYS, "whole", "cut.k", F.explode(F.array(
        F.struct(F.lit(True).alias("is_left"), F.col("cut.left").alias("p")), F.struct(F.lit(False).alias("is_left"), F.col("cut.right").alias("p")))).alias("s"))
    flows = found.where("d = 0").select(F.struct("a", "b", "c").alias("p"), "n")
    each = sides.select(*_KEYS, "whole", "k", "s.is_left", "s.p").join(flows, "p").groupBy(*_KEYS, "whole", "k").agg(
        F.max(F.when(F.col("is_left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("n"))).alias("r"))
    value = F.expr(f"CAST({scale} AS DECIMAL(18,0)) * CAST(whole AS {wide}) DIV (CAST(l AS {wide}) + CAST(r AS {wide}))")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r"))
    return each.groupBy(*_KEYS, "whole").agg(best.alias("best")).select(
        *_KEYS, F.col("whole").alias("n"), "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score`` (numbers long).

    ``n`` counts all words of the language, ``a`` the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut.  A null language is
    ``und``; null and empty texts have no words; texts of any length are read whole; repeated rows count again; further columns
    are ignored.  No phrases give no rows.
    """
    if least < 1:
        raise ValueError("phrases occur once at least")
    if covered > 100:
        raise ValueError("no longer phrase occurs more often than one inside it")
    with small_batches(docs.sparkSession):
        words, _ = stored(word_counts(docs), "words")
        seed = _separating_seed(words)
        keyed = words.where(F.col("n") >= least).select(_key(seed).alias("key"), "lang", "word", "n")
        frequent, (n_all,) = stored(keyed, "frequent-words", F.sum("n"))
        hot = [r["key"] for r in frequent.where(F.col("n") * _HOT > n_all).select("key").collect()]  # fewer than _HOT
        phrases, _ = stored(graph(edges(docs, seed, _table(frequent), hot), least), "phrases")
    zero = F.lit(0).cast("long")
    found = phrases.unionByName(frequent.select(F.col("key").alias("a"), *[zero.alias(x) for x in "bcd"], "n"))
    judged = scored(found, covered).join(frequent.select(F.col("key").alias("a"), "lang"), "a")
    order = [F.col("score").desc(), F.col("n").desc()]
    # ties at the end stay until the phrases are spelled out
    first = judged.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= top)
    spelled = first
    for x in _KEYS:
        spelled = spelled.join(frequent.select(F.col("key").alias(x), F.col("word").alias(f"_{x}")), x, "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"_{x}" for x in _KEYS]))
    totals = words.groupBy("lang").agg(F.sum("n").alias("_all"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("_all").alias("n"), "score")
