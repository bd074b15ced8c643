"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import collocations


def pieces(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def plain_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    return counts, total


def plain(rows, least, top, covered=80):
    counts, total = plain_counts(rows)
    kept = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    found = {}
    for p, a in kept.items():
        lang, words = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * n >= covered * a
               and any(q[1:][i:i + len(words)] == words for i in range(len(q) - len(p) + 1)) for q, n in kept.items()):
            continue
        cuts = [(2_000_000 * a // (counts[lang, *words[:k]] + counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
            for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "Tree", "baum", "é", "x y", "�", "$$", "a'b", *[f"w{i}" for i in range(20)]]
    weight = [9, 7, *[1] * (len(words) - 2)]
    passage = "all men are born free and equal in dignity"
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "de", None, "und", ""])
        parts = rng.choices(words, weight, k=rng.choice([0, 1, 2, 3, 5, 60]))
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice([passage, "the the the the the", "round and round and round", ". New York ,", "\t", "!\n"]))
        rows.append((lang, rng.choice([" ", "  ", " \t"]).join(parts)))
    return rows + [("en", None), (None, None), ("de", ""), ("en", " . , "), ("xx", "one word"), ("en", "the of " * 4000), rows[0], rows[0]]


@pytest.mark.parametrize("seed, least, top, positions, words, hot, rows_at_once", [
    (1, 5, 2000, 1 << 20, 1 << 18, 500, 1 << 17), (2, 2, 40, 50, 3, 10**6, 7), (3, 12, 7, 500, 30, 20, 100)])
def test_collocations(spark, monkeypatch, seed, least, top, positions, words, hot, rows_at_once):
    for name, value in (("_POSITIONS", positions), ("_WORDS", words), ("_HOT", hot), ("_ROWS", rows_at_once)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("x")).withColumn("a", F.lit(0)).repartition(4)
    got = sorted((tuple(r) for r in collocations.collocations(docs, least, top).collect()), key=lambda r: r[:2])
    want = sorted(plain(rows, least, top), key=lambda r: r[:2])
    assert len(want) > 20 and got == want


def test_counts_from_flows(spark):
    """All phrases of two to four words that are frequent, and only those, with their exact counts."""
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = collocations.word_counts(docs).where("n >= 4")
    key = collocations._key(0)
    spelled = {r.key: (r.lang, r.word) for r in words.select(key.alias("key"), "lang", "word").collect()}
    table = collocations._table(words.select(key.alias("key")))
    got = {}
    hot = [k for k, w in spelled.items() if w[1] in ("the", "of")]
    for r in collocations.graph(collocations.edges(docs, 0, table, hot), 4).collect():
        parts = [spelled[k] for k in r[:4] if k]
        assert {lang for lang, _ in parts} == {parts[0][0]}
        got[parts[0][0], *[w for _, w in parts]] = r.n
    counts, _ = plain_counts(rows)
    assert got == {p: n for p, n in counts.items() if n >= 4 and len(p) > 2}


def test_passages(spark):
    """Repeated passages come out whole; where ways part or runs end they are cut; a ring has no beginning."""
    text = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g h", "r s t r s t r s t", "p q r1 s1 t1", "p q r1 s1 u1 v1"] * 2
    docs = spark.createDataFrame([("x", t) for t in text], "lang string, text string")
    words = collocations.word_counts(docs)
    spelled = {r.key: r.word for r in words.select(collocations._key(0).alias("key"), "word").collect()}
    found = collocations.graph(collocations.edges(docs, 0, collocations._table(words.select(collocations._key(0).alias("key")))), 2)
    got = {}
    for r in collocations.passages(found).collect():
        got.setdefault((" ".join(spelled[x] for x in (r.pa, r.pb, r.pc, r.pd)), r.n_words), []).append((r.place, " ".join(spelled[x] for x in r[:4])))
    assert sorted(got["a b c d", 8]) == [(0, "a b c d"), (1, "b c d e"), (2, "c d e f"), (3, "d e f g"), (4, "e f g h")]
    assert sorted(k for k in got if k[0].startswith("p") or k[0].startswith("q")) == [("p q r1 s1", 4), ("q r1 s1 t1", 4), ("q r1 s1 u1", 5)]


def test_one_run_of_very_many_words():
    keys = np.append(np.arange(1, 70_001, dtype=np.uint64) << np.uint64(40), np.uint64(0))
    for times in (1, 2):
        found, n = collocations._counted(np.concatenate([keys] * times))
        assert len(found) == len(n) and (n >= 1).all() and int(n.sum()) == times * (70_000 - 3 + 2)
        assert (found[:, :2] != 0).all() and int(n[found[:, 3] == 0].sum()) == 2 * times and int(n[found[:, 2] == 0].sum()) == times


def test_a_seed_that_separates(spark, monkeypatch):
    words = spark.createDataFrame([("x", "a"), ("x", "b")], "lang string, word string")
    real = collocations._key
    monkeypatch.setattr(collocations, "_key", lambda seed: F.lit(5).cast("long") if seed < 2 else real(seed))
    assert collocations._separating_seed(words) == 2
    monkeypatch.undo()
    key = words.select(real(3)).first()[0] & (1 << 64) - 1
    assert collocations._WordKeys(collocations._language_seed(3, "x"), np.full(1 << 23, 255, dtype=np.uint8))[b"a"] == key


def test_nothing(spark):
    for rows in ([], [("en", None), (None, " . ")], [("en", "a b c")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "lang string, text string"), covered=101)
