"""Spelling variants against a plain edit distance."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runloom.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, least_letters=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_letters:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least_count}
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((-counts[x], x) for x in counts if one_apart(w, x))
        if near and -near[0][0] >= 2 * n:
            form[w] = near[0][1]
        out[w] = (n, len(near))
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, n, k, form.get(w), counts.get(form.get(w)), root(w)) for w, (n, k) in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abÉé×ss", k=rng.randint(4, 9))) for _ in range(25)]
    pool = []
    for s in stems:
        for _ in range(6):
            i = rng.randrange(len(s))
            pool.append(rng.choice([s, s, s[:i] + rng.choice("abcé") + s[i + 1:], s[:i] + s[i + 1:], s[:i] + "b" + s[i:]]))
    weight = [rng.choice([1, 1, 2, 5, 40]) for _ in pool]
    rows = [(i, rng.choice([" ", ", ", "1", "_", "\n"]).join(rng.choices(pool, weight, k=rng.choice([0, 3, 60, 200])))) for i in range(60)]
    rows += [(None, "stone Stone STONE stone"), (None, None), (61, None), (62, ""), (3, rows[3][1]), (63, "stones " * 3000), (64, " ".join(["q" * 700, "q" * 699] * 4))]
    return rows


@pytest.mark.parametrize("words, letters", [(1024, 1 << 17), (8, 1 << 17), (16, 200)])
def test_variants(spark, monkeypatch, words, letters):
    """Whatever the size of a bucket; small ones are cut into blocks that meet in pairs."""
    monkeypatch.setattr(spelling, "BUCKET_WORDS", words)
    monkeypatch.setattr(spelling, "BUCKET_LETTERS", letters)
    rows = corpus(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = spelling.variants(docs.repartition(5)).collect()
    want = plain(rows)
    assert len(got) == len(want) > 60 and {tuple(r) for r in got} == want
    assert any(r.root not in (r.word, r.form) for r in got)


def test_near_pairs():
    rng = random.Random(3)
    for m in (1, 2, 3, 5, 8, 30):
        words = list({"".join(rng.choices("abà", k=m + rng.randint(0, 1))) for _ in range(150)})
        queries = [w for w in words if len(w) == m]
        q, w = spelling.near_pairs(queries, words, m)
        got = list(zip(q.tolist(), w.tolist()))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, a in enumerate(queries) for j, b in enumerate(words) if one_apart(a, b)}
    assert [len(x) for x in spelling.near_pairs([], ["a"], 1)] == [0, 0]


def test_short_words(spark):
    words = ["a", "b", "ab", "abc", "c", "ac"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = {r.word: r.n_near for r in spelling.variants(docs, 1, 1).collect()}
    assert got == {w: sum(one_apart(w, x) for x in words) for w in words}


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(37)] + [("x", "w30")], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w37"}


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([(1, "a b 12"), (2, None)], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), times=1)
