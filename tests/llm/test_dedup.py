"""SimHash and vector near-duplicates against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from runloom.llm import common, simhash_dedup, vector_dedup


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    step = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + step]).encode(), 42) for i in range(len(words) - step + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "One", "one Two", "a b c", "a b c d", "ÄÖ É é\u00a0x \x1c y\x0bz", "x " * 5000, "a b c a b c a b c"])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


def components_of(ids, linked):
    group = {i: i for i in range(len(ids))}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                group[find(i)] = find(j)
    roots = [find(i) for i in range(len(ids))]
    least = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in roots]


def test_documents(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    base = [rng.choices(words, k=400) for _ in range(6)]
    rows = []
    for i in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i, " ".join(text), "s", "x"))
    rows += [(5, None, None, None), (7, "", "s", "x"), (None, "  ", "s", "x"), (8, "lone", "s", "x"), (8, "lone", "s", "x"), (8, "other words here now", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, fp string")
    prints = [simhash_dedup.fingerprint(r[1]) for r in rows]
    want = components_of([r[0] for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = simhash_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got)) == sorted(
        (r[0] is None, r[0] or 0, f"{p:016x}", c) for r, p, c in zip(rows, prints, want))
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    # one of each group; the two unlinked texts that share id 8 are groups of their own
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*set(want), 8])


def test_long_lists_meet_once(spark):
    rows = [(1, i) for i in range(300)] + [(2, i) for i in range(300, 305)]
    cells = common.dealt(spark.createDataFrame(rows, "key int, id long"), ["key"], "id", 40).collect()
    met = {}
    by = {}
    for r in cells:
        by.setdefault((r["key"], r["_lo"], r["_hi"]), []).append(r)
    for (_, lo, hi), members in by.items():
        for i, a in enumerate(members):
            for b in members[:i]:
                if lo == hi or a["_own"] != b["_own"]:
                    pair = frozenset((a["id"], b["id"]))
                    met[pair] = met.get(pair, 0) + 1
    assert len(met) == 300 * 299 // 2 + 10 and set(met.values()) == {1}
    assert max(map(len, by.values())) < 150


def test_one_bucket_holds_everything(spark, monkeypatch):
    """Fingerprints that all share three of four parts: one list with every row, cut into blocks."""
    rng = random.Random(1)
    values = sorted({rng.randrange(1 << 16) for _ in range(700)})
    signed = [(i, v) for i, v in enumerate(values)]
    monkeypatch.setattr(common, "BLOCK_ROWS", 64)
    prints = spark.createDataFrame([(v,) for _, v in signed], "fp long")
    got = {r.fp: r.root for r in simhash_dedup.groups(prints).collect()}
    want = components_of(values, lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)
    assert [got[v] for v in values] == want


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(399)] + [(1000, 1001), (1001, 1001), (1001, 1000)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(400)}, 1000: 1000, 1001: 1000}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centers[rng.integers(12)] + rng.normal(size=16) * 0.08
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    rows += [
        (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [None] + [1.0] * 15, 1), (2004, [float("nan")] * 16, 1),
        (2005, [float("inf")] + [1.0] * 15, 1), (2006, rows[0][1], None), (2007, rows[0][1], None), (2008, [x * 3 for x in rows[0][1]], rows[0][2]),
        (2009, [1.0, 2.0], 1), (2010, [2.0, 4.0], 1), (2010, [2.0, 4.0], 1), (2011, [1e30, 2e30], 1), (2012, [1e-30, 2e-30], 1),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")

    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if usable(v, b) else None for _, v, b in rows]

    def linked(i, j):
        a, b = unit[i], unit[j]
        return a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and float(a @ b) >= 0.98

    want = components_of([r[0] for r in rows], linked)
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    got = vector_dedup.near_duplicates(frame).collect()
    exact = sorted(zip([r[0] for r in rows], links, want))
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    assert [f[0] for f in found] == [e[0] for e in exact]
    assert all(f[1] <= e[1] for f, e in zip(found, exact))
    assert sum(f[1] for f in found) >= 0.99 * sum(e[1] for e in exact)
    assert found[-60:] == exact[-60:]


def test_group_of_near_copies(spark):
    """A third of the vectors lie around one: every link is found."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 64))
    vectors[:1000] = rng.normal(size=64) + 0.115 * rng.normal(size=(1000, 64))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert 100_000 < links.sum() < 999_000
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(frame).collect()}
    assert [got[i] for i in range(3000)] == links.tolist()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.near_duplicates(docs).collect() == [] and simhash_dedup.keep_one(docs).collect() == []
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
