"""Mixing, token files, shards, decontamination and the pipeline against brute force."""

from __future__ import annotations

import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runloom.llm import common, contamination, language_id, mixing, piece_ids, queries, shards, simhash_dedup, token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, seed=1, n=120):
    """Documents with a hot source, nulls, empty and long texts, copies and a repeated row."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, "ab"])
        rows.append((i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200]))), "xx", source, 0))
    rows += [(n, None, "xx", "a", None), (n + 1, "", None, "b", 0), (n + 2, " \n", "xx", None, 0), (n + 3, "x " * 9000, "xx", "b", 0),
             (None, "no id here", "xx", "a", 0), (3, rows[3][1], *rows[3][2:]), (n + 4, rows[3][1], *rows[3][2:])]
    return rows, spark.createDataFrame(rows, DOCS)


def plain_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + plain_size(r[1])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            return size, {s: 2.0 * size[s] if s in full else level * weight[s] for s in order}
        full |= over


def test_mix(spark):
    rows, docs = made(spark)
    size, target = plain_targets(rows)
    got = mixing.mix(docs.withColumn("target", docs["doc_id"])).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((r[0] is None, r[0], plain_size(r[1])) for r in rows)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_order_and_nothing(spark):
    rows, docs = made(spark)
    mixed = mixing.mixed(docs)
    finish = [r.finish for r in mixed.collect()]
    assert finish == sorted(finish) and 0 < finish[0] and finish[-1] <= 1
    assert mixed.columns == [*docs.columns, "finish"]
    assert mixing.mix(docs.limit(0)).collect() == []
    empty = docs.where("text IS NULL OR trim(text) = ''")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(empty).collect())
    assert mixing.mixed(empty).collect() == []


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", None, "k"]), i, rng.randint(0, 9)) for i in range(500)]
    got = common.running_total(spark.createDataFrame(rows, "k string, i long, v long").repartition(6), ["k"], ["i"], "v", "before", "t").collect()
    total, want = {}, {}
    for k, i, v in rows:
        want[i] = total.get(k, 0)
        total[k] = total.get(k, 0) + v
    assert {r.i: r.before for r in got} == want


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_huffman(limit):
    rng = np.random.default_rng(limit)
    counts = (rng.pareto(0.4, 14) * 10 + 1).astype(np.int64)
    counts[3] = 0
    lengths = token_files.code_lengths(counts, limit)
    assert lengths[3] == 0 and lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) == 1
    if limit == 20:  # no shorter than Huffman's own
        import heapq
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((counts * lengths).sum()) == cost
    ids = rng.choice(np.flatnonzero(counts), 5000)
    codes, _ = token_files.canonical(lengths)
    bits, offsets = token_files.encode(ids, codes, lengths)
    assert np.array_equal(token_files.decode(bits, offsets, len(ids), *token_files.decoding_table(lengths)), ids)


def test_one_id_and_none():
    for ids in (np.array([5] * 9), np.zeros(0, dtype=np.int64)):
        lengths = token_files.code_lengths(np.bincount(ids, minlength=7))
        bits, offsets = token_files.encode(ids, token_files.canonical(lengths)[0], lengths)
        assert np.array_equal(token_files.decode(bits, offsets, len(ids), *token_files.decoding_table(lengths)), ids)


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x340), *range(0x370, 0x400), 0x130, 0x2028, 0x3000, 0x85, 0xA0, 0x1E9E, 0x4E00, 0x1F600, 0x660]]
    pool += ["'s", "'S", "'LL", " ", "\n", "<|endoftext|>", "<|startoftext|>"] * 6
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(4000)] + ["", "word " * 3000]
    for whole, parts in zip(token_files.encode_whole(TOKENIZER, texts), token_files.encode_by_piece(TOKENIZER, texts)):
        assert np.array_equal(whole, parts)


def test_recent_table_forgets_and_stays_right():
    table = piece_ids._Recent(3, lambda k: k * 2)
    assert [table[k] for k in "abcabcdefgabcg"] == [k * 2 for k in "abcabcdefgabcg"] and len(table) <= 3


def test_token_files_of_one_hot_id(spark):
    """A third of the rows without an id, and one very long text: no file holds all of an id, and nothing is lost."""
    rng = random.Random(8)
    rows = [(None if i % 3 else i, " ".join(rng.choices(["ab", "cde", "f", "é"], k=8))) for i in range(3000)] + [(7, "word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # these are small enough for one task
    kept = token_files.tokenized(docs.repartition(8), TOKENIZER)
    spark.conf.set(coalesce, before)
    files = {}
    for r in kept.select("file", "doc_ids").collect():
        files[r.file] = files.get(r.file, 0) + sum(d is None for d in r.doc_ids)
    assert sum(files.values()) == 2000 and max(files.values()) < 1200
    got = token_files.read(spark, token_files.write(docs, TOKENIZER)).collect()
    assert len(got) == 3001 and max(r.n_tokens for r in got) == 200_001
    assert {r.start for r in got} == {0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()}


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    rows, docs = made(spark)
    got = token_files.read(spark, token_files.write(docs, TOKENIZER), digest=False).collect()
    found = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is not None for r in found] == sorted(r.doc_id is not None for r in found)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for row, ids in zip(order, token_files.encode_whole(TOKENIZER, [r[1] or "" for r in order])):
        ids = [*ids.tolist(), 1]
        want.append((row[0] or -1, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got) == sorted(want)
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id or -1 for r in found] == sorted(r.doc_id or -1 for r in found)
    assert token_files.read(spark, token_files.write(docs.limit(0), TOKENIZER)).collect() == []


def test_shards(spark):
    rows, docs = made(spark)
    for wide in (1 << 20, 700):
        got = shards.shuffled(docs.withColumn("shard", docs["doc_id"]), 7, wide).collect()
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(i, [])) for i in range(7)]
        assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
        assert sorted(map(str, [(r.doc_id, r.text, r.source) for r in got])) == sorted(map(str, [(r[0], r[1], r[3]) for r in rows]))
        again = shards.shuffled(docs.repartition(5), 7, wide).collect()
        assert sorted(map(str, [(r.doc_id, r.shard) for r in got])) == sorted(map(str, [(r.doc_id, r.shard) for r in again]))
    few = shards.manifest(docs.limit(3)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert shards.manifest(docs.limit(0)).collect() == []


def test_manifest_columns(spark):
    rows, docs = made(spark)
    by = sorted((str(r.doc_id), r["size"], r.text_crc32) for r in shards.manifest(docs).collect())
    assert by == sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_contained(docs, items):
    def shingles(text):
        w = plain_words(text)
        return {tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}

    def own_shingles(text):
        n = len(plain_words(text))
        return {s for s in shingles(text) if len(s) == min(n, 5)}

    own = {i: own_shingles(t) for i, t in items}
    out = set()
    for doc, text in docs:
        have = shingles(text)
        for item, need in own.items():
            if need and len(need & have) >= 0.8 * len(need):
                out.add((doc, item, len(need & have), len(need)))
    return out


def test_short_items(spark):
    """Items of fewer than five words are held where all their words stand in a row."""
    items = [(1, "What is the capital?"), (2, "yes"), (3, "of the"), (4, "one two three four five six"), (5, " "), (6, None)]
    docs = [(1, "Q: what is the capital now please"), (2, "what is the big capital of the land"), (3, "Yes."), (4, "one two three four five six"),
            (5, "one two three"), (6, None), (7, "the of")]
    got = contamination.contained(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == {(1, 1, 1, 1), (3, 2, 1, 1), (2, 3, 1, 1), (4, 4, 2, 2)}


def test_language_stage_without_languages(spark):
    rows, docs = made(spark)
    kept = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert len(kept) == sum(any(c.isalpha() for c in r[1] or "") for r in rows) > 100


def test_mixed_keeps_sources_apart(spark):
    """Rows with one id and text in two sources are read as what they are."""
    rows = [(i, "a b c d", "xx", s, 0) for i in range(40) for s in ("p", "q")] + [(100 + i, "w " * 50, "xx", "r", 0) for i in range(40)]
    read = {}
    for r in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect():
        read[r.source] = read.get(r.source, 0) + 1
    plan = {}
    for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect():
        plan[r.source] = plan.get(r.source, 0) + sum(2 * x >= r.size > 0 and x > 0 for x in r.reads)
    assert read == plan and min(read.get("p", 0), read.get("q", 0)) > 0


def test_contained(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 8, 30, 60, 300])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "too few words"), (103, items[4][1]), (103, items[5][1])]
    docs = []
    for i in range(150):
        text = rng.choices(words, k=rng.choice([3, 50, 800]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            part = rng.choice(items[:60])[1].split()
            cut = part[: max(1, int(len(part) * rng.choice([1, 1, 0.9, 0.84, 0.8, 0.7])))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = cut
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(500, " . ".join(t.upper() for _, t in items if t)), (501, None), (502, ""), (None, items[3][1]), (3, docs[3][1]), (503, " ".join(rng.choices(words, k=50_000)) + " " + items[2][1])]
    # an item id with two texts counts each text by itself
    single = [(i, t) for i, t in items if i != 103]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    got = contamination.contained(frame, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")).collect()
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got if r.item_id != 103} == plain_contained(docs, single)
    assert {(r.doc_id, r.item_shingles) for r in got if r.item_id == 103} == {
        (d, n) for t in (items[4][1], items[5][1]) for d, _, _, n in plain_contained(docs, [(103, t)])}
    bad = {d for d, *_ in plain_contained(docs, single)}
    kept = contamination.drop_contaminated(frame, spark.createDataFrame(single, "item_id long, text string"))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained(frame, nothing).collect() == [] and contamination.drop_contaminated(frame, nothing).count() == len(docs)
    assert contamination.contained(frame.limit(0), nothing).collect() == []


def test_stages(spark, tmp_path):
    """Each stage against what it should keep, on rows with planted cases."""
    rows, _ = made(spark, n=80)
    item = " ".join(f"bench{i}" for i in range(40))
    rows += [(900, "start " + item + " end", "xx", "b", 0), (901, "12 34 ...", "xx", "b", 0), (902, rows[7][1] + "", "xx", "Z", 0)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], DOCS + ", score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        before, after = now.collect(), out.collect()
        if name == "language":
            assert ids(out) == sorted(str(r.doc_id) for r in before if re.search(r"[^\W\d_]", r.text or ""))
        elif name == "near_duplicates":
            prints = {(r.doc_id, r.text): simhash_dedup.fingerprint(r.text) for r in before}
            keep = []
            for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
                if all((prints[r.doc_id, r.text] ^ prints[k.doc_id, k.text]).bit_count() > 3 for k in keep):
                    keep.append(r)
            assert ids(out) == sorted(str(r.doc_id) for r in keep)
        elif name == "decontamination":
            assert ids(out) == sorted(str(r.doc_id) for r in before if r.doc_id != 900) and any(r.doc_id == 900 for r in before)
        elif name == "mixing":
            source = {r.doc_id: r.source for r in before}
            size, target = plain_targets([(r.doc_id, r.text, r.lang, r.source) for r in before])
            taken = {}
            for r in after:
                taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + plain_size(r.text)
            longest = {}
            for r in before:
                longest[r.source] = max(longest.get(r.source, 0), plain_size(r.text))
            assert all(abs(taken.get(s, 0) - t) <= longest[s] / 2 + 1 for s, t in target.items())
        else:
            assert len(after) == len(before) and out.columns == [*now.columns, "shard", "slot"]
            break
        assert out.columns == docs.columns and {r.score for r in after} == {"kept"}
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, folder).count() == now.count()
    assert language_id.UNKNOWN == "und"


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_rows_of_queries(spark, name):
    """One row for each row of the table, or the pairs found."""
    table = "pages" if name[:4] in ("op1_", "op2_") else "embeddings" if name.startswith("op4_") else "documents"
    got = queries.QUERIES[name](spark, FOLDER).count()
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert got == rows or name.startswith("op10_")
