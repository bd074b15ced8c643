"""Packing by powers of two, and the ids it packs, against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm import packing, piece_ids

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_whole_texts(path):
    rng = random.Random(5)
    latin = [chr(c) for c in range(256)] + ["  ", "\n\n", " ", " ", "'s", "'ll", "the", "The", "DON'T"] * 8
    wide = latin + [chr(c) for c in [*range(0x100, 0x250), *range(0x300, 0x320), *range(0x380, 0x400), 0x1E9E, 0x2028, 0x3000, 0x4E00, 0x1F600]]
    texts = ["", " ", "\n", "a ", " a", "a  b", "a \n b", "x<|endoftext|>y", "word, " * 500, "\x1c a\x85b", "e\u0301", "\u0391\u03a3"]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 25))) for pool in (latin, wide) for _ in range(3000)]
    library = Tokenizer.from_file(path)
    code = piece_ids.of_file(path).of
    for text in texts:
        assert code(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_kinds_of_tokenizers():
    assert piece_ids.of_file(BYTES).of("a\ud800").tolist() == piece_ids.of_file(BYTES).of("a?").tolist()


def test_lengths():
    for n in [*range(0, 70), 2047, 2048, 2049, 4097, 123457]:
        for longest in (1, 16, 2048):
            got = packing.lengths(n, longest)
            assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= longest for x in got)
            assert len({x for x in got if x < longest}) == len([x for x in got if x < longest])


def test_packed_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, null ids, clashing columns; a third of the rows share one id."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["stone", "Water", "et", "été", "a.\nB"], k=rng.choice([0, 1, 7, 300])))) for i in range(60)]
    rows += [(None, "no id"), (None, None), (70, None), (71, ""), (72, "long " * 30_000), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(5, f"hot {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("ids", F.lit(1)).repartition(5)
    folder = packing.write(docs, BYTES, str(tmp_path / "packed"))
    pieces = spark.read.parquet(folder).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and min(p.sequence_id for p in pieces) >= 0
    in_order = [p.length for p in sorted(pieces, key=lambda p: p.sequence_id)]
    assert in_order == sorted(in_order, reverse=True)
    library = Tokenizer.from_file(BYTES)
    whole = sorted(([*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows), key=len)
    # a document's pieces are one task's, one after the other
    found, held = [], []
    tasks = {}
    for p in pieces:
        tasks.setdefault(p.sequence_id >> 35 & (1 << 24) - 1, []).append(p)
    for task in tasks.values():
        for p in task:
            assert p.start == len(held) and len(p.ids) == 2 * p.length
            held = held + np.frombuffer(p.ids, dtype="<u2").tolist()
            if len(held) == p.doc_tokens:
                found.append(held)
                held = []
    assert held == [] and sorted(found) == sorted(whole)
    digest = packing.digest(spark, folder, BYTES).collect()
    by_id = {p.sequence_id: p for p in pieces}
    for r in digest:
        p = by_id[r.sequence_id]
        ids = np.frombuffer(p.ids, dtype="<u2").astype("<u4")
        assert (r.doc_id, r.start, r.length, r.doc_tokens, r.offset) == (p.doc_id, p.start, p.length, p.doc_tokens, 0)
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
    sizes = {b.length: b for b in packing.buckets(spark.read.parquet(folder)).collect()}
    assert sum(b.n_sequences * b.length for b in sizes.values()) == sum(map(len, whole))
    again = packing.digest(spark, packing.write(docs, BYTES), BYTES)
    assert sorted(map(str, again.drop("sequence_id").collect())) == sorted(str(r) for r in packing.digest(spark, folder, BYTES).drop("sequence_id").collect())


def test_nothing_and_wrong_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.digest(spark, packing.write(none, BYTES), BYTES).collect() == []
    with pytest.raises(ValueError):
        packing.packed(none, BYTES, 100)
    short = packing.packed(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), BYTES, 4).collect()
    assert [(r.start, r.length) for r in short] == [(0, 4), (4, 4)]
