"""Main text, urls, languages and personal data."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from runloom.llm import html_text, language_id, personal_data, url_filter


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"),
    ("<article><h1>A</h1><p>b\n  c<br>d &amp;amp; &#233;</article><footer>f</footer>", "A b c d &amp; é"),
    ("<nav><a href=x>menu</a></nav><article><p>text <b>bo</b>ld</p></article>", "text bold"),
    ("<body><div id='sidebar'><p>Side words in a box</p></div><div><p>" + "Long words of the story. " * 9 + "</p></div></body>",
     ("Long words of the story. " * 9).strip()),
    ("<article><p>keep<div class='ad'>buy this now</div><p>also<footer>foot</footer>", "keep also"),
    ("<article><p>a</p><section id='comments'><p>what a nice long comment by a reader</p></section></article>", "a"),
    ("<script>var t='</p>'</script><style>p{}</style><main><p>x<!-- no --> y</p></main><form><label>Name</label></form>", "x y"),
    ("<article><p>one<p>two<script>unclosed", "one two"),
])
def test_main_text(page, text):
    assert html_text.main_text(page)[0] == text


def test_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 8)
        unary = [rng.uniform(-3, 3) for _ in range(n)]
        pairs = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(keep):
            return sum(-min(u, 0) if k else max(u, 0) for u, k in zip(unary, keep)) + sum(w for a, b, w in pairs if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.min_cut(unary, pairs)) - best) < 1e-6


def test_pages(spark):
    rows = [(1, "u", "<p>hello world of words</p>"), (2, None, None), (None, "v", ""), (1, "u", "<p>hello world of words</p>")]
    got = html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == sorted(
        [("1", "hello world of words", 20)] * 2 + [("2", "", 0), ("None", "", 0)])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_page_is_whole():
    text = " ".join(f"word{i}" for i in range(200_000))
    assert html_text.main_text(f"<article><p>{text}</p></article>")[0] == text


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net/y", "x.net", "/y", "net/", "block"),
    ("http://xnet/y", "xnet", "/y", None, "allow"), ("http://net/", "net", "/", "net/", "block"), ("http://x.net?q", "x.net", "", None, "allow"),
    ("a://b.example.com/de/1#f", "b.example.com", "/de/1", "example.com/de/", "block"), ("x://y.org/fr/", "y.org", "/fr/", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"), ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
    ("http://h.example.com/DE/1", "h.example.com", "/DE/1", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    frame = spark.createDataFrame([(1, url, "z")], "page_id long, url string, rule string")
    r = url_filter.classify(frame).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_templates(spark):
    """Below one host, a spam branch of ever new names is one template, and is rejected by its labels."""
    rows = [(i, f"http://h.com/promo/offer-{chr(97 + i % 26)}{chr(97 + i // 26)}x/buy", True if i % 3 else None) for i in range(200)]
    rows += [(1000 + i, f"http://h.com/news/{i}", False if i % 2 else None) for i in range(100)]
    rows += [(2000, "http://h.com/other/1", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = url_filter.classify(frame, rules=(), bad=frame["bad"]).collect()
    assert {(r.template, r.verdict) for r in got} == {
        ("/promo/*/buy", "block"), ("/news/{n}", "allow"), ("/other/{n}", "allow")}
    assert len(got) == len(rows)
    assert url_filter.classify(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_deep_branches(spark):
    """Branches that part at the sixth segment, with a variable one further down, are templates of their own."""
    names = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(100)]
    rows = [(i, f"http://h.com/a/b/c/d/e/{kind}/x/y/{name}/z", kind == "spam") for kind in ("spam", "news") for i, name in enumerate(names)]
    rows += [(2000, "http://h.com/" + "/".join("abcdefghijklmnopqrstuvwxyz"), None), (2001, "http://h.com/a/b/c/d/e", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = url_filter.classify(frame, rules=(), bad=frame["bad"]).collect()
    assert {(r.template, r.verdict) for r in got} == {
        ("/a/b/c/d/e/spam/x/y/*/z", "block"), ("/a/b/c/d/e/news/x/y/*/z", "allow"), ("/" + "/".join("abcdefghijklmnopqrstuvwxyz"), "allow"),
        ("/a/b/c/d/e", "allow")}
    assert len(got) == len(rows)


def test_languages(spark):
    rng = random.Random(1)
    kinds = {"aa": "abcde", "bb": "vwxyzé", "cc": "mnopqü"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(kinds))
        text = " ".join("".join(rng.choices(kinds[lang], k=rng.randint(2, 7))) for _ in range(40))
        rows.append((i, text, lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "", None, None), (902, "12 ...!", "bb", "s"), (None, "abc abc", None, "s"), (0, rows[0][1], rows[0][2], "s")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows[:300])
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    import zlib
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.identify(docs).collect()] == [(1, False, "und", 0.0)]
    assert language_id.identify(docs.limit(0)).collect() == []


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    text = "The quick  brown-fox jumps over ein süßer Hund " * 50
    whole, cut = (np.zeros(language_id.BUCKETS, dtype=np.uint8) for _ in range(2))
    language_id.presence(text, whole)
    monkeypatch.setattr(language_id, "_PIECE", 7)
    language_id.presence(text, cut)
    assert np.array_equal(whole, cut)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choices("ab14111111111111112..@@-+ ()\né", k=rng.randint(0, 45)))
        assert personal_data.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    texts = [
        "mail a.b@c.de or +1 (212) 555-0100, ip 10.0.0.255, card 4111 1111 1111 1111", None, "", "Call (415) 555-0199 tomorrow",
        "the 12 of 1998 - 2004, version 2.0.1 and 3.14", "ab " * 50_000 + "x@y.zz"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[0], "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in personal_data.find(docs).collect()}
    for i, text in enumerate(texts):
        base = plain_spans(text or "")
        listed = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    assert got[3].spans == "phone:5:19" and got[4].spans == "" and got[5].spans == "email:150000:150006" and len(got) == 7


def test_field_is_exact():
    """Viterbi against every labelling of short sequences."""
    import itertools
    field = personal_data.train()
    names = list(field.shapes)
    rng = random.Random(3)
    for _ in range(5):
        shapes = rng.choices(names, k=4)
        score = field.emissions(field.numbers([shapes]))[0]

        def total(y):
            return sum(score[t, b] for t, b in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])) - 1e9 * (y[0] > 0 and y[0] % 2 == 0)

        best = max(itertools.product(range(score.shape[1]), repeat=4), key=total)
        assert total(tuple(field.decode([shapes])[0])) == pytest.approx(total(best))


def test_field_learned_its_lines():
    field, lines = personal_data.train(), personal_data._examples(99)
    right = sum((found == labels).all() for found, (_, labels) in zip(field.decode([e for e, _ in lines]), lines))
    assert right >= 0.97 * len(lines)


def test_spans_of_a_long_sequence():
    """A table of numbers in one sequence of thousands of tokens, with phone numbers at every offset to any cut."""
    field = personal_data.train()
    for pad in range(9):
        text, want = "row 17, " * (680 + pad) + "x " * pad, []
        for _ in range(3):
            for i in range(160):
                text += f"row {i}, " + "y " * (i % 3)
            text += "call "
            want.append((len(text), len(text) + 14))
            text += "(415) 555-0199 tomorrow. "
        for cut in range(2038, 2050):  # and one over each place near the cut before
            line = "row 17, " * (cut // 3) + "y " * (cut % 3) + "call (415) 555-0199 tomorrow"
            at = line.index("(415)")
            assert (at, 3, at + 14) in personal_data.added_spans([line], [[]], field)[0]
        assert {(a, 3, b) for a, b in want} <= set(personal_data.added_spans([text], [[]], field)[0])


def test_decoding_in_pieces(monkeypatch):
    field = personal_data.train()
    names, rng = list(field.shapes), random.Random(8)
    sequences = [rng.choices(names, k=k) for k in (0, 1, 5, 7, 8, 50, 51, 300)]
    whole = field.decode(sequences)
    monkeypatch.setattr(personal_data, "_LONGEST", 7)
    monkeypatch.setattr(personal_data, "_LANES", 3)
    assert all((a == b).all() and len(a) == len(s) for a, b, s in zip(whole, field.decode(sequences), sequences))
