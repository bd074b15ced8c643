"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runloom.llm import (
    collocations, contamination, html_text, language_id, mixing, packing, personal_data, shards, simhash_dedup, spelling, token_files,
    url_filter, vector_dedup,
)
from runloom.llm.common import table


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.classify(table(spark, folder, "pages"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op4_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find(table(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    written = token_files.write(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, written)


def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.manifest(table(spark, folder, "documents"))


def op10_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = contamination.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.digest(spark, packing.write(table(spark, folder, "documents"), vocabulary), vocabulary)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_html_text, op2_url_filter, op3_language_id, op4_vector_dedup, op5_simhash_dedup, op6_mixing, op7_personal_data, op8_token_files, op9_shards, op10_contamination,
    op11_packing, op12_spelling, op13_collocations)}

ORACLE_SQL = {
    "op4_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x for x in embedding if x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (
            SELECT vec_id AS id, vec_id AS other FROM embeddings
            UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
        least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
    """,
    "op10_contamination": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        v AS (
            SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
        i AS (
            SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, greatest(len(w) - 3, 2))]) AS s
            FROM v WHERE len(w) > 0),
        k AS (SELECT DISTINCT least(len(w), 5) AS k FROM v WHERE len(w) > 0),
        d AS (
            SELECT DISTINCT doc_id, hash(w) AS h, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
            FROM w, k WHERE len(w) >= k),
        n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS item_shingles, count(*) / any_value(n) AS containment
        FROM d JOIN i USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, h, item_id HAVING count(*) >= 0.8 * any_value(n)
    """,
    "op12_spelling": r"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS run
            FROM documents),
        each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
        crc_table AS (SELECT [list_reduce(
            [i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                [4294967295] || flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END
                    FOR x IN string_split(concat(doc_id, ':', run), '')]),
                lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
            FROM each, crc_table),
        v AS (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS (
            SELECT DISTINCT word, length(word) AS len, i, word[:i - 1] || word[i + 1:] AS s
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (
            SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.len = b.len AND a.word <> b.word
            UNION SELECT a.word, b.word FROM cut a JOIN v b ON a.s = b.word
            UNION SELECT b.word, a.word FROM cut a JOIN v b ON a.s = b.word),
        best AS (
            SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, encode(other))) AS other, max(o.n) AS other_n
            FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
        form AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
                CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
            FROM v LEFT JOIN best USING (word)),
        path AS (
            SELECT word, word AS root, 0 AS depth FROM form
            UNION ALL SELECT path.word, form.form, depth + 1 FROM path JOIN form ON form.word = path.root WHERE form.form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, depth) AS root FROM path GROUP BY word)
        SELECT word, n, n_near, form, form_n, root FROM form JOIN ends USING (word)
    """,
    "op13_collocations": r"""
        WITH text AS (
            SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        piece AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM text),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
        gram AS (
            SELECT lang, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g
            FROM w, (SELECT unnest([1, 2, 3, 4])::INT AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, g, count(*) AS n FROM gram GROUP BY ALL HAVING count(*) >= 30),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        cut AS (SELECT *, unnest(range(1, k)) AS cut_at FROM f WHERE k > 1),
        score AS (
            SELECT c.lang, c.k, c.g, c.n AS a, x.n AS l, y.n AS r, (2000000::HUGEINT * c.n // (x.n + y.n))::BIGINT AS score, c.cut_at
            FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.g[:c.cut_at] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.cut_at + 1:]),
        low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut_at) = 1),
        inner_part AS (
            SELECT lang, n, unnest([g[i:i + s - 1] FOR i IN range(1, k - s + 2)]) AS g
            FROM f, (SELECT unnest([2, 3])::INT AS s) WHERE s < k),
        longer AS (SELECT lang, g, max(n) AS n FROM inner_part GROUP BY ALL),
        kept AS (
            SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.g = low.g
            WHERE longer.n IS NULL OR 100::HUGEINT * longer.n < 80::HUGEINT * a),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
                array_to_string(g, ' ') AS phrase, a, l, r, score
            FROM kept)
        SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}
