"""The queries op1_... to op10_... and the SQL that some of them can be held against.

Each takes (spark, sf_dir), gives its operator the whole table and derives the columns that were agreed on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.llm import bpe, langid, lm, neardup, packing, quality_rules, repeats, topk, toxicity, warc
from densika.llm.common import cut, drop_folder, held_out, read, shared_folder

WORD_BPE = "word_bpe_49k.json"


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model, tail = lm.learn(docs.where(~held_out("doc_id", 5, 1)))
    return lm.score(docs, model, tail).withColumn("held_out", held_out("doc_id", 5, 1))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    models = toxicity.learn(docs, labels, "doc_id", "text", "toxic", ~held_out("id", 4, 2), toxicity.SAMPLE)
    return toxicity.score(docs, models).withColumn("held_out", held_out("doc_id", 4, 2))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_BPE))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=85)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs, "doc_id", "text", "lang", ~held_out("id", 3, 1))
    return langid.predict(docs, model).withColumn("held_out", held_out("doc_id", 3, 1))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, "vec_id", "embedding", k=5, scale=256.0)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), length=50)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_BPE))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(read(spark, sf_dir, "pages", "page_id", "url", "html"), folder, "page_id", "url", "html")
    found = cut(warc.read(spark, folder).select(
        warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), warc.page_id("refers_to").alias("refers_to"),
    ))
    drop_folder(spark, folder)
    return found


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).drop("clean_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_neardup": op4_neardup,
    "op5_langid": op5_langid,
    "op6_topk": op6_topk,
    "op7_repeats": op7_repeats,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
}


def _quoted(pattern: re.Pattern) -> str:
    return pattern.pattern.replace("'", "''")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op4_neardup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (
            SELECT doc_id AS root, doc_id AS id FROM documents
            UNION SELECT r.root, sym.b FROM reach r JOIN sym ON sym.a = r.id AND sym.b > r.root
        )
        SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = r.id AS kept
        FROM reach r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
    """,
    "op7_repeats": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        blocks AS (  -- of 512 windows, so that no long text is walked for each of its windows
            SELECT doc_id, t.b, len(x) // 2 - 49 - 512 * t.b AS rest, substr(x, CAST(1024 * t.b + 1 AS BIGINT), 1122) AS y
            FROM h, unnest(range(0, greatest(len(x) // 2 - 49 + 511, 0) // 512)) t(b)
        ),
        win AS (SELECT doc_id, 512 * b + t.j AS i, substr(y, CAST(2 * t.j + 1 AS BIGINT), 100) AS w FROM blocks, unnest(range(0, least(rest, 512))) t(j)),
        m AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w),
        hit AS (SELECT doc_id, i FROM win JOIN m USING (w) WHERE least < doc_id),
        f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS f FROM hit),
        g AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
        span AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
        piece AS (SELECT span.*, x, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span JOIN h USING (doc_id)),
        k AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
                   string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a)
                   || substr(any_value(x), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
            FROM piece GROUP BY doc_id
        )
        SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM h LEFT JOIN k ON k.doc_id = h.doc_id
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                   CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op10_quality": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT d.k, u.w, u.i FROM d, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) WITH ORDINALITY u(w, i)),
        v AS (SELECT k, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
        c AS (SELECT k, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY k, w, w2, w3) > 1 AS often FROM v),
        r AS (SELECT k, w, often OR coalesce(lag(often) OVER o, false) OR coalesce(lag(often, 2) OVER o, false) AS again FROM c WINDOW o AS (PARTITION BY k ORDER BY i)),
        n AS (SELECT k, count(*) AS n_words, CAST(sum(len(w)) AS BIGINT) AS word_chars, count(*) FILTER (again) AS n_repeat_words FROM r GROUP BY k),
        l AS (SELECT d.k, u.l, u.i FROM d, unnest(string_split(t, chr(10))) WITH ORDINALITY u(l, i)),
        x AS (SELECT k, i, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws FROM l),
        y AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY k, l ORDER BY i) > 1 AS dup FROM x WHERE len(ws) > 0),
        z AS (
            SELECT k, i, n, dup, dup
                OR (n > 1 AND 3 * len(list_filter(ws, lambda q: q IN ('|', '>', '»', '•', '·', '/'))) >= n)
                OR (n <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(l, '(?i){_quoted(quality_rules.BOILERPLATE)}'))
                OR 2 * len(regexp_extract_all(l, '[#*$%&|<>]')) >= n
                OR (n >= 3 AND regexp_matches(l, '\p{{Lu}}') AND NOT regexp_matches(l, '\p{{Ll}}'))
                OR (n >= 4 AND 3 * len(list_filter(range(1, n), lambda j: ws[j] = ws[j + 1])) >= n)
                OR NOT (regexp_matches(l, '{_quoted(quality_rules.SENTENCE_END)}')
                    OR (n > {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(l, '{_quoted(quality_rules.SENTENCE)}'))) AS bad
            FROM y
        ),
        b AS (
            SELECT k, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed,
                   CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS n_words_removed
            FROM z GROUP BY k
        ),
        cleaned AS (
            SELECT x.k, sha256(coalesce(string_agg(x.l, chr(10) ORDER BY x.i) FILTER (NOT coalesce(z.bad, false)), '')) AS clean_sha256
            FROM x LEFT JOIN z ON z.k = x.k AND z.i = x.i GROUP BY x.k
        ),
        a AS (
            SELECT doc_id, clean_sha256, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed,
                   coalesce(n_words_removed, 0) AS n_words_removed
            FROM d LEFT JOIN n USING (k) LEFT JOIN b USING (k) LEFT JOIN cleaned USING (k)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_removed <= n_words AS kept
        FROM a
    """,
}
