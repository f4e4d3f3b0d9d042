"""One query for each operator of this folder, over whole tables, and DuckDB SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prioscope.llm import (
    arc_to_warc, embedding_dedup, line_dedup, mixing, packing, periodic_runs, quality, sharding, simhash_dedup,
    spelling_variants, topk_search, toxicity, url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_all(table(spark, sf_dir, "embeddings"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_classes(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.archived(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), spelling_variants.VariantConfig(slip=97))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_repetition(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_url_filters, op3_topk_search, op4_embedding_dedup, op5_sharding,
        op6_simhash_dedup, op7_packing, op8_mixing, op9_quality, op10_line_dedup,
        op11_arc_to_warc, op12_spelling_variants, op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op3_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.w, b.w) >= 0.95
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(d.n, 0) AS n_links, t.component_id, v.vec_id = t.component_id AS kept
        FROM v JOIN least t ON v.vec_id = t.a LEFT JOIN degree d ON v.vec_id = d.a""",
    "op10_line_dedup": r"""
        WITH line AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM documents
        ), own AS (
            SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place
            FROM line WHERE regexp_matches(line, '[^ \t\r\f\x0b]')
        ), win AS (
            SELECT doc_id, place, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS three
            FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY place)
        ), later AS (
            SELECT doc_id, place FROM win WHERE three IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY three ORDER BY doc_id, place) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, place + k AS place FROM later, (VALUES (0), (1), (2)) t(k)
        ), marked AS (
            SELECT l.doc_id, l.line, l.i, g.place IS NOT NULL AS gone
            FROM line l LEFT JOIN own o ON l.doc_id = o.doc_id AND l.i = o.i
            LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.place = g.place
        )
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
               CAST(count(*) FILTER (gone) AS INTEGER) AS removed_lines
        FROM marked GROUP BY doc_id""",
    "op11_arc_to_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
            FROM pages
        ), q AS (
            -- five hexadecimal digits are four of base 32
            SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1, 1)),
                'string_agg', '') AS payload_digest
            FROM p
        ), r AS (
            SELECT *, max(page_id) OVER w AS last, row_number() OVER (w ORDER BY page_id DESC NULLS LAST) AS n FROM q
            WINDOW w AS (PARTITION BY payload_digest, payload_bytes)
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n > 1 THEN last END AS refers_to
        FROM r""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t
            FROM range(256) r(n)
        ), own AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w
            FROM documents
        ), counted AS (
            SELECT doc_id, w, count(*) AS n FROM own GROUP BY ALL
        ), hashed AS (
            SELECT w, n, xor(4294967295, list_reduce(
                list_transform(range(octet_length(encode(k))), lambda i: CAST('0x' || substr(hex(encode(k)), 2 * i + 1, 2) AS BIGINT)),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT))) AS h
            FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k FROM counted), crc
        ), words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word,
                   CAST(sum(n) AS BIGINT) AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
        ), less AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
            UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word
        ), chosen AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
                   CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word
        ), path(word, last, step) AS (
            SELECT word, form, 1 FROM chosen WHERE form IS NOT NULL
            UNION ALL SELECT p.word, c.form, p.step + 1 FROM path p JOIN chosen c ON p.last = c.word WHERE c.form IS NOT NULL
        ), ends AS (SELECT word, arg_max(last, step) AS root FROM path GROUP BY word)
        SELECT c.word, c.form, coalesce(e.root, c.word) AS root, c.n, c.n_near, c.form_n
        FROM chosen c LEFT JOIN ends e ON c.word = e.word""",
}
