"""Queries of the corpus operators over the driver's tables: one ``opN_<name>`` for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import host_rules, license_scan, line_dedup, mixing, ngram_join, packing, ppm_language, repair, site_quality, topk_search
from quillstone.session import numbered, read_table


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = site_quality.scores(numbered(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))
    return judged.withColumnRenamed("id", "doc_id").drop("row")


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return left.select("doc.doc_id", "text", F.size("spans").cast("long").alias("n_removed"), "spans")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "copy_of", "n_copies", "n_links", "kept")


def op5_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = repair.round_trip(spark, read_table(spark, sf_dir, "documents"))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").where(topk_search.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk_search.quantised(F.col("embedding")).alias("vector"))
    found = topk_search.top_k(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "vector", k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identify(read_table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("detections")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_quality": op1_site_quality,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_repair_token_ids": op5_repair_token_ids,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_host_rules": op7_host_rules,
    "op8_ppm_language": op8_ppm_language,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_license_signatures": op10_license_signatures,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op7_host_rules": rf"""
        WITH w AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), lines AS (
            SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
        ), grams AS (
            SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
        ), twice AS (
            SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
        ), covered AS (
            SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r
        ), c AS (
            SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
                   CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   coalesce(n_lines, 0) AS n_lines
            FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
        ), f AS (
            SELECT *, rule, CASE rule
                WHEN 1 THEN n_words < 50
                WHEN 2 THEN 100 * n_repeat_words > 50 * n_words
                WHEN 3 THEN 10 * n_symbols > n_words
                WHEN 4 THEN n_dup_lines > 0 AND 3 * n_dup_lines > n_lines
                ELSE word_chars < 3 * n_words OR word_chars > 10 * n_words END AS failed
            FROM c, (SELECT unnest([1, 2, 3, 4, 5]) AS rule)
        ), h AS (
            SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k
            FROM f GROUP BY ALL
        ), m AS (
            SELECT rule, sum(k) / sum(n) AS mean, count(*) / sum(n) AS share,
                   (sum(k * k / n) / sum(n) - mean * mean - mean * (1 - mean) * share) / (1 - share) AS variance
            FROM h GROUP BY rule
        ), p AS (
            SELECT rule, mean, least(greatest(CASE WHEN variance > 0 AND mean > 0 AND mean < 1
                THEN mean * (1 - mean) / variance - 1 ELSE 10000 END, 1), 10000) AS weight FROM m
        ), v AS (
            SELECT source, bool_or((k + mean * weight) / (n + weight) > 0.5) AS rejected
            FROM h JOIN p USING (rule) GROUP BY source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND NOT rejected AS kept
        FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source
    """,
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE n AS (
            SELECT doc_id, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents
        ), c AS (
            SELECT t, min(doc_id) AS rep, count(*) AS n_copies FROM n WHERE t <> '' GROUP BY t
        ), w AS (
            SELECT rep, t, string_split(t, ' ') AS ws FROM c
        ), g AS (
            SELECT DISTINCT rep, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
            FROM (SELECT rep, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
            UNION ALL SELECT rep, t FROM w WHERE len(ws) < 3
        ), s AS (
            SELECT rep, count(*) AS n FROM g GROUP BY rep
        ), e AS (
            SELECT a, b FROM (SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM g x JOIN g y USING (gram) WHERE x.rep < y.rep GROUP BY ALL)
            JOIN s p ON a = p.rep JOIN s q ON b = q.rep WHERE shared / (p.n + q.n - shared) >= 0.5
        ), both_ways AS (
            SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), reach AS (
            SELECT rep AS v, rep AS l FROM c UNION SELECT both_ways.b, reach.l FROM reach JOIN both_ways ON reach.v = both_ways.a
        ), k AS (
            SELECT v, min(l) AS class_id FROM reach GROUP BY v
        ), d AS (
            SELECT a AS v, count(*) AS n_links FROM both_ways GROUP BY a
        )
        SELECT n.doc_id, coalesce(k.class_id, n.doc_id) AS class_id, coalesce(c.rep, n.doc_id) AS copy_of,
               coalesce(c.n_copies, 1) AS n_copies, coalesce(d.n_links, 0) AS n_links,
               coalesce(k.class_id, n.doc_id) = n.doc_id AS kept
        FROM n LEFT JOIN c USING (t) LEFT JOIN k ON c.rep = k.v LEFT JOIN d ON c.rep = d.v
    """,
}
