"""Queries of the text operators, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, graph_index, html_text, language_id, license_scan, lm_score, quality, segmentation, warc
from .common import held_out
from .near_dup import NearDuplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 4)))
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return graph_index.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    latent = decontamination.fit(docs, items)
    found = decontamination.find(docs.select("doc_id", "text"), items, latent)
    return found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 7)
    scored = lm_score.score(table(spark, sf_dir, "documents"), train=~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.digest(segmentation.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, verify=True))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    g = F.col("language_guess")
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), g["lang_pred"].alias("lang_pred"), g["score"].alias("score"), g["margin"].alias("margin"), g["accepted"].alias("accepted"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), column="text")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(width=2)(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc": op2_warc,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": op9_license_scan,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATES = ", ".join(
    f"({i}, '{label}', {text in license_scan.PHRASES}, string_split('{text}', ' '))" for i, (text, label) in enumerate((license_scan.PHRASES | license_scan.NOTICES).items())
)

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
               CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to,
               url
        FROM pages WINDOW same AS (PARTITION BY sha1(coalesce(html, '')))""",
    "op9_license_scan": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        tp AS (SELECT template, label, phrase, len(w) - 1 AS pairs, unnest(range(len(w) - 1)) AS pos, w FROM (VALUES {_TEMPLATES}) AS t(template, label, phrase, w)),
        dp AS (SELECT r, place, w[place + 1] || ' ' || w[place + 2] AS pair FROM (SELECT r, w, unnest(range(len(w) - 1)) AS place FROM d)),
        g AS (SELECT r, template, label, phrase, pairs, place - pos AS diagonal, list(DISTINCT pos) AS seen FROM dp JOIN tp ON dp.pair = tp.w[pos + 1] || ' ' || tp.w[pos + 2] GROUP BY ALL),
        k AS (SELECT * FROM g WHERE NOT phrase OR len(seen) = pairs),
        m AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER o > 3, TRUE) THEN 1 ELSE 0 END AS new FROM k WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
        n AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS grp FROM m),
        s AS (SELECT r, label, phrase, greatest(min(diagonal) + list_min(flatten(list(seen))), 0) AS first_word, len(list_distinct(flatten(list(seen)))) / pairs AS score FROM n GROUP BY r, template, label, phrase, pairs, grp),
        f AS (SELECT r, count(*) FILTER (WHERE phrase) AS n_base, min(first_word) FILTER (WHERE phrase) AS first_word, max(first_word) FILTER (WHERE phrase) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM s WHERE score >= 0.7 GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN f USING (r)""",
    "op10_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        h AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM h),
        l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        c AS (SELECT doc_id AS u, doc_id AS v FROM h UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u)
        SELECT h.doc_id, len(s)::BIGINT AS n_shingles, min(c.v) AS component_id, h.doc_id = min(c.v) AS kept FROM h JOIN c ON h.doc_id = c.u GROUP BY h.doc_id, s""",
}
