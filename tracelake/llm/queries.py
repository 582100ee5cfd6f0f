"""The registered query of each operator, and oracle SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.chat import repair_roles
from tracelake.llm.common import shared_dir
from tracelake.llm.decontaminate import contamination
from tracelake.llm.mixing import draw
from tracelake.llm.ngram_join import ngram_jaccard_components
from tracelake.llm.quality import base_failed, quality_verdicts, text_statistics
from tracelake.llm.sharding import shard_documents
from tracelake.llm.suffix_dedup import repeat_digests
from tracelake.llm.tokens import token_counts
from tracelake.llm.toxicity import score_toxicity
from tracelake.llm.url_filter import RULES, filter_urls, host_and_path, matching_rule

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tracelake/shards-{uuid.uuid4().hex}")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(_table(spark, sf_dir, "pages"), labels)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(_table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), VOCABULARY)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 3 that SQL can express: hosts, paths and rules."""
    host, path = host_and_path(F.col("url"))
    rows = _table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), RULES))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 7 that SQL can express: counts and base rules."""
    rows = text_statistics(_table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("base_failed", base_failed())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_url_filters": op3_url_filters,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "url_rules": url_rules,
    "quality_base": quality_base,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r),
low AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d),
class AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM sets),
degree AS (SELECT x.class_id, count(DISTINCT y.class_id) AS n FROM edges JOIN class x ON x.doc_id = a JOIN class y ON y.doc_id = b WHERE x.class_id <> y.class_id GROUP BY ALL)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, class.class_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
FROM sets JOIN low ON low.d = sets.doc_id JOIN class ON class.doc_id = sets.doc_id LEFT JOIN degree ON degree.class_id = class.class_id""",
    "url_rules": r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') AS h, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
hosts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts)
SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM hosts""",
    "quality_base": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)""",
}
