"""A corpus pipeline of five operators; each stage reads what its predecessor kept.

Quality rules drop rejected documents, one document of each group of near copies stays, documents that cover a benchmark item go,
documents are drawn to smoothed target weights, and the rest is stored in shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import shared_dir, stage_table
from tracelake.llm.decontaminate import decontaminate
from tracelake.llm.mixing import mix
from tracelake.llm.ngram_join import deduplicate
from tracelake.llm.quality import keep_good
from tracelake.llm.sharding import shard_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document passes the base rules and is no outlier of its language and source.

    Null and empty texts have too few words and go; rows without doc_id can't be judged and stay; repeated rows share a verdict. Very
    long texts are measured whole. All columns stay as they are, whatever their names; an empty table gives no rows.
    """
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id.

    Null and empty texts link with nothing and stay, as do rows without doc_id; of repeated rows one stays. Very long texts are
    compared whole. All columns stay as they are; an empty table gives no rows.
    """
    return deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to a half.

    Null and empty texts cover nothing and stay; repeated rows share a verdict; texts are searched whole. Benchmark items under five
    words match nothing. All columns stay as they are; an empty table gives no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have smoothed shares; one is drawn as often as its weight says.

    Null sources and languages are a value of their own; texts without words are drawn once; repeated rows share one draw. All
    columns stay as they are; an empty table gives no rows.
    """
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies after it was appended and compacted: a row for each row, nulls and repeated rows included."""
    return shard_documents(docs, f"{shared_dir(spark)}/tracelake/corpus-{uuid.uuid4().hex}")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Robust estimates and hashed draws have no SQL form; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
