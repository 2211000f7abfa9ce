"""A corpus from documents: quality rules, near duplicates, benchmark leaks, source weights, shards.

Stages see whole tables and texts, of any length; columns that they do not know, whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accordis.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from accordis.llm.shared import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the rules learnt from labels keep. Null and empty texts go. Repeated rows share their
    fate. No labels: the base alone decides. Empty table: none."""
    return quality_rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id (a null one last), then the smallest hash of the
    text; its repeated rows are one. Texts without words all stay. Empty table: none."""
    return jaccard_join.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item, row by row: null texts, null and repeated ids stay as they are. An
    empty benchmark: all."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times; texts without words as often as their source's
    whole copies. A null source is a source. Repeated rows are taken together. Empty table: none."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their size, crc32, law, shard and slot; columns of documents with these names give way. A null text has
    size 1. Rows of one id and text stay together. Empty table: none."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminated), ("mixing", mixture), ("sharding", shards)]

#: Learnt rules and seeded choices have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
