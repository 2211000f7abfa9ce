"""Queries of this package's operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accordis.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_classifier, quality_rules, secrets, sharding, substring_dedup, suffix_dedup


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.report(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op2_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality_classifier.quality_scores(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_join(_t(spark, d, "documents"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_scan(_t(spark, d, "documents"))


def op6_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.repeated_spans(_t(spark, d, "documents")).select("doc_id", "start", "end", "words", "first_doc_id", "duplicate")


def op8_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


def op9_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_t(spark, d, "documents")).select("doc_id", "start_word", "end_word", "words", "first_doc_id", "duplicate")


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.report(_t(spark, d, "documents"), **line_dedup.WHOLE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_ngram_jaccard_join, op4_mixing, op5_secret_scans, op6_sharding, op7_substring_dedup, op8_benchmark_decontamination, op9_suffix_array_dedup, op10_line_dedup)}
#: What SQL can express: the others learn, hash or choose by seeds, and tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as g from s),
o as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
l2 as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from n union select r.x, l2.y from r join l2 on r.y = l2.x)
select n.doc_id, n.n as n_shingles, m.c as component_id from n join (select x, min(y) as c from r group by x) m on m.x = n.doc_id""",
}
