"""The registered queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cobuckets import Numbered, co_bucket, crc32_bucket
from tidemark.llm.common import table
from tidemark.llm.exact_search import exact_topk
from tidemark.llm.jaccard_join import jaccard_join
from tidemark.llm.language_id import identify_language
from tidemark.llm.licenses import scan_licences, scan_sql
from tidemark.llm.mixing import mix_sources
from tidemark.llm.negatives import hard_negatives
from tidemark.llm.neighbours import nearest
from tidemark.llm.packing import pack_documents
from tidemark.llm.phrases import repeated_phrases
from tidemark.llm.quality import score_quality
from tidemark.llm.repeats import repeat_spans
from tidemark.llm.token_counts import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans(table(spark, sf_dir, "documents")).drop("row")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links", "n_copies")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_co_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, buckets = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), 600
    bucket = F.coalesce(crc32_bucket("sale_id", buckets, "s"), F.lit(buckets + 1))
    left = Numbered("sales", sales, "sale_id", F.when(bucket % 4 == 1, bucket - 1).otherwise(bucket), buckets + 2)
    right = Numbered("sale_lines", lines, "sale_id", F.coalesce(crc32_bucket("item_id", buckets), F.lit(0)), buckets)
    return co_bucket(left, right, buckets, "s")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_topk": op2_exact_topk,
    "op3_nearest": op3_nearest,
    "op4_token_counts": op4_token_counts,
    "op5_repeats": op5_repeats,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_co_buckets": op11_co_buckets,
    "op12_phrases": op12_phrases,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_license_scan": scan_sql(),
}
