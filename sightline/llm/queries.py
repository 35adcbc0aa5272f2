"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_counts
from .common import load
from .decontamination import contamination
from .embedding_dedup import near_vectors
from .jaccard_join import jaccard_components
from .license_scan import scan_licenses
from .lm_score import score_texts
from .oracles import contamination_sql, jaccard_sql, url_filter_sql, vector_codes_sql
from .ordinal_quality import score_quality
from .packing import pack
from .quality_rules import QUALITY_SQL, quality_rules
from .sentencepiece_codec import encode_texts
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .vector_codes import book_digest, code_text, encode_vectors, with_label_errors


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", "tail_probability", "keep")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(load(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(load(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = encode_vectors(load(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", code_text("code").alias("code"), "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(load(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ordinal_quality": op1,
        "op2_sentencepiece": op2,
        "op3_url_filter": op3,
        "op4_ngram_jaccard_join": op4,
        "op5_toxicity": op5,
        "op6_lm_score": op6,
        "op7_quality_rules": op7,
        "op8_packing": op8,
        "op9_license_scan": op9,
        "op10_embedding_dedup": op10,
        "op11_vector_codes": op11,
        "op12_token_alignment": op12,
        "op13_decontamination": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter_sql(), "op4_ngram_jaccard_join": jaccard_sql(), "op7_quality_rules": QUALITY_SQL, "op11_vector_codes": vector_codes_sql(), "op13_decontamination": contamination_sql()}
