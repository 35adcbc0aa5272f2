"""Corpus pipeline: quality classifier, quality rules, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import load, written
from sightline.llm.jaccard_join import first_of_each
from sightline.llm.ordinal_quality import score_quality
from sightline.llm.packing import pack
from sightline.llm.quality_rules import cleaned


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is above the cut. Null and empty texts are scored as empty ones; repeated rows stay or
    go alike; without labels of two grades all stay; an empty table gives none."""
    return score_quality(docs, load(spark, sf_dir, "labels")).where("keep").select(docs.columns)


def filter_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines; each row is judged by itself. Null and empty texts fail
    the rules; repeated rows stay or go alike; an empty table gives none."""
    return cleaned(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id. Texts without words stay; of repeated rows one
    stays, also where they have no id; an empty table gives none."""
    return first_of_each(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens. Null and empty texts are one end id; repeated rows are documents of their own;
    an empty table gives no pieces."""
    return pack(docs)


STAGES = [("quality classifier", classify), ("quality rules", filter_rules), ("n-gram jaccard join", one_of_each), ("packing", pack_windows)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep of documents; edge cases as in each stage."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
