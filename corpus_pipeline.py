"""From raw documents to packed sequences: five stages, each on what its predecessor kept.

A stage takes (spark, documents, folder) and returns a DataFrame; all but the
last return the columns of the documents. Every stage is written as Parquet in
the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopledger.llm import decontam, neardup, packing, quality, suffix
from shopledger.session import cut_lineage, tune


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the line-field classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, size=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    return suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean_rows(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and signatures cannot be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
