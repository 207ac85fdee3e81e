"""Registered queries of this subpackage: name -> (builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopledger.llm import align, bytebpe, ctw, decontam, licenses, neardup, packing, quality, runs, suffix, tokencount, tokenio, topk
from shopledger.session import tune

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (lambda spark, folder: build(tune(spark), folder), sql)
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_bm25_block_max_top_k")
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    return topk.top_k(docs.where("doc_id % 100 = 0"), docs, k=10)


@query("op2_license_scan")
def op2(spark, folder):
    files = licenses.document_files(table(spark, folder, "documents"))
    return licenses.license_scan(files).withColumnRenamed("file", "doc_id")


@query("op3_best_fit_packing")
def op3(spark, folder):
    return packing.best_fit_packing(table(spark, folder, "documents"))


@query("op4_line_field_quality")
def op4(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_minhash_components")
def op5(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"), size=4)


@query("op8_suffix_array_passages")
def op8(spark, folder):
    return suffix.passage_report(table(spark, folder, "documents"))


@query("op6_context_tree_scores")
def op6(spark, folder):
    return ctw.model_scores(table(spark, folder, "documents"))


@query("op7_trie_token_counts")
def op7(spark, folder):
    return tokencount.token_counts(table(spark, folder, "documents"))


@query("op9_edit_decontamination")
def op9(spark, folder):
    return decontam.document_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_token_matrices")
def op10(spark, folder):
    return tokenio.packed_matrices(table(spark, folder, "documents"))


@query("op11_periodic_runs")
def op11(spark, folder):
    return runs.run_report(table(spark, folder, "documents"), source=runs.repeated_source)


@query("op12_cross_tokenizer_alignment")
def op12(spark, folder):
    return align.alignment_report(table(spark, folder, "documents"))


@query("op13_byte_bpe_coding")
def op13(spark, folder):
    return bytebpe.coding_report(table(spark, folder, "documents"))
