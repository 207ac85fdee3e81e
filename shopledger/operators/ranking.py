"""Sorts, limits and top-k (SRT-01..06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    """SRT-01: largest n by a measure (each task keeps n rows)."""
    return df.orderBy(F.col(col).desc(), tie).limit(n)


def bottom_n(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    """SRT-02: smallest n by a measure."""
    return df.orderBy(F.col(col), tie).limit(n)


def order_by_map(df: DataFrame, col: str, order: Sequence[str], out: str = "sort_key") -> DataFrame:
    """SRT-03: business order of labels; unknown labels come last."""
    key: Column | None = None
    for i, label in enumerate(order, 1):
        key = F.when(F.col(col) == label, i) if key is None else key.when(F.col(col) == label, i)
    return df.withColumn(out, key.otherwise(len(order) + 1)).orderBy(out, col)


def sort_nulls_last(df: DataFrame, col: str, second: str) -> DataFrame:
    """SRT-04: descending with NULLs at the end."""
    return df.orderBy(F.col(col).desc_nulls_last(), second)


def topk_per_key(df: DataFrame, key: str, score: str, k: int, tie: str) -> DataFrame:
    """SRT-05: best k positive scores per key; the planner limits each group
    before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), tie)
    return df.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_with_total(df: DataFrame, col: str, n: int, tie: str, out: str = "scope_n") -> DataFrame:
    """SRT-06: top rows with the size of the whole scope beside them."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return top_n(df, col, n, tie).withColumn(out, total)
