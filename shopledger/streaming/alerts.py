"""Threshold alerts on a watched value, batch and live (STR-01)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.session import shared_folder

OPERATORS = {
    "equals": lambda c, v: c == v, "not_equal": lambda c, v: c != v, "less": lambda c, v: c < v,
    "less_or_equal": lambda c, v: c <= v, "greater": lambda c, v: c > v, "greater_or_equal": lambda c, v: c >= v,
}


def alert(df: DataFrame, value: str, op: str, threshold) -> DataFrame:
    """STR-01: the rows whose watched value meets the condition."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    return df.where(OPERATORS[op](F.col(value), F.lit(threshold)))


def windowed_alert(events: DataFrame, keys: list[str], value: Column, op: str, threshold, every: str, late: str) -> DataFrame:
    """STR-01: tumbling windows of a watched sum, late rows bounded by a
    watermark; works on a stream and on a batch."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), *keys).agg(F.sum(value).alias("watched"))
    hit = alert(g, "watched", op, threshold)
    return hit.select(F.col("window.start").alias("window_start"), *keys, "watched")


def run_available(spark: SparkSession, stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything there is in append mode and return what was written.

    The sink and the progress log live in the shared folder, so a restarted
    query carries on where it stopped.
    """
    base = path or os.path.join(shared_folder(spark), f"alert-{uuid.uuid4().hex}")
    q = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", os.path.join(base, "progress")).start(os.path.join(base, "rows"))
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(base, "rows"))
