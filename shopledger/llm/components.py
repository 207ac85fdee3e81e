"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id with a link (columns a, b).

    Each round hangs larger neighbours on the smallest one, seen from both ends,
    and ends when nothing changes; rounds grow with the logarithm of the longest
    path. Groups are combined on the map side; the joins are plain equi-joins
    whose hot keys adaptive execution can split. No group is collected.
    """
    pairs = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        pairs = cut_lineage(small.union(least.select("a", F.col("low").alias("b"))).distinct())
        after = state(pairs)
        if after == before:
            break
        before = after
    ends = pairs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return ends.union(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
