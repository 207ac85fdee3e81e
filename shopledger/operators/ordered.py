"""Exact ranks, tiles, running sums and quantiles that never sort a whole
table, or a whole hot key, in one task.

Rows are cut into ranges of their full sort key by a bounded sample of that
key, so a value or a group that holds a third of the rows still spreads over
many ranges.  Each range is ranked on its own; the totals of the earlier
ranges (at most one row per range and group) are added as an offset.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.session import cut_lineage

#: Sampled keys: this many at least, and KEYS_PER_RANGE for each range.
SAMPLE, KEYS_PER_RANGE = 4096, 16


def _sort_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])


def with_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``_range``: the number of sampled cut points at or below the key.

    As many ranges as shuffle partitions, unless given. The cuts are sorted, so
    a row is held against every ``width``-th one first and then against the
    cuts of that block: about two square roots of their number.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = max(1, ranges)
    sample = max(SAMPLE, KEYS_PER_RANGE * ranges)
    step, width = max(1, sample // ranges), max(1, math.isqrt(ranges))
    # a deterministic sample: the keys with the smallest hash
    picked = (
        df.select(_sort_struct(order).alias("k"))
        .withColumn("h", F.xxhash64("k"))
        .orderBy("h", "k")
        .limit(sample)
    )
    keys = picked.agg(F.sort_array(F.collect_list("k")).alias("ks"))
    cuts = keys.select(
        F.filter("ks", lambda _, i: (i > 0) & (i % step == 0)).alias("cuts")
    ).scalar()
    heads = keys.select(F.filter("ks", lambda _, i: (i > 0) & (i % step == 0) & ((i / step - 1) % width == 0)).alias("heads")).scalar()
    key = _sort_struct(order)
    coarse = F.size(F.filter("_heads", lambda c: c <= key))
    inside = F.filter(F.slice("_cuts", (F.col("_block") - 1) * width + 1, F.lit(width)), lambda c: c <= key)
    fine = F.when(F.col("_block") > 0, (F.col("_block") - 1) * width + F.size(inside)).otherwise(0)
    return df.withColumn("_cuts", cuts).withColumn("_heads", heads).withColumn("_block", coarse).withColumn("_range", fine).drop("_cuts", "_heads", "_block")


def prefix_sum(
    df: DataFrame,
    order: list[str],
    weight: str | None = None,
    keys: list[str] | None = None,
    out: str = "before",
    ranges: int | None = None,
    cut: bool = True,
) -> DataFrame:
    """Add ``out``: the total ``weight`` (or row count) of the rows that sort
    before this one within ``keys``.  ``order`` must end in a unique column.

    A descending order is had by negating the column first.  The rows are read
    three times (sample, range totals, ranks), so they are written once first;
    ``cut=False`` says that the caller has done so.
    """
    keys = keys or []
    if cut:
        df = cut_lineage(df)
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    ranged = with_ranges(df, keys + order, ranges).withColumn("_w", w)
    cells = ranged.groupBy(*keys, "_range").agg(F.sum("_w").alias("_cell"))
    # one row per (group, range): bounded by the number of ranges
    prior = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prior = prior.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_range").alias("_o_range"),
        F.coalesce(F.sum("_cell").over(prior), F.lit(0)).alias("_offset"),
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys],
        F.col("_range") == F.col("_o_range"),
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = ranged.join(offsets, on, "inner")
    return joined.withColumn(
        out, F.col("_offset") + F.coalesce(F.sum("_w").over(inside), F.lit(0))
    ).drop("_w", "_range", "_offset", "_o_range", *[f"_o_{k}" for k in keys])


def exact_row_number(df, order, keys=None, out="row_number", ranges=None, cut=True) -> DataFrame:
    """ROW_NUMBER over a total order, distributed."""
    return prefix_sum(df, order, None, keys, "_before", ranges, cut).withColumn(
        out, (F.col("_before") + 1).cast("bigint")
    ).drop("_before")


def tile_of(before: Column, total: Column, n: int) -> Column:
    """NTILE(n) of a zero-based rank: the first total % n tiles get one more."""
    base = F.floor(total / F.lit(n))
    extra = total % n
    head = extra * (base + 1)
    wide = F.floor(before / (base + 1)) + 1
    thin = extra + F.floor((before - head) / F.greatest(base, F.lit(1))) + 1
    return F.when(before < head, wide).otherwise(thin).cast("int")


def exact_ntile(df: DataFrame, order: list[str], tiles: dict[str, int], ranges=None, cut=True) -> DataFrame:
    """WIN-05: one or more NTILE columns over one global total order."""
    if cut:
        df = cut_lineage(df)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = prefix_sum(df, order, None, None, "_before", ranges, cut=False)
    for name, n in tiles.items():
        ranked = ranked.withColumn(name, tile_of(F.col("_before"), total, n))
    return ranked.drop("_before")


def exact_quantiles(
    df: DataFrame, col: str, qs: dict[str, float], keys: list[str] | None = None, ranges=None, weight: str | None = None
) -> DataFrame:
    """AGG-10, AGG-12: exact interpolated quantiles per group for any group size.

    Values are counted first (map-side), so ties cost one row; the running
    count then tells which values hold the two neighbouring ranks. ``weight``
    names a whole number of rows that a row stands for.
    """
    keys = keys or []
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, F.col(col).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )
    counts = cut_lineage(counts)
    ranked = prefix_sum(counts, ["_v"], "_c", keys, "_b", ranges, cut=False)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        right = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_n")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
        ranked = ranked.join(right, on).drop(*[f"_t_{k}" for k in keys])
    else:
        ranked = ranked.withColumn("_n", totals.scalar())
    parts = []
    for name, q in qs.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_b") <= rank) & (rank < F.col("_b") + F.col("_c"))
            parts.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        parts.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
    found = ranked.groupBy(*keys).agg(*parts)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
            ).alias(n)
            for n in qs
        ],
    )
