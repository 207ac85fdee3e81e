"""Aggregations (AGG-01..30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import nonzero, pct, safe_div


def sum_if(cond: Column, value: Column) -> Column:
    """AGG-03: sum where the condition holds, 0 otherwise."""
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def count_if(cond: Column) -> Column:
    """AGG-03: rows where the condition holds."""
    return F.count_if(cond)


def distinct_if(cond: Column, value: Column) -> Column:
    """AGG-04: distinct values where the condition holds."""
    return F.countDistinct(F.when(cond, value))


def ratio_of_sums(a: Column, b: Column, scale: int | None = None, factor: float = 1.0) -> Column:
    """AGG-07: never the mean of ratios."""
    return safe_div(F.sum(a), F.sum(b), scale, factor)


def wavg(x: Column, w: Column, scale: int | None = None) -> Column:
    """AGG-08: weighted average of pre-averaged rows."""
    return safe_div(F.sum(x * w), F.sum(w), scale)


def wavg_trim(x: Column, w: Column, limit, scale: int | None = None) -> Column:
    """AGG-09: weighted average with changes of ``limit`` or more left out."""
    ok = F.abs(x) < F.lit(limit)
    return safe_div(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)), scale)


def sd_moments(col: Column) -> Column:
    """AGG-11: population deviation from two moments, never below zero."""
    x = col.cast("double")
    return F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x) - F.avg(x) * F.avg(x)))


def cv(col: Column) -> Column:
    """AGG-14: coefficient of variation."""
    return F.stddev_samp(col) / nonzero(F.avg(col))


def mode_of(df: DataFrame, keys: Sequence[str], val: str, out: str | None = None) -> DataFrame:
    """AGG-15: most frequent value per key, ties to the smaller value.  A
    min over (-count, value) keeps one candidate per task, so a key with very
    many values is never sorted in one place."""
    counts = df.groupBy(*keys, val).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(val).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(out or val), (-F.col("_b.c")).alias("n"))


def argmax_of(df: DataFrame, keys: Sequence[str], val: str, measure: Column, out: str | None = None) -> DataFrame:
    """AGG-16: the value with the largest summed measure, ties to the smaller value."""
    sums = df.groupBy(*keys, val).agg(F.sum(measure).alias("_m"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("_m")).alias("m"), F.col(val).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(out or val), (-F.col("_b.m")).alias("measure"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], last: bool = False) -> DataFrame:
    """AGG-17: the row of a key that comes first (or last) by ``order``; a
    min over a struct combines map-side, unlike a row number."""
    pick = (F.max if last else F.min)(F.struct(*order, *[c for c in cols if c not in order])).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def share_of_total(df: DataFrame, col: str, out: str = "share_pct", scale: int = 2) -> DataFrame:
    """AGG-18: each row over the grand total, a scalar subquery."""
    total = df.agg(F.sum(col).alias("t")).scalar()
    return df.withColumn(out, pct(F.col(col), total, scale))


def share_within(df: DataFrame, parents: list[str], col: str, out: str = "share_pct", scale: int = 2) -> DataFrame:
    """AGG-19: each row over its parent's total, the same filters on both sides."""
    totals = df.groupBy(*parents).agg(F.sum(col).alias("_t"))
    return df.join(totals, parents).withColumn(out, pct(F.col(col), F.col("_t"), scale)).drop("_t")


def yoy(df: DataFrame, keys: list[str], year: Column, value: Column, y1: int, y0: int) -> DataFrame:
    """AGG-20: two years and their growth from conditional sums in one pass."""
    out = df.groupBy(*keys).agg(
        F.sum(F.when(year == y0, value)).alias("prior_value"), F.sum(F.when(year == y1, value)).alias("this_value")
    )
    return out.withColumn("growth_pct", pct(F.col("this_value") - F.col("prior_value"), F.col("prior_value")))


def index_to_base(df: DataFrame, t: str, base, cols: list[str]) -> DataFrame:
    """AGG-21: each measure as a percentage of its value in a base period."""
    first = df.where(F.col(t) == base)
    return df.select(
        t,
        *[pct(F.col(c), first.select(F.sum(c).alias("b")).scalar()).alias(f"{c}_index") for c in cols],
    )


def point_values(df: DataFrame, points: Sequence[tuple[str, Column]], value: Column) -> DataFrame:
    """AGG-22: named points of one aggregate as columns of one row."""
    return df.agg(*[F.sum(F.when(cond, value)).alias(name) for name, cond in points])


def rollup_totals(df: DataFrame, keys: list[str], measures: dict[str, Column], label: str = "Total") -> DataFrame:
    """AGG-25: group subtotals and grand total with their level."""
    out = df.rollup(*keys).agg(*[c.alias(n) for n, c in measures.items()], F.grouping_id().cast("int").alias("level"))
    return out.select(*[F.coalesce(F.col(k).cast("string"), F.lit(label)).alias(k) for k in keys], *measures, "level")


def crosstab(df: DataFrame, row: str, col: str, values: list[str], measure: Column, label: str = "Total") -> DataFrame:
    """AGG-26: crosstab with row, column and grand totals.  The cube runs
    first and the pivot sees only its few cells."""
    cells = df.cube(row, col).agg(measure.alias("_m"), F.grouping_id(row, col).alias("_g"))
    named = cells.select(
        F.when(F.col("_g").bitwiseAND(2) > 0, label).otherwise(F.col(row)).alias(row),
        F.when(F.col("_g").bitwiseAND(1) > 0, label).otherwise(F.col(col)).alias("_c"),
        "_m",
    )
    return named.groupBy(row).pivot("_c", [*values, label]).agg(F.first("_m"))


def aging_pivot(df: DataFrame, keys: list[str], bucket: str, value: Column, names: dict[str, str]) -> DataFrame:
    """AGG-27: bucket sums as columns."""
    zero = F.lit(0)
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(bucket) == b, value).otherwise(zero)).alias(n) for b, n in names.items()],
        F.sum(value).alias("total"),
    )


def distinct_safe(df: DataFrame, key: str, grains: Sequence[Sequence[str]]) -> DataFrame:
    """AGG-29: distinct counts recomputed per grain, beside the sum of the
    finer groups that would overstate them."""
    out = None
    for keys in grains:
        exact = df.agg(F.countDistinct(key).alias("exact"))
        fine = df.groupBy(*keys).agg(F.countDistinct(key).alias("n")).agg(F.sum("n").alias("summed"))
        row = exact.select(F.lit("+".join(keys)).alias("grain"), "exact", fine.scalar().alias("summed"))
        out = row if out is None else out.unionByName(row)
    return out


def code_rollup(df: DataFrame, code: str, mapping: dict, measure: Column, default: str = "Other") -> DataFrame:
    """AGG-30: roll-up of codes through a code list, with the share of the total."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    group = F.coalesce(F.element_at(F.create_map(*pairs), F.col(code)), F.lit(default))
    return share_of_total(df.groupBy(group.alias("code_group")).agg(measure.alias("value")), "value")
