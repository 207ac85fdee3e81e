"""Row filters and flags (FLT-01..17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import hash_bucket, md5_bucket, yyyymm


def regular_sales(df: DataFrame, col: str = "txn_type") -> DataFrame:
    """FLT-01: only Regular Sale counts as sales."""
    return df.where(F.col(col) == "Regular Sale")


def in_or_all(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """FLT-03: multi-select; an unset selection keeps every row."""
    return df if not values else df.where(F.col(col).isin(list(values)))


def scalar_or_all(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """FLT-04: one value, 'All' for no filter, 'NONE' for the blank member."""
    if value is None or value == "All":
        return df
    return df.where(F.col(col) == ("" if value == "NONE" else value))


def month_between(df: DataFrame, start: str, end: str, col: str = "yyyymm") -> DataFrame:
    """FLT-05: months of two date parameters, both ends kept."""
    low = yyyymm(F.lit(start).cast("date"))
    high = yyyymm(F.lit(end).cast("date"))
    return df.where(F.col(col).between(low, high))


def ytd(df: DataFrame, ym: int, col: str = "yyyymm") -> DataFrame:
    """FLT-06: the year of one yyyymm parameter up to that month."""
    return df.where(F.col(col).between(ym // 100 * 100 + 1, ym))


def trailing_12m(df: DataFrame, ym: int, col: str = "yyyymm") -> DataFrame:
    """FLT-07: the twelve months that end at a yyyymm parameter."""
    return df.where(F.col(col).between(ym - 99, ym))


def pos_flags(df: DataFrame) -> DataFrame:
    """FLT-09: loyalty customer, promotion and return flags."""
    cust = F.col("customer_id").cast("string")
    return (
        df.withColumn("is_loyalty_customer", cust.isNotNull() & (cust != "0"))
        .withColumn("has_promotion", F.col("promo_type").isNotNull() & (F.col("promo_type") != ""))
        .withColumn("is_return", F.col("txn_type") == "Regular Return")
    )


def band(col: Column, cuts: Sequence[tuple[float, str]], default: str, how: str = "ge") -> Column:
    """FLT-10: ordered banding, the first cut that holds wins."""
    test = {
        "ge": lambda c, v: c >= v, "gt": lambda c, v: c > v,
        "le": lambda c, v: c <= v, "lt": lambda c, v: c < v,
    }[how]
    out = None
    for cut, label in cuts:
        cond = test(col, F.lit(cut))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def sentinel_ids(df: DataFrame, key: str, store_col: str, limit: int = 20) -> DataFrame:
    """FLT-11: ids seen in more stores than a shopper could visit."""
    return df.groupBy(key).agg(F.countDistinct(store_col).alias("stores")).where(F.col("stores") > limit).select(key)


def exclude_sentinels(df: DataFrame, key: str, store_col: str, limit: int = 20) -> DataFrame:
    """FLT-11: the rows of real shoppers."""
    return df.join(sentinel_ids(df, key, store_col, limit), key, "left_anti")


def min_support(df: DataFrame, col: str, floor) -> DataFrame:
    """FLT-12: drop cells too thin for a rate."""
    return df.where(F.col(col) >= F.lit(floor))


def hash_sample(df: DataFrame, key: str, salt: str, pct: int, portable: bool = False) -> DataFrame:
    """FLT-13: deterministic sample of keys, all rows of a key together."""
    bucket = (md5_bucket if portable else hash_bucket)(F.col(key), salt, 100)
    return df.where(bucket < pct)


def having_min(df: DataFrame, keys: Sequence[str], k: int, count: str = "rows") -> DataFrame:
    """FLT-14: groups with at least ``k`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) >= k)


def mod_split(df: DataFrame, key: str, base: int, r: int) -> DataFrame:
    """FLT-15: the rows of one residue class; classes are disjoint."""
    return df.where(F.pmod(F.col(key), F.lit(base)) == r)


def valid_code(col: Column, pattern: str) -> Column:
    """FLT-16: Y when the whole code matches the pattern."""
    return F.when(F.coalesce(col.rlike(pattern), F.lit(False)), "Y").otherwise("N")


def choices(df: DataFrame, value: str, label: str, parent: tuple[str, str] | None = None) -> DataFrame:
    """FLT-17: the sorted value list of a filter, cut by the parent choice."""
    if parent:
        df = scalar_or_all(df, *parent)
    return df.select(F.col(value).alias("value"), F.col(label).alias("label")).distinct().orderBy("label", "value")
