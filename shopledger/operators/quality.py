"""Reconciliation and data-quality checks (DQ-01..11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import fixed, money, pct, safe_div
from shopledger.operators.joins import with_scalars


def reconcile_counts(mart: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """DQ-01: rows and distinct keys of a mart against its fact."""
    a = mart.agg(F.count("*").alias("mart_rows"), F.countDistinct(key).alias("mart_keys"))
    b = fact.agg(F.countDistinct(key).alias("fact_keys"))
    return with_scalars(a, b).withColumn("agree", F.col("mart_keys") == F.col("fact_keys"))


def reconcile_sums(pairs: Sequence[tuple[str, DataFrame, DataFrame]], tol: str = "0.01") -> DataFrame:
    """DQ-02: named totals from two places, equal to the cent.

    Each side is a one-row frame with one decimal column.
    """
    out = None
    for name, a, b in pairs:
        row = a.sparkSession.range(1).select(
            F.lit(name).alias("check"), a.select(F.col(a.columns[0]).cast("decimal(28,4)")).scalar().alias("left_sum"), b.select(F.col(b.columns[0]).cast("decimal(28,4)")).scalar().alias("right_sum")
        )
        out = row if out is None else out.unionByName(row)
    diff = F.abs(F.col("left_sum") - F.col("right_sum"))
    return out.select("check", money(F.col("left_sum")).alias("left_sum"), money(F.col("right_sum")).alias("right_sum"), (diff <= F.lit(tol).cast("decimal(10,4)")).alias("agree"))


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ-03: how many keys repeat, and by how many rows."""
    d = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return d.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def fill_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """DQ-04: filled rows and share of each column; blanks count as missing."""
    def filled(c: str) -> Column:
        col = F.col(c)
        return F.count_if(col.isNotNull() & (F.trim(col.cast("string")) != ""))

    one = df.agg(F.count("*").alias("_n"), *[filled(c).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), pct(F.col(c), F.col("_n")).alias("fill_pct")) for c in cols])
    return one.select(F.inline(rows))


def range_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """DQ-05: rows that break each named rule, one scan."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))


def leakage_guard(df: DataFrame) -> DataFrame:
    """DQ-06: windows must nest and nothing may lie after the cutoff."""
    bad = (F.col("purchase_days_l30") > F.col("purchase_days_l90")) | (F.col("purchase_days_l90") > F.col("purchase_days_l180")) | (F.col("days_since_last") < 0) | (F.col("tenure_days") < 0)
    return df.agg(F.count("*").alias("rows_checked"), F.count_if(bad).alias("leaks"))


def fd_check(df: DataFrame, key: str, val: str) -> DataFrame:
    """DQ-07: keys that carry more than one value."""
    d = df.groupBy(key).agg(F.countDistinct(val).alias("n"))
    return d.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("broken_keys"), F.max("n").alias("max_values"))


def shape(df: DataFrame, key: str, period: str, nullable: Sequence[str]) -> DataFrame:
    """DQ-08: rows, keys, periods and missing values of left-joined columns."""
    return df.agg(
        F.count("*").alias("rows_built"), F.countDistinct(key).alias("keys"), F.min(period).alias("first_period"), F.max(period).alias("last_period"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nullable]
    )


def assert_result(df: DataFrame, min_rows: int, contains: Sequence[str] = ()) -> DataFrame:
    """DQ-10: enough rows, and each expected text somewhere in the result."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    hits = [F.max(F.when(text.contains(w), 1).otherwise(0)).alias(f"h{i}") for i, w in enumerate(contains)]
    one = df.agg(F.count("*").alias("result_rows"), *hits)
    ok = F.col("result_rows") >= min_rows
    for i in range(len(contains)):
        ok = ok & (F.col(f"h{i}") == 1)
    return one.select("result_rows", ok.alias("passed"))


def basis_probe(lines: DataFrame) -> DataFrame:
    """DQ-11: cost and price per unit by quantity: if cost is a line total, the
    ratio of cost to quantity stays level."""
    q = F.sum("quantity")
    return lines.groupBy("quantity").agg(
        F.count("*").alias("line_items"), safe_div(F.sum("cost"), F.count("*"), 4).alias("cost_per_line"), safe_div(F.sum("cost"), q, 4).alias("cost_per_unit"), safe_div(F.sum("sales"), q, 4).alias("price_per_unit")
    )
