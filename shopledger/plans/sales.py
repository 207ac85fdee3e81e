"""Transaction and sales marts (MRT-01..07, MRT-40, MRT-47)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import (
    day_name, dow0, is_weekend, jdn, money, month_name, norm_blank, pct, safe_div, week_of_year, yyyymm,
)
from shopledger.operators.joins import active_count, presence_flag

ONE = "*"


def build_txn(txn: DataFrame, calendar: DataFrame, online_ids: DataFrame) -> DataFrame:
    """MRT-01: the transaction mart: basket measures, calendar flags, channel flag."""
    cal = calendar.select("calendar_date", "is_weekend", "is_holiday", "period")
    out = txn.join(cal, txn.sale_date == cal.calendar_date).drop("calendar_date")
    return presence_flag(out, online_ids, "txn_id", "ecommerce_flag")


def sales_measures() -> list[Column]:
    return [
        money(F.sum("sales")).alias("sales"), money(F.sum("cost")).alias("cost"),
        F.sum("quantity").alias("qty"), F.countDistinct("txn_id").alias("tx"), F.count(ONE).alias("line_items"),
    ]


def dash_monthly(lines: DataFrame, period: Column) -> DataFrame:
    """MRT-02: month x region x promotion x period."""
    return lines.groupBy(
        F.year("sale_date").alias("yr"), F.month("sale_date").alias("mo"), "region",
        norm_blank(F.col("promo_type")).alias("promo_type"), period.alias("period"),
    ).agg(*sales_measures())


def dash_by(lines: DataFrame, keys: Sequence[str], stores: bool = False) -> DataFrame:
    """MRT-03: region, province, promotion and store summaries.

    A transaction belongs to one store, so summing its lines per (keys, store,
    transaction) first leaves plain counts for the second step.
    """
    base = [*dict.fromkeys([*keys, "store_id", "txn_id"])]
    per = lines.groupBy(*base).agg(
        F.sum("sales").alias("s"), F.sum("cost").alias("c"), F.sum("quantity").alias("q"), F.count(ONE).alias("n")
    )
    out = per.groupBy(*keys).agg(
        *([F.countDistinct("store_id").alias("stores")] if stores else []),
        money(F.sum("s")).alias("sales"), money(F.sum("c")).alias("cost"), F.sum("q").alias("qty"),
        F.count(ONE).alias("tx"), F.sum("n").alias("line_items"),
    )
    return out


def dash_kpi(lines: DataFrame) -> DataFrame:
    """MRT-04: exact whole-period figures from the line grain."""
    return lines.agg(*sales_measures())


def build_calendar(spark, first: Column, last: Column, holidays: Sequence[tuple[str, str]], promos: DataFrame, cut: str, names: tuple[str, str]) -> DataFrame:
    """MRT-05: one row per day with day number, names, holidays, period and
    the promotions active on it.  ``holidays`` maps month-day to a name."""
    d = F.col("calendar_date")
    days = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("calendar_date"))
    pairs = F.create_map(*[F.lit(x) for hd in holidays for x in hd])
    name = F.element_at(pairs, F.date_format(d, "MM-dd"))
    cal = days.select(
        d, jdn(d).alias("jdn"), F.year(d).alias("yr"), F.month(d).alias("mo"), F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"), F.quarter(d).alias("quarter"), yyyymm(d).alias("yyyymm"),
        month_name(F.month(d)).alias("month_name"), dow0(d).alias("dow_num"), day_name(d).alias("day_name"),
        is_weekend(d).alias("is_weekend"), week_of_year(d).alias("week_of_year"),
        F.when(name.isNotNull(), "Y").otherwise("N").alias("is_holiday"), name.alias("holiday_name"),
        F.when(d >= F.lit(cut).cast("date"), names[1]).otherwise(names[0]).alias("period"),
    )
    return active_count(cal, promos, "calendar_date", "start_date", "end_date", "promos_active")


def pattern(df: DataFrame, keys: Sequence[Column], value: str = "sales", txn: str = "txn_id") -> DataFrame:
    """MRT-06: sales, transactions and average ticket by day, hour or weekday."""
    return df.groupBy(*keys).agg(
        money(F.sum(value)).alias("sales"), F.countDistinct(txn).alias("tx"),
        safe_div(F.sum(value), F.countDistinct(txn), 2).alias("avg_ticket"),
    )


def loyalty_split(lines: DataFrame, is_loyal: Column) -> DataFrame:
    """MRT-07: identified against anonymous shoppers."""
    g = lines.groupBy(F.when(is_loyal, "Loyal").otherwise("Anonymous").alias("shopper")).agg(
        F.sum("sales").alias("s"), F.countDistinct("txn_id").alias("tx")
    )
    total = g.agg(F.sum("s").alias("t")).scalar()
    return g.select("shopper", money(F.col("s")).alias("sales"), "tx", pct(F.col("s"), total).alias("share_pct"))


def returns_voids(lines: DataFrame) -> DataFrame:
    """MRT-07: returns and voids as a percentage of regular sales."""
    g = lines.groupBy("txn_type").agg(F.sum("sales").alias("s"), F.countDistinct("txn_id").alias("tx"))
    sales = g.where("txn_type = 'Regular Sale'").agg(F.sum("s").alias("t")).scalar()
    return g.where("txn_type <> 'Regular Sale'").select(
        "txn_type", money(F.col("s")).alias("value"), "tx", pct(F.col("s"), sales).alias("pct_of_sales")
    )


def traffic(visits: DataFrame) -> DataFrame:
    """MRT-40: store-day visitors, transactions, sales, ticket and conversion.

    ``visits`` has store_id, day, visitors, transactions and sales per row.
    """
    g = visits.groupBy("store_id", "day").agg(
        F.sum("visitors").alias("visitors"), F.sum("transactions").alias("transactions"), F.sum("sales").alias("s")
    )
    return g.select(
        "store_id", "day", "visitors", "transactions", money(F.col("s")).alias("sales"),
        safe_div(F.col("s"), F.col("transactions"), 6).alias("avg_ticket"),
        pct(F.col("transactions"), F.col("visitors")).alias("conversion_pct"),
    )


def star_report(lines: DataFrame, by: str, measure: str = "sales", n: int | None = None) -> DataFrame:
    """MRT-47: star-schema report by one dimension: sales, cost, profit, units."""
    g = lines.groupBy(by).agg(
        money(F.sum("sales")).alias("sales"), money(F.sum("cost")).alias("cost"),
        money(F.sum("sales") - F.sum("cost")).alias("profit"), F.sum("quantity").alias("units"),
    )
    return g if n is None else g.orderBy(F.col(measure).desc(), by).limit(n)
