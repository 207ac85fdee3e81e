"""The retail model over the given tables.

Lines are ``lineitem`` rows, a transaction is an order, a store is the
customer's nation (25 of them), the product class is the part type.  Money is
decimal from the start, so every sum is exact on any number of executors.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.functions import jdn, yyyymm
from shopledger.sources.tables import read_table

SALE, RETURN, VOID = "Regular Sale", "Regular Return", "Post Void TX"

# Fixed values of the sample mapping: the cut of the two named periods, the
# as-of month of the reports and the store formats.
PERIOD_CUT = "1998-03-01"
PERIODS = ("Before", "After")
AS_OF_YM = 200106
FORMATS = ["Standalone", "Strip Plaza", "Shopping Mall", "Urban Storefront"]


def txn_type(status: Column) -> Column:
    return F.when(status == "F", SALE).when(status == "P", RETURN).otherwise(VOID)


def promo_type(discount: Column) -> Column:
    return F.when(discount >= 0.08, "T").when(discount >= 0.05, "M").when(discount > 0, "O").otherwise("")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    """25 stores with region, format, size and owner."""
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.cast("int").alias("store_id"),
        F.concat(F.col("n_name"), F.lit(" - Main")).alias("store_name"),
        F.col("n_name").alias("province"),
        F.col("r_name").alias("region"),
        F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (key % 4 + 1).cast("int")).alias("store_format"),
        (1000 + (key * 370) % 900).cast("int").alias("square_feet"),
        F.concat(F.lit("OWN-"), (key % 9).cast("string")).alias("owner_id"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("plu"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_size").alias("pack_size"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_cost"),
    )


def status_of(kind: str) -> Column:
    """The raw condition of a transaction type, which the scan can check."""
    status = F.col("o_orderstatus")
    if kind == VOID:
        return status.isNull() | ~status.isin("F", "P")
    return status == {SALE: "F", RETURN: "P"}[kind]


def headers(spark: SparkSession, folder: str, types: tuple[str, ...] = ()) -> DataFrame:
    """One row per transaction without its lines; the store comes from the
    customer. ``types`` keeps some transaction types, by a filter on the scan."""
    orders = read_table(spark, folder, "orders")
    if types:
        orders = orders.where(reduce(or_, [status_of(t) for t in types]))
    customer = read_table(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_nationkey").cast("int").alias("store_id"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        txn_type(F.col("o_orderstatus")).alias("txn_type"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("c_acctbal") >= 0).cast("int").alias("email_flag"),
        F.col("o_orderdate").cast("timestamp").alias("sold_at"),
    )


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as ``lineitem`` gives them: keys, exact money, promotion code."""
    li = read_table(spark, folder, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    off = F.col("l_discount").cast("decimal(4,2)")
    return li.select(
        F.col("l_orderkey").alias("txn_id"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.col("l_partkey").alias("plu"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        price.alias("regular_value"),
        (price * (F.lit(1).cast("decimal(4,2)") - off)).cast("decimal(18,4)").alias("sales"),
        (price * off).cast("decimal(18,4)").alias("discount"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax_rate"),
        promo_type(F.col("l_discount")).alias("promo_type"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


def lines(
    spark: SparkSession, folder: str, product: bool = True, store: bool = True, types: tuple[str, ...] = ()
) -> DataFrame:
    """The line fact. Joins that a caller does not need are left out, because
    no optimizer rule can drop an inner join for it."""
    head = headers(spark, folder, types)
    out = raw_lines(spark, folder).join(head, "txn_id")
    if product:
        out = out.join(products(spark, folder), "plu").withColumn(
            "cost", (F.col("unit_cost") * F.col("quantity").cast("decimal(8,0)")).cast("decimal(18,2)")
        )
    if store:
        out = out.join(stores(spark, folder).select("store_id", "store_name", "province", "region"), "store_id")
    return out.withColumn("yyyymm", yyyymm(F.col("sale_date")))


def sales_lines(spark: SparkSession, folder: str, product: bool = True, store: bool = True) -> DataFrame:
    """Only Regular Sale lines."""
    return lines(spark, folder, product, store, (SALE,))


def event_id(promo: Column, day: Column) -> Column:
    """Promotion event: code and quarter, blank without a promotion."""
    return F.when(
        promo != "", F.concat(promo, F.lit("-"), F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    ).otherwise("")


def distinct_items(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct products and classes per transaction, by narrowing the key one
    column at a time, so a huge transaction is spread until its last step."""
    pairs = raw_lines(spark, folder).select("txn_id", "plu").join(products(spark, folder).select("plu", "category"), "plu")
    items = pairs.groupBy("txn_id", "category", "plu").agg(F.lit(1).alias("one"))
    classes = items.groupBy("txn_id", "category").agg(F.count("*").alias("n"))
    return classes.groupBy("txn_id").agg(F.sum("n").alias("distinct_plus"), F.count("*").alias("distinct_categories"))


def transactions(spark: SparkSession, folder: str, distinct: bool = False) -> DataFrame:
    """Transaction grain: lines are summed per order before any other join.
    ``distinct`` adds the counts of products and classes."""
    per_line = raw_lines(spark, folder).join(products(spark, folder).select("plu", "unit_cost"), "plu")
    cost = (F.col("unit_cost") * F.col("quantity").cast("decimal(8,0)")).cast("decimal(18,2)")
    promo = F.col("promo_type") != ""
    basket = per_line.groupBy("txn_id").agg(
        F.count("*").alias("line_items"),
        F.sum("quantity").alias("basket_items"),
        F.sum("sales").alias("basket_value"),
        F.sum(cost).alias("basket_cost"),
        F.sum("discount").alias("discount_total"),
        F.sum(F.when(promo, F.col("sales")).otherwise(F.lit(0).cast("decimal(18,4)"))).alias("promo_value"),
        F.max(promo).alias("promo_flag"),
    )
    if distinct:
        basket = basket.join(distinct_items(spark, folder), "txn_id")
    day = F.col("sale_date")
    return (
        basket.join(headers(spark, folder), "txn_id")
        .withColumn("promo_flag", F.when(F.col("promo_flag"), "Y").otherwise("N"))
        .withColumn("basket_margin", F.col("basket_value") - F.col("basket_cost"))
        .withColumn("jdn", jdn(day))
        .withColumn("yyyymm", yyyymm(day))
        .withColumn("channel", F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "Delivery").otherwise("Store"))
    )


def span(spark: SparkSession, folder: str) -> tuple[Column, Column]:
    """First and last sale date as scalar subqueries."""
    orders = read_table(spark, folder, "orders")
    first = orders.agg(F.min(F.col("o_orderdate").cast("date")).alias("d")).scalar()
    last = orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("d")).scalar()
    return first, last


def months(spark: SparkSession, folder: str) -> DataFrame:
    """One row per month of the span with its sequence number (WIN-06)."""
    first, last = span(spark, folder)
    days = spark.range(1).select(
        F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("month_start")
    )
    base = F.year(first) * 12 + F.month(first)
    return days.select(
        yyyymm(F.col("month_start")).alias("yyyymm"),
        F.col("month_start"),
        F.last_day("month_start").alias("month_end"),
        (F.year("month_start") * 12 + F.month("month_start") - base + 1).cast("int").alias("month_seq"),
    )


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """The access and activity log with a store per user."""
    return read_table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.col("user_id"),
        "event_type",
        F.col("value").cast("decimal(12,2)").alias("value"),
        "props",
        F.col("ts").cast("date").alias("day"),
        F.hour("ts").alias("hour"),
        (F.col("user_id") % 25).cast("int").alias("store_id"),
    )
