"""Input frames that marts expect beside the fact, derived from the given
tables (stock, shifts, invoices, online orders, email, shrink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.sources import retail

DEC = "decimal(18,2)"
AS_OF_DATE = "2000-12-31"


def shrink_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lost units: returned lines with a reason by promotion code."""
    promo = F.col("promo_type")
    lost = F.col("quantity") % 5 + 1
    return retail.lines(spark, folder, store=False).where("return_flag = 'R'").select(
        "store_id", "plu", "category", "sub_category", "yyyymm",
        F.when(promo == "T", "Damaged").when(promo == "M", "Theft").when(promo == "O", "Expired").otherwise("Admin error").alias("reason"),
        lost.alias("qty_lost"), (F.col("unit_cost") * lost.cast("decimal(4,0)")).cast(DEC).alias("shrink_value"),
    )


def stock(spark: SparkSession, folder: str) -> DataFrame:
    """On-hand position of every product a store has sold."""
    pairs = retail.sales_lines(spark, folder, store=False).groupBy("store_id", "plu").agg(
        F.sum("quantity").alias("units"), F.sum("sales").alias("sales"), F.max("unit_cost").alias("unit_cost"), F.max("category").alias("category"),
        F.max("supplier_id").alias("supplier_id"), F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"),
        F.sum(F.when(F.col("sale_date") > F.lit("2001-05-03").cast("date"), F.col("quantity")).otherwise(0)).alias("units_90d"),
    )
    return pairs.select(
        "*", F.pmod(F.col("plu") * 7 + F.col("store_id") * 13, F.lit(60)).alias("on_hand"),
        (3 + F.col("plu") % 12).alias("lead_days"), F.when(F.col("plu") % 2 == 0, 6).otherwise(12).alias("case_size"),
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One payable per transaction: terms by priority, paid on the last shipment."""
    per = retail.raw_lines(spark, folder).groupBy("txn_id").agg(
        F.sum("sales").alias("amount"), F.max("ship_date").alias("paid_calc"), F.min("supplier_id").alias("supplier_id")
    )
    h = retail.headers(spark, folder).join(retail.stores(spark, folder).select("store_id", "region"), "store_id")
    p = F.col("priority")
    terms = F.when(p.isin("1-URGENT", "2-HIGH"), 30).when(p == "3-MEDIUM", 45).otherwise(60)
    return per.join(h, "txn_id").select(
        F.concat(F.lit("INV-"), F.col("txn_id").cast("string")).alias("invoice_number"), "supplier_id", "store_id", "region",
        F.col("sale_date").alias("invoice_date"), F.concat(F.lit("Net "), terms.cast("string")).alias("payment_terms"),
        F.date_add("sale_date", terms).alias("due_date"), "paid_calc", "amount",
    )


def fee_payments(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a store sends money: those with an urgent order."""
    return retail.headers(spark, folder).where("priority = '1-URGENT'").select("store_id", F.col("sale_date").alias("pay_date")).distinct()


def online_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Delivery orders with partner, lateness and satisfaction."""
    per = retail.raw_lines(spark, folder).groupBy("txn_id").agg(F.sum("sales").alias("order_value"), F.max("ship_date").alias("shipped"))
    h = retail.headers(spark, folder).where(F.col("priority").isin("1-URGENT", "2-HIGH"))
    k = F.col("customer_id") % 3
    return per.join(h, "txn_id").select(
        "txn_id", "store_id", F.col("sale_date").alias("order_date"), F.when(k == 0, "Partner A").when(k == 1, "Partner B").otherwise(" ").alias("delivery_partner"),
        "order_value", F.when(F.col("shipped") > F.date_add("sale_date", 1000), "Y").otherwise("N").alias("fulfilled_late"),
        (F.col("txn_id") % 5 + 1).alias("satisfaction"),
    )


def email_log(spark: SparkSession, folder: str) -> DataFrame:
    """Mail activity per campaign; the log is moved into the span of the sales."""
    u = F.col("user_id")
    day = F.date_sub("day", (F.lit(9000) - (u % 8) * 90).cast("int"))
    code = F.element_at(F.array(F.lit("T"), F.lit("M"), F.lit("O")), (u % 3 + 1).cast("int"))
    ev = retail.event_days(spark, folder).withColumn("send_date", day)
    t = F.col("event_type")
    flag = lambda c: F.when(c, "Y").otherwise("N")
    return ev.select(
        retail.event_id(code, F.col("send_date")).alias("campaign_id"), "send_date", "user_id",
        flag(t.isin("view", "click", "purchase")).alias("opened"), flag(t.isin("click", "purchase")).alias("clicked"), flag(t == "purchase").alias("converted"),
    )


def shifts(spark: SparkSession, folder: str) -> DataFrame:
    """Scheduled shifts: one per logged activity, hours and rate by employee."""
    h = F.col("hour")
    hours = (F.col("event_id") % 8 + 1).cast("decimal(6,1)")
    away = F.col("event_id") % 13 == 0
    return retail.event_days(spark, folder).select(
        "store_id", "day", F.col("user_id").alias("employee_id"), F.when(h < 8, "Morning").when(h < 16, "Day").otherwise("Evening").alias("shift_name"),
        hours.alias("scheduled_hours"), (F.col("user_id") % 10 + 15).cast("decimal(6,2)").alias("hourly_rate"),
        (hours * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(8,2)").alias("vacation_accrued"),
        F.when(away, hours).otherwise(F.lit(0)).cast("decimal(8,1)").alias("vacation_used"),
    )


def purchase_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as supply: supplier, order month, units, cost and days to ship."""
    return retail.lines(spark, folder, store=False).select(
        "store_id", "supplier_id", "plu", "category", "yyyymm", "sale_date", "quantity", "cost", "sales", "return_flag",
        F.datediff("ship_date", "sale_date").alias("ship_days"),
    )
