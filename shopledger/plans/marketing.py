"""Promotion, email, online and churn-dashboard marts (MRT-17, 19..21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import fixed, money, norm_blank, pct, safe_div, season, yyyymm
from shopledger.operators.aggregates import argmax_of

ONE = "*"


def promotions(lines: DataFrame) -> DataFrame:
    """MRT-19: dates, reach, sales, margin, depth and mechanic of each event."""
    promo = lines.where("event_id <> ''")
    per = promo.groupBy("event_id", "txn_id", "customer_id", "store_id").agg(
        F.min("sale_date").alias("a"), F.max("sale_date").alias("b"), F.sum("quantity").alias("q"), F.sum("sales").alias("s"), F.sum("cost").alias("c"),
        F.sum("regular_value").alias("r"), F.sum("discount").alias("d"), *[F.count_if(F.col("promo_type") == k).alias(f"n_{k}") for k in ("T", "M", "O")],
    )
    g = per.groupBy("event_id").agg(
        F.min("a").alias("start_date"), F.max("b").alias("end_date"), F.countDistinct("store_id").alias("stores_participating"), F.countDistinct("customer_id").alias("distinct_customers"),
        F.count(ONE).alias("total_transactions"), F.sum("q").alias("units_sold"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.sum("d").alias("d"),
        *[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("T", "M", "O")],
    )
    t, m, o = F.col("n_T"), F.col("n_M"), F.col("n_O")
    mechanic = F.when((t >= m) & (t >= o), "Temporary Price Reduction").when(m >= o, "Manager Markdown").otherwise("Price Override")
    top = argmax_of(promo, ["event_id"], "category", F.col("sales"), "top_category").drop("measure")
    s, c = F.col("s"), F.col("c")
    subsidy = (F.col("d") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(18,2)")
    return g.join(top, "event_id", "left").select(
        F.col("event_id").alias("promo_id"), season(F.month("start_date")).alias("season"), mechanic.alias("mechanic"), F.when(subsidy > 0, "Vendor Co-op").otherwise("Corporate").alias("funding_source"),
        F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "stores_participating", "distinct_customers", "total_transactions", "units_sold",
        money(s).alias("promo_sales"), money(s - c).alias("promo_margin"), pct(s - c, s).alias("margin_pct"), pct(F.col("d"), F.col("r")).alias("discount_depth_pct"),
        subsidy.cast("double").alias("marketing_subsidy"), "top_category",
    )


def email_measures() -> list:
    return [
        F.count(ONE).alias("sent"), F.count_if(F.col("opened") == "Y").alias("opened"), F.count_if(F.col("clicked") == "Y").alias("clicked"), F.count_if(F.col("converted") == "Y").alias("converted"),
    ]


def campaigns(email: DataFrame, promos: DataFrame) -> DataFrame:
    """MRT-20: campaign results with rates and cost per conversion."""
    e = email.groupBy(F.col("campaign_id").alias("promo_id")).agg(*email_measures())
    return promos.join(e, "promo_id", "left").select(
        F.col("promo_id").alias("campaign_id"), "mechanic", "marketing_subsidy", "sent", "opened", "clicked", "converted", pct(F.col("opened"), F.col("sent")).alias("open_rate_pct"),
        pct(F.col("clicked"), F.col("opened")).alias("click_through_pct"), pct(F.col("converted"), F.col("sent")).alias("conversion_rate_pct"),
        safe_div(F.col("marketing_subsidy"), F.col("converted"), 2).alias("subsidy_per_conversion"), "promo_sales", "promo_margin",
    )


def dash_email(email: DataFrame, promos: DataFrame) -> DataFrame:
    """MRT-20: mail counts by campaign and month, known campaigns only."""
    known = promos.select(F.col("promo_id").alias("campaign_id"), "mechanic")
    return email.join(known, "campaign_id").groupBy("campaign_id", "mechanic", yyyymm(F.col("send_date")).alias("send_yyyymm")).agg(*email_measures())


def campaign_roi(promos: DataFrame, floor: float, n: int) -> DataFrame:
    """MRT-20: margin per unit of subsidy, thin campaigns left out."""
    return promos.where(F.col("marketing_subsidy") >= floor).select(
        "promo_id", "promo_margin", "marketing_subsidy", safe_div(F.col("promo_margin"), F.col("marketing_subsidy"), 4).alias("roi"),
        safe_div(F.col("marketing_subsidy"), F.col("total_transactions"), 4).alias("subsidy_per_conversion"),
    ).orderBy(F.col("roi").desc(), "promo_id").limit(n)


def dash_ecom(orders: DataFrame) -> DataFrame:
    """MRT-21: online orders by month and partner, blank partner is pickup."""
    p = norm_blank(F.col("delivery_partner"))
    return orders.groupBy(yyyymm(F.col("order_date")).alias("yyyymm"), F.when(p == "", "Pickup").otherwise(p).alias("delivery_partner")).agg(
        F.count(ONE).alias("orders"), money(F.sum("order_value")).alias("order_value"), F.count_if(F.col("fulfilled_late") == "Y").alias("late_orders"), safe_div(F.sum("satisfaction"), F.count(ONE), 4).alias("avg_satisfaction"),
    )


def ecom_share(dash: DataFrame, sales: DataFrame) -> DataFrame:
    """MRT-21: online share of the month's sales."""
    e = dash.groupBy("yyyymm").agg(F.sum(F.col("order_value").cast("decimal(18,2)")).alias("v"))
    return e.join(sales, "yyyymm", "left").select("yyyymm", pct(F.col("v"), F.col("sales")).alias("ecom_share_pct"))


def partners(dash: DataFrame) -> DataFrame:
    """MRT-21: late share and order-weighted satisfaction per partner."""
    return dash.where("delivery_partner <> 'Pickup'").groupBy("delivery_partner").agg(
        F.sum("orders").alias("orders"), pct(F.sum("late_orders"), F.sum("orders")).alias("late_pct"),
        safe_div(F.sum((F.col("avg_satisfaction").cast("decimal(10,4)") * F.col("orders"))), F.sum("orders"), 4).alias("avg_satisfaction"),
    )


def dash_churn(scores: DataFrame, customers: DataFrame, ipt: DataFrame) -> DataFrame:
    """MRT-17: scores beside region, tier and the expected next purchase."""
    return scores.join(customers, "customer_id").join(ipt.select("customer_id", "expected_next_jdn", "lifecycle_status"), "customer_id", "left")


def churn_tiles(dash: DataFrame) -> dict[str, DataFrame]:
    """MRT-17: the tiles over the churn mart."""
    hot = F.col("risk_band").isin("Critical", "High")
    ltv = F.col("ltv_at_risk").cast("decimal(18,2)")
    prob = F.col("churn_probability").cast("decimal(10,4)")
    return {
        "kpi": dash.agg(
            F.count(ONE).alias("scored_customers"), pct(F.count_if(hot), F.count(ONE)).alias("critical_high_pct"), money(F.sum(F.when(hot, ltv).otherwise(F.lit(0)))).alias("ltv_at_risk"),
            pct(F.count_if(F.col("overdue_ratio") > 1), F.count(ONE)).alias("pct_overdue"), safe_div(F.sum(prob), F.count(ONE), 4).alias("avg_churn_prob"),
        ),
        "bands": dash.groupBy("risk_band").agg(F.count(ONE).alias("customers"), money(F.sum(ltv)).alias("ltv_at_risk")),
        "actions": dash.where("recommended_action <> 'None'").groupBy("recommended_action").agg(F.count(ONE).alias("customers"), money(F.sum(ltv)).alias("ltv_at_risk")),
        "drivers": dash.where("risk_band = 'Critical'").groupBy("driver_1").agg(F.count(ONE).alias("customers")),
    }
