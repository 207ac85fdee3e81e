"""Customer marts (MRT-08..13, MRT-44, MRT-45)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import blank_to_null, half_up, money, nonzero, pct, safe_div, yyyymm
from shopledger.operators.joins import assemble
from shopledger.operators.ordered import exact_ntile
from shopledger.operators.windows import running_max
from shopledger.session import cut_lineage

ONE = "*"


def customer_kpi(lines: DataFrame) -> DataFrame:
    """MRT-08: lifetime measures per customer.

    The lines of one transaction are summed first, so the customer step counts
    rows; an id that holds a third of all lines is combined before it moves.
    """
    promo = F.sum(F.when(F.col("promo_type") != "", F.col("sales")).otherwise(F.lit(0)))
    per = lines.groupBy("customer_id", "txn_id", "store_id", "sale_date").agg(
        F.sum("quantity").alias("q"), F.sum("sales").alias("s"), F.sum("cost").alias("c"), F.sum("discount").alias("d"), promo.alias("p")
    )
    return per.groupBy("customer_id").agg(
        F.count(ONE).alias("total_transactions"), F.sum("q").alias("total_items"), F.sum("s").alias("total_sales"),
        F.sum("c").alias("total_cost"), F.sum("d").alias("total_discount"), F.sum("p").alias("promo_sales"),
        F.countDistinct("store_id").alias("distinct_stores"),
        F.min("sale_date").alias("first_purchase_date"), F.max("sale_date").alias("last_purchase_date"),
    )


def present_kpi(kpi: DataFrame) -> DataFrame:
    """MRT-08: the KPI row with fixed decimals and ratios."""
    s, c = F.col("total_sales"), F.col("total_cost")
    return kpi.select(
        "customer_id", "total_transactions", "total_items", money(s).alias("total_sales"), money(s - c).alias("gross_margin"),
        pct(s - c, s).alias("margin_pct"), safe_div(F.round(s, 2), F.col("total_transactions"), 6).alias("avg_basket"),
        money(F.col("total_discount")).alias("total_discount"), pct(F.col("promo_sales"), s).alias("promo_sales_pct"), "distinct_stores",
        F.col("first_purchase_date").cast("string").alias("first_purchase_date"), F.col("last_purchase_date").cast("string").alias("last_purchase_date"),
    )


def rfm(kpi: DataFrame) -> DataFrame:
    """MRT-09: recency, frequency and monetary quintiles, segment and tier.

    Quintiles break ties by customer, so they are the same on every run.
    """
    base = kpi.select("customer_id", F.unix_date("last_purchase_date").alias("r"), F.col("total_transactions").alias("f"), F.col("total_sales").alias("mo"))
    base = cut_lineage(base)
    rec = exact_ntile(base, ["r", "customer_id"], {"rfm_recency": 5}, cut=False).select("customer_id", "rfm_recency")
    freq = exact_ntile(base, ["f", "customer_id"], {"rfm_frequency": 5}, cut=False).select("customer_id", "rfm_frequency")
    mon = exact_ntile(base, ["mo", "customer_id"], {"rfm_monetary": 5, "m20": 20}, cut=False).select("customer_id", "rfm_monetary", "m20")
    r, f, m = F.col("rfm_recency"), F.col("rfm_frequency"), F.col("rfm_monetary")
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champion").when((r >= 4) & (f >= 3), "Loyal").when(r >= 4, "Recent")
        .when((r <= 2) & (f >= 4), "At Risk").when((r <= 2) & (f <= 2), "Lost").otherwise("Regular")
    )
    m20 = F.col("m20")
    tier = F.when(m20 == 20, "Platinum").when(m20 >= 17, "Gold").when(m20 >= 11, "Silver").otherwise("Bronze")
    return rec.join(freq, "customer_id").join(mon, "customer_id").select(
        "customer_id", r, f, m, segment.alias("rfm_segment"), tier.alias("loyalty_tier")
    )


def horizon(median: Column) -> Column:
    """Days without a purchase that count as churn: 3 medians, 90 to 180."""
    return F.least(F.lit(180), F.greatest(F.lit(90), (3 * median).cast("int")))


def purchase_days(txn: DataFrame) -> DataFrame:
    """Customer-day grain of regular sales; bounded by the calendar per customer."""
    return txn.where("txn_type = 'Regular Sale'").groupBy("customer_id", "jdn").agg(
        F.count(ONE).alias("baskets"), F.sum("basket_value").alias("day_value")
    )


def ipt_stats(txn: DataFrame, as_of: Column) -> DataFrame:
    """MRT-10: inter-purchase profile as of one Julian day."""
    days = purchase_days(txn)
    w = Window.partitionBy("customer_id").orderBy("jdn")
    gaps = days.withColumn("as_of", as_of).withColumn("gap", F.col("jdn") - F.lag("jdn").over(w))
    j, a, g = F.col("jdn"), F.col("as_of"), F.col("gap")
    zero = F.lit(0).cast("decimal(28,4)")
    agg = gaps.groupBy("customer_id").agg(
        F.count(ONE).alias("purchase_days"), F.sum("baskets").alias("baskets"), F.min("jdn").alias("first_jdn"), F.max("jdn").alias("last_jdn"),
        F.percentile("gap", F.lit(0.5)).alias("median"), F.avg("gap").alias("mean"), F.avg(g * g).alias("sq"),
        F.min("gap").alias("ipt_min_days"), F.max("gap").alias("ipt_max_days"), F.max_by("gap", "jdn").alias("ipt_last_days"),
        F.count_if(j > a - 90).alias("purchases_l90"), F.count_if((j > a - 180) & (j <= a - 90)).alias("purchases_prior90"),
        F.count_if(j > a - 180).alias("purchases_l180"), F.sum(F.when(j > a - 90, F.col("day_value")).otherwise(zero)).alias("value_l90"),
        F.max("as_of").alias("as_of"),
    )
    s = agg.withColumn("days_silent", F.col("as_of") - F.col("last_jdn")).withColumn("tenure_days", F.col("as_of") - F.col("first_jdn"))
    repeat = F.col("purchase_days") >= 2
    s = s.withColumn("churn_horizon_days", F.when(repeat, horizon(F.col("median"))))
    ratio = F.col("days_silent").cast("double") / F.greatest(F.lit(1.0), F.col("median"))
    silent, hz = F.col("days_silent"), F.col("churn_horizon_days")
    status = (
        F.when(F.col("purchase_days") == 1, "One-time").when(F.col("tenure_days") < 90, "New").when(silent >= hz, "Churned")
        .when((silent >= F.floor(hz / 2)) & (ratio >= 1.5), "Lapsing").otherwise("Active")
    )
    return s.select(
        "customer_id", "purchase_days", "baskets", "first_jdn", "last_jdn", "tenure_days", "days_silent",
        F.round("median", 1).alias("ipt_median_days"), F.round("mean", 4).alias("ipt_mean_days"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean"))), 4).alias("ipt_stddev_days"),
        "ipt_min_days", "ipt_max_days", "ipt_last_days",
        F.when(repeat, F.col("last_jdn") + F.col("median").cast("int")).alias("expected_next_jdn"),
        F.when(repeat, F.round(ratio, 6)).alias("overdue_ratio"), "churn_horizon_days",
        "purchases_l90", "purchases_prior90", "purchases_l180", money(F.col("value_l90")).alias("value_l90"),
        safe_div(F.col("purchases_l90"), F.col("purchases_prior90"), 6).alias("trend_ratio_l90_vs_prior"),
        status.alias("lifecycle_status"),
    )


def _basket_habits() -> list[Column]:
    """Where and how a customer bought in a month; the stores of one customer are few, so their set is one value."""
    return [
        F.size(F.collect_set("store_id")).cast("bigint").alias("distinct_stores"), F.count_if(F.col("store_id") == F.col("home_store")).alias("home_store_txns"),
        F.count_if(F.col("channel") == "Delivery").alias("ecommerce_orders"), safe_div(F.sum("distinct_categories"), F.count(ONE), 2).alias("avg_categories_per_basket"),
    ]


def customer_month(txn: DataFrame, months: DataFrame, satellites: Sequence[tuple[DataFrame, Sequence[str]]], min_txns: int = 2) -> DataFrame:
    """MRT-11: one row per eligible customer and month from the first purchase
    month on, zero months included.

    ``satellites`` are per customer-month aggregates with the columns that
    default to zero.  A customer never has more rows than the calendar has
    months, whatever its number of transactions.
    """
    sale = F.col("txn_type") == "Regular Sale"
    totals = txn.groupBy("customer_id").agg(
        F.count(ONE).alias("n"), F.min(F.when(sale, F.col("yyyymm"))).alias("first_ym")
    ).where((F.col("n") >= min_txns) & F.col("first_ym").isNotNull())
    last_seq = months.agg(F.max("month_seq").alias("x")).scalar()
    first_year = months.agg(F.min(F.floor(F.col("yyyymm") / 100) * 12 + F.col("yyyymm") % 100).alias("x")).scalar()
    start = (F.floor(F.col("first_ym") / 100) * 12 + F.col("first_ym") % 100 - first_year + 1).cast("int")
    spine = (
        totals.withColumn("first_seq", start)
        .withColumn("month_seq", F.explode(F.sequence(F.col("first_seq"), last_seq)))
        .join(months.select("month_seq", "yyyymm", F.datediff("month_end", F.lit("1970-01-01").cast("date")).alias("_e")), "month_seq")
        .select("customer_id", "yyyymm", "month_seq", (F.col("month_seq") - F.col("first_seq")).alias("months_since_first"), (F.col("_e") + 2440588).alias("month_end_jdn"))
    )
    zero = F.lit(0).cast("decimal(28,4)")
    rollup = txn.groupBy("customer_id", "yyyymm").agg(
        F.count_if(sale).alias("transactions"), F.count_if(F.col("txn_type") == "Regular Return").alias("returns"),
        F.countDistinct(F.when(sale, F.col("jdn"))).alias("purchase_days"), F.sum("basket_value").alias("sales"), F.sum("basket_margin").alias("margin"),
        F.sum("promo_value").alias("promo_sales"), F.sum("discount_total").alias("discount"), F.sum("basket_items").alias("items"),
        F.max(F.when(sale, F.col("jdn"))).alias("last_sale"), *(_basket_habits() if "distinct_categories" in txn.columns else ()),
    )
    zeros = ["transactions", "returns", "purchase_days", "items", "distinct_stores", "home_store_txns", "ecommerce_orders"] + [c for _, cols in satellites for c in cols]
    out = assemble(spine, [rollup, *[s for s, _ in satellites]], ["customer_id", "yyyymm"], zeros)
    for c in ("sales", "margin", "promo_sales", "discount"):
        out = out.withColumn(c, F.coalesce(F.col(c), zero))
    out = running_max(out, ["customer_id"], "month_seq", "last_sale", "_last")
    return out.withColumn("days_since_last_purchase", F.col("month_end_jdn") - F.col("_last")).withColumn(
        "active_flag", F.when(F.col("transactions") > 0, "Y").otherwise("N")
    ).drop("_last", "last_sale", "month_end_jdn")


def cohort(cm: DataFrame, first_year: DataFrame) -> DataFrame:
    """MRT-12: retention by cohort year and months since the first purchase."""
    active = F.count_if(F.col("active_flag") == "Y")
    return cm.join(first_year, "customer_id").groupBy("cohort_year", "months_since_first").agg(
        F.count(ONE).alias("customers"), active.alias("active_customers"), pct(active, F.count(ONE)).alias("active_pct")
    )


def spend_profile(lines: DataFrame, flags: dict[str, Column], flagged: Column, categories: dict[str, Column], rules, basket_rules) -> DataFrame:
    """MRT-13: spend composition over flagged spend, with a coverage guard.

    ``flags`` and ``categories`` name conditions on a line; ``rules`` and
    ``basket_rules`` are ordered (condition, label) pairs over the percentages.
    """
    zero = F.lit(0).cast("decimal(18,4)")
    part = lambda c: F.sum(F.when(c, F.col("sales")).otherwise(zero))
    any_category = None
    for c in categories.values():
        any_category = c if any_category is None else any_category | c
    g = lines.groupBy("customer_id").agg(
        F.sum("sales").alias("total"), part(flagged).alias("flagged"), part(any_category).alias("categorised"),
        *[part(flagged & c).alias(f"f_{k}") for k, c in flags.items()], *[part(c).alias(f"c_{k}") for k, c in categories.items()],
    )
    p = g.select(
        "customer_id", money(F.col("total")).alias("total_spend"), pct(F.col("flagged"), F.col("total")).alias("coverage"),
        *[pct(F.col(f"f_{k}"), F.col("flagged")).alias(f"{k}_pct") for k in flags],
        *[pct(F.col(f"c_{k}"), F.col("categorised")).alias(f"{k}_pct") for k in categories],
    )

    def choose(pairs, default):
        out = None
        for cond, label in pairs:
            out = F.when(cond, label) if out is None else out.when(cond, label)
        return out.otherwise(default)

    return p.withColumn("diet_profile", choose(rules, "Mainstream")).withColumn("basket_profile", choose(basket_rules, "Balanced"))


def trade_area(lines: DataFrame, households: DataFrame) -> DataFrame:
    """MRT-44: shoppers, stores shopped, sales per shopper and penetration by area."""
    per = lines.groupBy("area", "customer_id", "store_id").agg(F.sum("sales").alias("s"))
    g = per.groupBy("area").agg(F.countDistinct("customer_id").alias("shoppers"), F.countDistinct("store_id").alias("stores_shopped"), F.sum("s").alias("s"))
    return g.join(households, "area", "left").select(
        "area", "shoppers", "stores_shopped", money(F.col("s")).alias("area_sales"),
        safe_div(F.col("s"), F.col("shoppers"), 2).alias("sales_per_shopper"), pct(F.col("shoppers"), F.col("households")).alias("penetration_pct"),
    )


def loyalty_ledger(txn: DataFrame) -> DataFrame:
    """MRT-45: points per transaction: ten per unit of spend, half up, negative
    spend as an adjustment."""
    spend = F.when(F.col("txn_type") == "Regular Return", -F.col("basket_value")).otherwise(F.col("basket_value"))
    return txn.where("txn_type <> 'Post Void TX'").select(
        "txn_id", "customer_id", "store_id", "yyyymm", "sale_date",
        F.when(spend >= 0, "EARN").otherwise("ADJUST").alias("entry_type"), half_up(spend * 10).alias("points"), spend.alias("spend"),
    )
