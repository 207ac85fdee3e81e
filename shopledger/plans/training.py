"""Point-in-time training sets (MRT-14..16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import money, pct, safe_div
from shopledger.operators.joins import lookback_join
from shopledger.operators.windows import nth
from shopledger.plans.customers import horizon
from shopledger.session import cut_lineage

ONE = "*"


def customer_days(txn: DataFrame) -> DataFrame:
    """One row per customer and day with everything the churn set sums; ``baskets`` and ``day_value`` count regular sales only."""
    sale = F.col("txn_type") == "Regular Sale"
    return txn.groupBy("customer_id", "jdn").agg(
        F.count_if(sale).alias("baskets"), F.sum(F.when(sale, F.col("basket_value"))).alias("day_value"), F.count(ONE).alias("txns"), F.count_if(F.col("txn_type") == "Regular Return").alias("returns"),
        F.sum("basket_margin").alias("margin"), F.sum("promo_value").alias("promo"), F.sum("discount_total").alias("discount"), F.count_if(F.col("channel") == "Delivery").alias("ecommerce"),
        F.sum("basket_items").alias("items"), F.count_if(F.weekday("sale_date") >= 5).alias("weekend_txns"),
    )


def asof_states(days: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """What each customer's whole history says at each cutoff, from states that are carried on.

    A day belongs to one segment, the one that ends with the first cutoff on or
    after it. Segments are summed, sums run over the customer's segments, and a
    state stands for every cutoff until the next segment, so no day is copied.
    Gaps of a segment travel as one list; the exact median is read from the lists so far.
    """
    cuts = sorted(cutoffs)
    by_day = Window.partitionBy("customer_id").orderBy("jdn")
    marks = F.array(*[F.lit(c) for c in cuts])
    seg = F.size(F.filter(marks, lambda c: c < F.col("jdn")))
    rows = days.select("customer_id", "jdn", "baskets", "day_value", (F.col("jdn") - F.lag("jdn").over(by_day)).alias("gap"), F.lead("jdn").over(by_day).alias("next_jdn"), seg.alias("seg"))
    parts = rows.where(F.col("seg") < len(cuts)).groupBy("customer_id", "seg").agg(
        F.count(ONE).alias("d"), F.sum("baskets").alias("b"), F.sum("day_value").alias("v"), F.min("jdn").alias("lo"), F.max("jdn").alias("hi"), F.collect_list("gap").alias("gaps"), F.sum("gap").alias("g"),
        F.count("gap").alias("n"), F.max("gap").alias("most"), F.max_by("gap", "jdn").alias("ipt_last_asof"), F.max_by("next_jdn", "jdn").alias("next_jdn"),
    )
    by_seg = Window.partitionBy("customer_id").orderBy("seg")
    so_far = by_seg.rowsBetween(Window.unboundedPreceding, 0)
    state = parts.select(
        "customer_id", "seg", F.coalesce(F.lead("seg").over(by_seg), F.lit(len(cuts))).alias("until"), F.sum("d").over(so_far).alias("purchase_days_asof"), F.sum("b").over(so_far).alias("baskets_asof"),
        F.sum("v").over(so_far).alias("sales_asof"), F.min("lo").over(so_far).alias("first_jdn"), F.col("hi").alias("last_jdn"), F.array_sort(F.flatten(F.collect_list("gaps").over(so_far))).alias("gaps"),
        (F.sum("g").over(so_far) / F.sum("n").over(so_far)).alias("mean"), F.max("most").over(so_far).alias("ipt_max_asof"), "ipt_last_asof", "next_jdn",
    ).where("purchase_days_asof >= 2")
    n = F.size("gaps")
    middle = (F.get("gaps", F.floor((n - 1) / 2).cast("int")) + F.get("gaps", F.floor(n / 2).cast("int"))) / F.lit(2.0)
    each = F.explode(F.sequence("seg", F.col("until") - 1))
    return state.withColumn("median", middle).drop("gaps").withColumn("_at", each).withColumn("as_of", F.get(marks, F.col("_at"))).drop("_at", "seg", "until")


def churn_training(txn: DataFrame, cutoffs: Sequence[int], scoring: int, max_jdn: Column) -> DataFrame:
    """MRT-14: stacked snapshots with features from on or before each cutoff
    and labels from strictly after it.

    Transactions are summed to customer-days once. The whole history comes from
    states that are carried from cutoff to cutoff; only days of the last 180 days
    before a cutoff meet it by themselves.
    """
    days = cut_lineage(customer_days(txn))
    j, a, v = F.col("jdn"), F.col("as_of"), F.col("day_value")
    zero = F.lit(0).cast("decimal(28,4)")
    sale = F.col("baskets") > 0
    prior = (j > a - 180) & (j <= a - 90)
    within = lambda cond: F.sum(F.when(cond & sale, v).otherwise(zero))
    # every transaction type counts in the basket behaviour block
    recent = lookback_join(days, cutoffs, "jdn", 180).groupBy("as_of", "customer_id").agg(
        *[F.count_if(sale & (j > a - n)).alias(f"purchase_days_l{n}") for n in (30, 90, 180)], F.count_if(sale & prior).alias("purchase_days_prior90"),
        *[within(j > a - n).alias(f"sales_l{n}") for n in (30, 90, 180)], within(prior).alias("sales_prior90"),
        F.sum("txns").alias("txns_l180"), F.sum("returns").alias("returns_l180"), F.sum("margin").alias("margin_l180"), F.sum("promo").alias("promo_l180"), F.sum("discount").alias("discount_l180"),
        F.sum("ecommerce").alias("ecommerce_l180"), F.sum("items").alias("items_l180"), F.sum("weekend_txns").alias("weekend_txns_l180"),
    )
    h = asof_states(days.where(sale), cutoffs).join(recent, ["as_of", "customer_id"], "left")
    silent, hz, nxt = F.col("days_since_last"), F.col("churn_horizon_days"), F.col("next_purchase_days")
    h = (
        h.withColumn("churn_horizon_days", horizon(F.col("median")))
        .withColumn("days_since_last", a - F.col("last_jdn")).withColumn("tenure_days", a - F.col("first_jdn"))
        .withColumn("next_purchase_days", F.col("next_jdn") - a).withColumn("max_jdn", max_jdn)
    )

    def label(days_out: Column) -> Column:
        censored = (a == scoring) | (a + days_out > F.col("max_jdn"))
        return F.when(~censored, F.when(nxt.isNull() | (nxt > days_out), 1).otherwise(0))

    zint = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    zmon = lambda c: money(F.coalesce(F.col(c), zero)).alias(c)
    return h.select(
        "as_of", "customer_id", F.when(a == scoring, "Y").otherwise("N").alias("is_scoring_row"),
        "purchase_days_asof", "baskets_asof", money(F.col("sales_asof")).alias("sales_asof"), "tenure_days", "days_since_last",
        F.round("median", 1).alias("ipt_median_asof"), F.round("mean", 4).alias("ipt_mean_asof"), "ipt_max_asof", "ipt_last_asof",
        F.round(silent.cast("double") / F.greatest(F.lit(1.0), F.col("median")), 6).alias("overdue_ratio"), "churn_horizon_days",
        *[zint(c) for c in ("purchase_days_l30", "purchase_days_l90", "purchase_days_l180", "purchase_days_prior90")],
        *[zmon(c) for c in ("sales_l30", "sales_l90", "sales_l180", "sales_prior90")],
        safe_div(F.col("purchase_days_l90"), F.col("purchase_days_prior90"), 6).alias("trend_ratio_l90"),
        safe_div(F.col("sales_asof"), F.col("baskets_asof"), 2).alias("avg_basket_asof"),
        (F.col("purchase_days_asof") - 1).alias("bgnbd_frequency"), (F.col("last_jdn") - F.col("first_jdn")).alias("bgnbd_recency"), (a - F.col("first_jdn")).alias("bgnbd_t"),
        zint("txns_l180"), zint("returns_l180"), zmon("margin_l180"), zmon("discount_l180"), zint("ecommerce_l180"), zint("weekend_txns_l180"),
        pct(F.coalesce(F.col("promo_l180"), zero), F.col("sales_l180")).alias("promo_share_l180"),
        safe_div(F.col("items_l180"), F.col("txns_l180"), 6).alias("avg_items_l180"),
        nxt, label(F.lit(90)).alias("churn_90"), label(hz).alias("churn_adaptive"),
        F.when(nxt.isNull(), F.col("max_jdn") - a).alias("censored_after_days"),
    )


def activation_training(txn: DataFrame, max_jdn: Column, days: int = 90) -> DataFrame:
    """MRT-15: first-basket features and whether a second purchase day follows
    within ``days``."""
    sale = txn.where("txn_type = 'Regular Sale'")
    cols = ["jdn", "txn_id", "store_id", "basket_value", "basket_items", "basket_margin", "discount_total", "promo_flag", "distinct_categories", "distinct_plus", "channel"]
    first = sale.groupBy("customer_id").agg(F.min(F.struct(*cols)).alias("f")).select("customer_id", "f.*")
    # distinct days first: a customer has no more of them than the calendar
    second = nth(sale.select("customer_id", "jdn").distinct(), ["customer_id"], "jdn", 2).withColumnRenamed("jdn", "j2")
    out = first.join(second, "customer_id", "left").withColumn("max_jdn", max_jdn)
    gap = F.col("j2") - F.col("jdn")
    return out.select(
        "customer_id", F.col("jdn").alias("first_jdn"), (F.col("max_jdn") - F.col("jdn")).alias("days_since_first"), "store_id",
        money(F.col("basket_value")).alias("first_basket_value"), F.col("basket_items").alias("first_basket_items"),
        money(F.col("basket_margin")).alias("first_basket_margin"), money(F.col("discount_total")).alias("first_discount"),
        F.col("promo_flag").alias("first_promo_flag"), F.col("distinct_categories").alias("first_categories"), F.col("channel").alias("first_channel"),
        gap.alias("days_to_second"),
        F.when(F.col("jdn") + days <= F.col("max_jdn"), F.when(F.coalesce(gap <= days, F.lit(False)), 1).otherwise(0)).alias("activated_90"),
        F.when(gap.isNull(), "Y").otherwise("N").alias("is_one_time"),
    )


def clv_training(cm: DataFrame, as_of: Sequence[int], horizon_months: int = 6) -> DataFrame:
    """MRT-16: history to each as-of month and forward margin after it;
    customers silent in the forward window keep a zero target.

    History and target come from one pass: each customer-month is exploded to
    the as-of months it can serve and summed conditionally.
    """
    seq, a = F.col("month_seq"), F.col("as_of_seq")
    marks = F.array(*[F.lit(x) for x in as_of])
    rows = cm.withColumn("as_of_seq", F.explode(F.filter(marks, lambda x: F.col("month_seq") <= x + horizon_months)))
    past, future = seq <= a, seq > a
    dec = F.lit(0).cast("decimal(28,4)")

    def back(c: str, n: int | None, zero=dec) -> Column:
        cond = past if n is None else past & (seq > a - n)
        return F.sum(F.when(cond, F.col(c)).otherwise(zero))

    zero_i = F.lit(0)
    g = rows.groupBy("customer_id", "as_of_seq").agg(
        F.count_if(past).alias("months_observed"), F.max(F.when(past, F.col("months_since_first"))).alias("months_since_first"),
        *[back("sales", n).alias(f"sales_{k}") for k, n in (("life", None), ("l3", 3), ("l6", 6), ("l12", 12))],
        *[back("margin", n).alias(f"margin_{k}") for k, n in (("life", None), ("l3", 3), ("l6", 6), ("l12", 12))],
        *[back("transactions", n, zero_i).alias(f"txns_{k}") for k, n in (("life", None), ("l6", 6), ("l12", 12))],
        back("purchase_days", 6, zero_i).alias("purchase_days_l6"), back("returns", 6, zero_i).alias("returns_l6"),
        back("promo_sales", 6).alias("promo_sales_l6"), back("discount", 6).alias("discount_l6"),
        F.count_if(past & (seq > a - 6) & (F.col("transactions") > 0)).alias("active_months_l6"),
        F.max(F.when(seq == a, F.col("days_since_last_purchase"))).alias("days_since_last"),
        F.sum(F.when(future, F.col("margin")).otherwise(dec)).alias("future_margin"), F.sum(F.when(future, F.col("sales")).otherwise(dec)).alias("future_sales"),
        F.sum(F.when(future, F.col("transactions")).otherwise(zero_i)).alias("future_txns"),
        F.max(F.when(future & (F.col("transactions") > 0), 1).otherwise(0)).alias("future_active"),
    ).where("months_observed > 0")
    decimals = [c for c in g.columns if c.startswith(("sales_", "margin_", "promo_", "discount_")) or c in ("future_margin", "future_sales")]
    return g.select(*[money(F.col(c)).alias(c) if c in decimals else F.col(c) for c in g.columns])
