"""Registered queries for customer marts and training sets (MRT-08..16, 44, 45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import jdn, money, yyyymm
from shopledger.plans import customers as cu
from shopledger.plans import training as tr
from shopledger.queries.common import EV, EVENTS, L, LT, LTM, div, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_joins import CUT_SQL, cut_jdns
from shopledger.queries.registry import query
from shopledger.sources import retail
from shopledger.sources.tables import read_table

SCORING = 2451910  # 2000-12-31
KPI = """kpi AS (SELECT customer_id, count(DISTINCT txn_id) AS total_transactions, sum(quantity) AS total_items, sum(sales) AS total_sales, sum(cost) AS total_cost, sum(discount) AS total_discount,
sum(CASE WHEN promo_type <> '' THEN sales ELSE 0 END) AS promo_sales, count(DISTINCT store_id) AS distinct_stores, min(sale_date) AS a, max(sale_date) AS b FROM lines GROUP BY 1)"""


def kpi(spark, sf):
    return cu.customer_kpi(retail.lines(spark, sf, store=False))


@query("mrt08_customer_kpi", f"""{L}, {KPI}
SELECT customer_id, total_transactions, {n('total_items')} AS total_items, {m('total_sales')} AS total_sales, {m('total_sales - total_cost')} AS gross_margin, {spct('total_sales - total_cost', 'total_sales')} AS margin_pct,
{div('round(total_sales, 2)', 'total_transactions', 6)} AS avg_basket, {m('total_discount')} AS total_discount, {spct('promo_sales', 'total_sales')} AS promo_sales_pct, distinct_stores, CAST(a AS VARCHAR) AS first_purchase_date, CAST(b AS VARCHAR) AS last_purchase_date FROM kpi""")
def _(spark, sf):
    return cu.present_kpi(kpi(spark, sf))


RFM = f"""{KPI}, tiles AS (SELECT customer_id, ntile(5) OVER (ORDER BY b, customer_id) AS rfm_recency, ntile(5) OVER (ORDER BY total_transactions, customer_id) AS rfm_frequency,
ntile(5) OVER (ORDER BY total_sales, customer_id) AS rfm_monetary, ntile(20) OVER (ORDER BY total_sales, customer_id) AS m20 FROM kpi),
rfm AS (SELECT customer_id, rfm_recency, rfm_frequency, rfm_monetary,
CASE WHEN rfm_recency >= 4 AND rfm_frequency >= 4 AND rfm_monetary >= 4 THEN 'Champion' WHEN rfm_recency >= 4 AND rfm_frequency >= 3 THEN 'Loyal' WHEN rfm_recency >= 4 THEN 'Recent'
     WHEN rfm_recency <= 2 AND rfm_frequency >= 4 THEN 'At Risk' WHEN rfm_recency <= 2 AND rfm_frequency <= 2 THEN 'Lost' ELSE 'Regular' END AS rfm_segment,
CASE WHEN m20 = 20 THEN 'Platinum' WHEN m20 >= 17 THEN 'Gold' WHEN m20 >= 11 THEN 'Silver' ELSE 'Bronze' END AS loyalty_tier FROM tiles)"""


@query("mrt09_rfm", f"{L}, {RFM} SELECT * FROM rfm")
def _(spark, sf):
    return cu.rfm(kpi(spark, sf))


def last_day(spark, sf):
    return jdn(retail.span(spark, sf)[1])


DAYS_TXN = "days AS (SELECT customer_id, jdn, count(*) AS baskets, sum(basket_value) AS day_value FROM txn WHERE txn_type = 'Regular Sale' GROUP BY 1, 2)"
MAXJ = "(SELECT date_diff('day', DATE '1970-01-01', max(CAST(o_orderdate AS DATE))) + 2440588 FROM orders)"
IPT = f"""{DAYS_TXN}, gaps AS (SELECT *, jdn - lag(jdn) OVER (PARTITION BY customer_id ORDER BY jdn) AS gap, {MAXJ} AS as_of FROM days),
g AS (SELECT customer_id, count(*) AS purchase_days, sum(baskets) AS baskets, min(jdn) AS first_jdn, max(jdn) AS last_jdn, median(gap) AS med, avg(gap) AS mean, stddev_pop(gap) AS sd,
 min(gap) AS ipt_min_days, max(gap) AS ipt_max_days, arg_max_null(gap, jdn) AS ipt_last_days, count(*) FILTER (WHERE jdn > as_of - 90) AS purchases_l90,
 count(*) FILTER (WHERE jdn > as_of - 180 AND jdn <= as_of - 90) AS purchases_prior90, count(*) FILTER (WHERE jdn > as_of - 180) AS purchases_l180,
 sum(CASE WHEN jdn > as_of - 90 THEN day_value ELSE 0 END) AS value_l90, max(as_of) AS as_of FROM gaps GROUP BY 1),
s AS (SELECT *, as_of - last_jdn AS days_silent, as_of - first_jdn AS tenure_days, CASE WHEN purchase_days >= 2 THEN least(180, greatest(90, CAST(trunc(3 * med) AS BIGINT))) END AS hz,
 CAST(as_of - last_jdn AS DOUBLE) / greatest(1, coalesce(med, 1)) AS ratio FROM g),
ipt AS (SELECT customer_id, purchase_days, {n('baskets')} AS baskets, first_jdn, last_jdn, tenure_days, days_silent, round(med, 1) AS ipt_median_days, round(mean, 4) AS ipt_mean_days, round(sd, 4) AS ipt_stddev_days,
 ipt_min_days, ipt_max_days, ipt_last_days, CASE WHEN purchase_days >= 2 THEN last_jdn + CAST(trunc(med) AS BIGINT) END AS expected_next_jdn, CASE WHEN purchase_days >= 2 THEN round(ratio, 6) END AS overdue_ratio,
 hz AS churn_horizon_days, purchases_l90, purchases_prior90, purchases_l180, {m('value_l90')} AS value_l90, {div('purchases_l90', 'purchases_prior90', 6)} AS trend_ratio_l90_vs_prior,
 CASE WHEN purchase_days = 1 THEN 'One-time' WHEN tenure_days < 90 THEN 'New' WHEN days_silent >= hz THEN 'Churned' WHEN days_silent >= hz // 2 AND ratio >= 1.5 THEN 'Lapsing' ELSE 'Active' END AS lifecycle_status FROM s)"""


@query("mrt10_purchase_gap_profile", f"{LT}, {IPT} SELECT * REPLACE (CASE WHEN purchase_days > 1 THEN ipt_stddev_days END AS ipt_stddev_days) FROM ipt")
def _(spark, sf):
    out = cu.ipt_stats(retail.transactions(spark, sf), last_day(spark, sf))
    # one purchase day has no gap, so no deviation either
    return out.withColumn("ipt_stddev_days", F.when(F.col("purchase_days") > 1, F.col("ipt_stddev_days")))


SHIFT = 9000  # days that bring the activity log into the span of the orders


def satellites(spark, sf):
    """Email, points and late-delivery activity per customer and month."""
    ev = retail.event_days(spark, sf).select(
        F.col("user_id").alias("customer_id"), yyyymm(F.date_sub("day", SHIFT)).alias("yyyymm"), "event_type"
    )
    email = ev.groupBy("customer_id", "yyyymm").agg(
        F.count(F.lit(1)).alias("emails_sent"), F.count_if(F.col("event_type") == "view").alias("emails_opened"), F.count_if(F.col("event_type") == "click").alias("emails_clicked"),
    )
    points = cu.loyalty_ledger(retail.transactions(spark, sf)).groupBy("customer_id", "yyyymm").agg(
        F.sum(F.when(F.col("entry_type") == "EARN", F.col("points")).otherwise(0)).alias("loyalty_points_earned")
    )
    return [(email, ["emails_sent", "emails_opened", "emails_clicked"]), (points, ["loyalty_points_earned"])]


def customer_month(spark, sf):
    return cu.customer_month(retail.transactions(spark, sf), retail.months(spark, sf), satellites(spark, sf))


CM = f"""{EVENTS}, elig AS (SELECT customer_id, min(CASE WHEN txn_type = 'Regular Sale' THEN yyyymm END) AS first_ym FROM txn GROUP BY 1 HAVING count(*) >= 2 AND min(CASE WHEN txn_type = 'Regular Sale' THEN yyyymm END) IS NOT NULL),
spine AS (SELECT e.customer_id, mo.yyyymm, mo.month_seq, mo.month_seq - f.month_seq AS months_since_first, date_diff('day', DATE '1970-01-01', mo.month_end) + 2440588 AS end_jdn
 FROM elig e JOIN months f ON f.yyyymm = e.first_ym JOIN months mo ON mo.month_seq >= f.month_seq),
roll AS (SELECT customer_id, yyyymm, count(*) FILTER (WHERE txn_type = 'Regular Sale') AS transactions, count(*) FILTER (WHERE txn_type = 'Regular Return') AS returns, count(DISTINCT CASE WHEN txn_type = 'Regular Sale' THEN jdn END) AS purchase_days,
 sum(basket_value) AS sales, sum(basket_margin) AS margin, sum(promo_value) AS promo_sales, sum(discount_total) AS discount, sum(basket_items) AS items, max(CASE WHEN txn_type = 'Regular Sale' THEN jdn END) AS last_sale, count(DISTINCT store_id) AS distinct_stores, count(*) AS home_store_txns, count(*) FILTER (WHERE channel = 'Delivery') AS ecommerce_orders, {div('sum(distinct_categories)', 'count(*)')} AS avg_categories_per_basket FROM txn GROUP BY 1, 2),
mail AS (SELECT user_id AS customer_id, year(day - {SHIFT}) * 100 + month(day - {SHIFT}) AS yyyymm, count(*) AS emails_sent, count(*) FILTER (WHERE event_type = 'view') AS emails_opened, count(*) FILTER (WHERE event_type = 'click') AS emails_clicked FROM ev GROUP BY 1, 2),
ledger AS (SELECT txn_id, customer_id, store_id, yyyymm, sale_date, CASE WHEN spend >= 0 THEN 'EARN' ELSE 'ADJUST' END AS entry_type, CAST(round(spend * 10, 0) AS BIGINT) AS points, spend
 FROM (SELECT *, CASE WHEN txn_type = 'Regular Return' THEN -basket_value ELSE basket_value END AS spend FROM txn WHERE txn_type <> 'Post Void TX')),
pts AS (SELECT customer_id, yyyymm, sum(CASE WHEN entry_type = 'EARN' THEN points ELSE 0 END) AS p FROM ledger GROUP BY 1, 2),
cm AS (SELECT s.customer_id, s.yyyymm, s.month_seq, s.months_since_first, coalesce(transactions, 0) AS transactions, coalesce(returns, 0) AS returns, coalesce(purchase_days, 0) AS purchase_days,
 coalesce(sales, 0) AS sales, coalesce(margin, 0) AS margin, coalesce(promo_sales, 0) AS promo_sales, coalesce(discount, 0) AS discount, coalesce(items, 0) AS items,
 coalesce(distinct_stores, 0) AS distinct_stores, coalesce(home_store_txns, 0) AS home_store_txns, coalesce(ecommerce_orders, 0) AS ecommerce_orders, avg_categories_per_basket,
 coalesce(emails_sent, 0) AS emails_sent, coalesce(emails_opened, 0) AS emails_opened, coalesce(emails_clicked, 0) AS emails_clicked, coalesce(p, 0) AS loyalty_points_earned,
 end_jdn - max(last_sale) OVER (PARTITION BY s.customer_id ORDER BY s.month_seq) AS days_since_last_purchase, CASE WHEN coalesce(transactions, 0) > 0 THEN 'Y' ELSE 'N' END AS active_flag
 FROM spine s LEFT JOIN roll r USING (customer_id, yyyymm) LEFT JOIN mail USING (customer_id, yyyymm) LEFT JOIN pts USING (customer_id, yyyymm))"""


@query("mrt11_customer_month", f"""{LTM}, {CM} SELECT customer_id, yyyymm, month_seq, months_since_first, transactions, returns, purchase_days, {m('sales')} AS sales, {m('margin')} AS margin, {m('promo_sales')} AS promo_sales, {m('discount')} AS discount,
{n('items')} AS items, distinct_stores, home_store_txns, ecommerce_orders, avg_categories_per_basket, emails_sent, emails_opened, emails_clicked, {n('loyalty_points_earned')} AS loyalty_points_earned, days_since_last_purchase, active_flag FROM cm""")
def _(spark, sf):
    # a customer of the given tables belongs to one store, its home
    txn = retail.transactions(spark, sf, distinct=True).withColumn("home_store", F.col("store_id"))
    cm = cu.customer_month(txn, retail.months(spark, sf), satellites(spark, sf))
    return cm.select(*[money(F.col(c)).alias(c) if c in ("sales", "margin", "promo_sales", "discount") else F.col(c) for c in cm.columns])


@query("mrt12_cohort_retention", f"""{LTM}, {CM}, f AS (SELECT customer_id, year(min(sale_date)) AS cohort_year FROM lines GROUP BY 1)
SELECT cohort_year, months_since_first, count(*) AS customers, count(*) FILTER (WHERE active_flag = 'Y') AS active_customers, {spct("count(*) FILTER (WHERE active_flag = 'Y')", 'count(*)')} AS active_pct
FROM cm JOIN f USING (customer_id) GROUP BY 1, 2""")
def _(spark, sf):
    heads = retail.headers(spark, sf).join(retail.raw_lines(spark, sf), "txn_id", "left_semi")
    first = heads.groupBy("customer_id").agg(F.year(F.min("sale_date")).alias("cohort_year"))
    return cu.cohort(customer_month(spark, sf), first)


@query("mrt13_spend_profile", f"""{L}, g AS (SELECT customer_id, sum(sales) AS total, sum(CASE WHEN pack_size <= 40 THEN sales ELSE 0 END) AS fl,
 sum(CASE WHEN pack_size <= 40 AND pack_size % 5 = 0 THEN sales ELSE 0 END) AS vg, sum(CASE WHEN pack_size <= 40 AND pack_size % 4 = 0 THEN sales ELSE 0 END) AS ss,
 sum(CASE WHEN category IN ('STANDARD', 'ECONOMY', 'SMALL') THEN sales ELSE 0 END) AS cat, sum(CASE WHEN category = 'STANDARD' THEN sales ELSE 0 END) AS st, sum(CASE WHEN category = 'ECONOMY' THEN sales ELSE 0 END) AS ec,
 sum(CASE WHEN category = 'SMALL' THEN sales ELSE 0 END) AS sm FROM sales_lines GROUP BY 1),
p AS (SELECT customer_id, {m('total')} AS total_spend, {spct('fl', 'total')} AS coverage, {spct('vg', 'fl')} AS vegan_pct, {spct('ss', 'fl')} AS single_pct, {spct('st', 'cat')} AS standard_pct, {spct('ec', 'cat')} AS economy_pct, {spct('sm', 'cat')} AS small_pct FROM g)
SELECT *, CASE WHEN coverage IS NULL OR coverage < 20 THEN 'Unclassified' WHEN vegan_pct >= 30 THEN 'Plant-based' WHEN single_pct >= 40 THEN 'Convenience' ELSE 'Mainstream' END AS diet_profile,
 CASE WHEN standard_pct IS NULL THEN 'Unclassified' WHEN standard_pct >= 45 THEN 'Ready meals' WHEN economy_pct + small_pct >= 70 THEN 'Home cook' ELSE 'Balanced' END AS basket_profile FROM p""")
def _(spark, sf):
    size, cat = F.col("pack_size"), F.col("category")
    rules = [
        (F.col("coverage").isNull() | (F.col("coverage") < 20), "Unclassified"),
        (F.col("vegan_pct") >= 30, "Plant-based"), (F.col("single_pct") >= 40, "Convenience"),
    ]
    basket = [
        (F.col("standard_pct").isNull(), "Unclassified"), (F.col("standard_pct") >= 45, "Ready meals"),
        (F.col("economy_pct") + F.col("small_pct") >= 70, "Home cook"),
    ]
    return cu.spend_profile(
        retail.sales_lines(spark, sf, store=False), {"vegan": size % 5 == 0, "single": size % 4 == 0}, size <= 40,
        {"standard": cat == "STANDARD", "economy": cat == "ECONOMY", "small": cat == "SMALL"}, rules, basket,
    )


CHURN = f"""{DAYS_TXN}, {CUT_SQL}, gaps AS (SELECT *, jdn - lag(jdn) OVER (PARTITION BY customer_id ORDER BY jdn) AS gap FROM days),
b AS (SELECT as_of, customer_id, count(*) AS pd, sum(baskets) AS baskets, sum(day_value) AS sales, min(jdn) AS fj, max(jdn) AS lj, median(gap) AS med, avg(gap) AS mean, max(gap) AS mx, arg_max_null(gap, jdn) AS lastgap,
 count(*) FILTER (WHERE jdn > as_of - 30) AS d30, count(*) FILTER (WHERE jdn > as_of - 90) AS d90, count(*) FILTER (WHERE jdn > as_of - 180) AS d180, count(*) FILTER (WHERE jdn > as_of - 180 AND jdn <= as_of - 90) AS dp90,
 sum(CASE WHEN jdn > as_of - 30 THEN day_value ELSE 0 END) AS s30, sum(CASE WHEN jdn > as_of - 90 THEN day_value ELSE 0 END) AS s90, sum(CASE WHEN jdn > as_of - 180 THEN day_value ELSE 0 END) AS s180,
 sum(CASE WHEN jdn > as_of - 180 AND jdn <= as_of - 90 THEN day_value ELSE 0 END) AS sp90 FROM gaps JOIN cutoffs ON jdn <= as_of GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT as_of, customer_id, count(*) AS tx, count(*) FILTER (WHERE txn_type = 'Regular Return') AS rets, sum(basket_margin) AS mg, sum(promo_value) AS pv, sum(discount_total) AS dt, count(*) FILTER (WHERE channel = 'Delivery') AS ec,
 sum(basket_items) AS it, count(*) FILTER (WHERE isodow(sale_date) >= 6) AS we FROM txn JOIN cutoffs ON jdn <= as_of AND jdn > as_of - 180 GROUP BY 1, 2),
nx AS (SELECT as_of, customer_id, min(jdn) - as_of AS nxt FROM days JOIN cutoffs ON jdn > as_of GROUP BY 1, 2),
h AS (SELECT *, least(180, greatest(90, CAST(trunc(3 * med) AS BIGINT))) AS hz, {MAXJ} AS mxj FROM b LEFT JOIN t USING (as_of, customer_id) LEFT JOIN nx USING (as_of, customer_id)),
churn AS (SELECT as_of, customer_id, CASE WHEN as_of = {SCORING} THEN 'Y' ELSE 'N' END AS is_scoring_row, pd AS purchase_days_asof, {n('baskets')} AS baskets_asof, {m('sales')} AS sales_asof, as_of - fj AS tenure_days, as_of - lj AS days_since_last,
 round(med, 1) AS ipt_median_asof, round(mean, 4) AS ipt_mean_asof, mx AS ipt_max_asof, lastgap AS ipt_last_asof, round(CAST(as_of - lj AS DOUBLE) / greatest(1, med), 6) AS overdue_ratio, hz AS churn_horizon_days,
 d30 AS purchase_days_l30, d90 AS purchase_days_l90, d180 AS purchase_days_l180, dp90 AS purchase_days_prior90, {m('s30')} AS sales_l30, {m('s90')} AS sales_l90, {m('s180')} AS sales_l180, {m('sp90')} AS sales_prior90,
 {div('d90', 'dp90', 6)} AS trend_ratio_l90, {div('sales', 'baskets')} AS avg_basket_asof, pd - 1 AS bgnbd_frequency, lj - fj AS bgnbd_recency, as_of - fj AS bgnbd_t, coalesce(tx, 0) AS txns_l180, coalesce(rets, 0) AS returns_l180,
 {m('coalesce(mg, 0)')} AS margin_l180, {m('coalesce(dt, 0)')} AS discount_l180, coalesce(ec, 0) AS ecommerce_l180, coalesce(we, 0) AS weekend_txns_l180, {spct('coalesce(pv, 0)', 's180')} AS promo_share_l180, {div('it', 'tx', 6)} AS avg_items_l180,
 nxt AS next_purchase_days, CASE WHEN as_of = {SCORING} OR as_of + 90 > mxj THEN NULL WHEN nxt IS NULL OR nxt > 90 THEN 1 ELSE 0 END AS churn_90,
 CASE WHEN as_of = {SCORING} OR as_of + hz > mxj THEN NULL WHEN nxt IS NULL OR nxt > hz THEN 1 ELSE 0 END AS churn_adaptive, CASE WHEN nxt IS NULL THEN mxj - as_of END AS censored_after_days FROM h)"""


def churn_set(spark, sf):
    return tr.churn_training(retail.transactions(spark, sf), cut_jdns(), SCORING, last_day(spark, sf))


@query("mrt14_churn_training_set", f"{LT}, {CHURN} SELECT * FROM churn")
def _(spark, sf):
    return churn_set(spark, sf)


ACT = f"""f AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY jdn, txn_id) AS rk FROM txn WHERE txn_type = 'Regular Sale'),
s2 AS (SELECT f.customer_id, min(x.jdn) AS j2 FROM f JOIN txn x ON x.customer_id = f.customer_id AND x.txn_type = 'Regular Sale' AND x.jdn > f.jdn WHERE f.rk = 1 GROUP BY 1),
act AS (SELECT f.customer_id, jdn AS first_jdn, {MAXJ} - jdn AS days_since_first, store_id, {m('basket_value')} AS first_basket_value, basket_items AS first_basket_items, {m('basket_margin')} AS first_basket_margin, {m('discount_total')} AS first_discount,
 promo_flag AS first_promo_flag, distinct_categories AS first_categories, channel AS first_channel, j2 - jdn AS days_to_second,
 CASE WHEN jdn + 90 > {MAXJ} THEN NULL WHEN j2 - jdn <= 90 THEN 1 ELSE 0 END AS activated_90, CASE WHEN j2 IS NULL THEN 'Y' ELSE 'N' END AS is_one_time FROM f LEFT JOIN s2 USING (customer_id) WHERE rk = 1)"""


def activation_set(spark, sf):
    return tr.activation_training(retail.transactions(spark, sf, distinct=True), last_day(spark, sf))


@query("mrt15_activation_training_set", f"{LT}, {ACT} SELECT * FROM act")
def _(spark, sf):
    return activation_set(spark, sf)


AS_OF_SEQ = [54, 66]


def _sql_back(c, k, k2):
    cond = "seq <= a" if k is None else f"seq <= a AND seq > a - {k}"
    return f"sum(CASE WHEN {cond} THEN {c} ELSE 0 END) AS {k2}"


CLV = f"""r AS (SELECT cm.*, month_seq AS seq, a FROM cm JOIN (VALUES (54), (66)) z(a) ON month_seq <= a + 6),
c AS (SELECT customer_id, a AS as_of_seq, count(*) FILTER (WHERE seq <= a) AS months_observed, max(CASE WHEN seq <= a THEN months_since_first END) AS months_since_first,
{", ".join(_sql_back('sales', k, 'sales_' + x) for x, k in (('life', None), ('l3', 3), ('l6', 6), ('l12', 12)))}, {", ".join(_sql_back('margin', k, 'margin_' + x) for x, k in (('life', None), ('l3', 3), ('l6', 6), ('l12', 12)))},
{", ".join(_sql_back('transactions', k, 'txns_' + x) for x, k in (('life', None), ('l6', 6), ('l12', 12)))}, {_sql_back('purchase_days', 6, 'purchase_days_l6')}, {_sql_back('returns', 6, 'returns_l6')},
{_sql_back('promo_sales', 6, 'promo_sales_l6')}, {_sql_back('discount', 6, 'discount_l6')}, count(*) FILTER (WHERE seq <= a AND seq > a - 6 AND transactions > 0) AS active_months_l6, max(CASE WHEN seq = a THEN days_since_last_purchase END) AS days_since_last,
sum(CASE WHEN seq > a THEN margin ELSE 0 END) AS future_margin, sum(CASE WHEN seq > a THEN sales ELSE 0 END) AS future_sales, sum(CASE WHEN seq > a THEN transactions ELSE 0 END) AS future_txns, max(CASE WHEN seq > a AND transactions > 0 THEN 1 ELSE 0 END) AS future_active
FROM r GROUP BY 1, 2 HAVING count(*) FILTER (WHERE seq <= a) > 0),
clv AS (SELECT customer_id, as_of_seq, months_observed, months_since_first, {", ".join(m(x) + ' AS ' + x for x in ('sales_life', 'sales_l3', 'sales_l6', 'sales_l12', 'margin_life', 'margin_l3', 'margin_l6', 'margin_l12', 'promo_sales_l6', 'discount_l6', 'future_margin', 'future_sales'))},
{", ".join(n(x) + ' AS ' + x for x in ('txns_life', 'txns_l6', 'txns_l12', 'purchase_days_l6', 'returns_l6', 'future_txns'))}, active_months_l6, days_since_last, future_active FROM c)"""


def clv_set(spark, sf):
    return tr.clv_training(customer_month(spark, sf), AS_OF_SEQ)


@query("mrt16_lifetime_value_set", f"{LTM}, {CM}, {CLV} SELECT * FROM clv")
def _(spark, sf):
    return clv_set(spark, sf)


@query("mrt44_trade_area", f"""{L}, a AS (SELECT category || '/' || province AS area, customer_id, store_id, sales FROM sales_lines), hh AS (SELECT n_name AS province, count(*) AS households FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT area, count(DISTINCT customer_id) AS shoppers, count(DISTINCT store_id) AS stores_shopped, {m('sum(sales)')} AS area_sales, {div('sum(sales)', 'count(DISTINCT customer_id)')} AS sales_per_shopper,
{spct('count(DISTINCT customer_id)', 'max(households)')} AS penetration_pct FROM a LEFT JOIN hh ON hh.province = split_part(area, '/', 2) GROUP BY 1""")
def _(spark, sf):
    lines = retail.sales_lines(spark, sf).withColumn("area", F.concat_ws("/", "category", "province"))
    hh = read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("int").alias("store_id")).agg(F.count(F.lit(1)).alias("households"))
    cats = retail.products(spark, sf).select("category").distinct()
    areas = hh.join(retail.stores(spark, sf).select("store_id", "province"), "store_id")
    from shopledger.operators.joins import explode_by_dim

    areas = explode_by_dim(areas, cats).select(F.concat_ws("/", "category", "province").alias("area"), "households")
    return cu.trade_area(lines, areas)


@query("mrt45_loyalty_ledger", f"""{LTM}, {CM} SELECT txn_id, customer_id, store_id, CAST(sale_date AS VARCHAR) AS sale_date, entry_type, points, {m('spend')} AS spend FROM ledger""")
def _(spark, sf):
    return cu.loyalty_ledger(retail.transactions(spark, sf)).select(
        "txn_id", "customer_id", "store_id", F.col("sale_date").cast("string").alias("sale_date"), "entry_type", "points", money(F.col("spend")).alias("spend")
    )
