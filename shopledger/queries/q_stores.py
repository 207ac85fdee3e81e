"""Registered queries for stores, supply, labour, census, marketing (MRT-17..21, 36..50)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import fixed, jdn, money, pct, safe_div, yyyymm
from shopledger.operators.aggregates import argmax_of
from shopledger.plans import demand as dm
from shopledger.plans import marketing as mk
from shopledger.plans import stores as st
from shopledger.queries.common import EV, EVENTS, L, LT, LTM, div, fx, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_finance import BUDGET, PNL, SHIFTS, SHRINK, budget, pnl
from shopledger.queries.q_sales import EVENT_ID, TRAFFIC, calendar, visits
from shopledger.queries.registry import query
from shopledger.sources import inputs, retail
from shopledger.sources.tables import inline_table, read_table

ONE = "*"
FACTS = f"""facts AS (SELECT store_id, any_value(s.region) AS region, any_value(s.store_format) AS store_format, any_value(s.owner_id) AS owner_id, any_value(s.square_feet) AS square_feet, count(DISTINCT txn_id) AS total_transactions, count(DISTINCT customer_id) AS distinct_customers,
CAST(min(sale_date) AS VARCHAR) AS open_date, CAST(max(sale_date) AS VARCHAR) AS last_sale_date, {m('sum(sales)')} AS total_sales, {spct('sum(sales) - sum(cost)', 'sum(sales)')} AS margin_pct, {fx('CAST(sum(sales) AS DOUBLE) * 7.0::DOUBLE / 2400.0::DOUBLE')} AS avg_weekly_sales, {div('sum(sales)', 'any_value(s.square_feet)')} AS sales_per_sqft
FROM sales_lines l JOIN stores s USING (store_id) GROUP BY 1)"""


def facts(spark, sf):
    return st.store_facts(retail.sales_lines(spark, sf, store=False), retail.stores(spark, sf), 2400)


@query("mrt18_store_facts", f"{L}, {FACTS} SELECT * FROM facts")
def _(spark, sf):
    return facts(spark, sf)


@query("mrt18_owner_rollup", f"{L}, {FACTS} SELECT owner_id, count(*) AS stores_owned, min(open_date) AS first_store_open, {m('sum(CAST(total_sales AS DECIMAL(18,2)))')} AS total_sales FROM facts GROUP BY 1")
def _(spark, sf):
    return st.owner_rollup(facts(spark, sf))


PROMO = f"""pl AS (SELECT *, {EVENT_ID} AS event_id FROM sales_lines WHERE promo_type <> ''), pc AS (SELECT event_id, category, row_number() OVER (PARTITION BY event_id ORDER BY sum(sales) DESC, category) AS rk FROM pl GROUP BY 1, 2),
pg AS (SELECT event_id, min(sale_date) AS a, max(sale_date) AS b, count(DISTINCT store_id) AS stores_participating, count(DISTINCT customer_id) AS distinct_customers, count(DISTINCT txn_id) AS total_transactions, sum(quantity) AS u, sum(sales) AS s, sum(cost) AS c, sum(regular_value) AS r, sum(discount) AS d,
 count(*) FILTER (WHERE promo_type = 'T') AS t, count(*) FILTER (WHERE promo_type = 'M') AS mm, count(*) FILTER (WHERE promo_type = 'O') AS o FROM pl GROUP BY 1),
promos AS (SELECT event_id AS promo_id, CASE WHEN month(a) IN (12, 1, 2) THEN 'Winter' WHEN month(a) IN (3, 4, 5) THEN 'Spring' WHEN month(a) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
 CASE WHEN t >= mm AND t >= o THEN 'Temporary Price Reduction' WHEN mm >= o THEN 'Manager Markdown' ELSE 'Price Override' END AS mechanic, CASE WHEN d * 0.1 >= 0.005 THEN 'Vendor Co-op' ELSE 'Corporate' END AS funding_source, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date,
 stores_participating, distinct_customers, total_transactions, {n('u')} AS units_sold, {m('s')} AS promo_sales, {m('s - c')} AS promo_margin, {spct('s - c', 's')} AS margin_pct, {spct('d', 'r')} AS discount_depth_pct, {m('CAST(d * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,2))')} AS marketing_subsidy, category AS top_category FROM pg JOIN pc USING (event_id) WHERE rk = 1)"""


def promos(spark, sf):
    df = retail.sales_lines(spark, sf, store=False).withColumn("event_id", retail.event_id(F.col("promo_type"), F.col("sale_date")))
    return mk.promotions(df)


@query("mrt19_promotions", f"{L}, {PROMO} SELECT * FROM promos")
def _(spark, sf):
    return promos(spark, sf)


MAIL = f"""{EVENTS}, m0 AS (SELECT user_id, event_type, day - CAST(9000 - (user_id % 8) * 90 AS INTEGER) AS sale_date, CASE user_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'M' ELSE 'O' END AS promo_type FROM ev),
mail AS (SELECT {EVENT_ID} AS campaign_id, sale_date AS send_date, event_type IN ('view', 'click', 'purchase') AS o, event_type IN ('click', 'purchase') AS c, event_type = 'purchase' AS v FROM m0)"""
MAILM = "count(*) AS sent, count(*) FILTER (WHERE o) AS opened, count(*) FILTER (WHERE c) AS clicked, count(*) FILTER (WHERE v) AS converted"


@query("mrt20_campaign_results", f"""{L}, {PROMO}, {MAIL}, e AS (SELECT campaign_id, {MAILM} FROM mail GROUP BY 1)
SELECT promo_id AS campaign_id, mechanic, marketing_subsidy, sent, opened, clicked, converted, {spct('opened', 'sent')} AS open_rate_pct, {spct('clicked', 'opened')} AS click_through_pct, {spct('converted', 'sent')} AS conversion_rate_pct, {div('marketing_subsidy', 'converted')} AS subsidy_per_conversion, promo_sales, promo_margin
FROM promos LEFT JOIN e ON campaign_id = promo_id""")
def _(spark, sf):
    return mk.campaigns(inputs.email_log(spark, sf), promos(spark, sf))


@query("mrt20_email_months", f"{L}, {PROMO}, {MAIL} SELECT campaign_id, mechanic, year(send_date) * 100 + month(send_date) AS send_yyyymm, {MAILM} FROM mail JOIN promos ON promo_id = campaign_id GROUP BY 1, 2, 3")
def _(spark, sf):
    return mk.dash_email(inputs.email_log(spark, sf), promos(spark, sf))


@query("mrt20_campaign_roi", f"{L}, {PROMO} SELECT promo_id, promo_margin, marketing_subsidy, {div('promo_margin', 'marketing_subsidy', 4)} AS roi, {div('marketing_subsidy', 'total_transactions', 4)} AS subsidy_per_conversion FROM promos WHERE marketing_subsidy >= 1000 ORDER BY roi DESC, promo_id LIMIT 15")
def _(spark, sf):
    return mk.campaign_roi(promos(spark, sf), 1000, 15)


ECOM = f"""eo AS (SELECT h.*, ov, CASE WHEN shp > sale_date + 1000 THEN 'Y' ELSE 'N' END AS late, txn_id % 5 + 1 AS sat, CASE customer_id % 3 WHEN 0 THEN 'Partner A' WHEN 1 THEN 'Partner B' ELSE 'Pickup' END AS delivery_partner
 FROM headers h JOIN (SELECT txn_id, sum(sales) AS ov, max(ship_date) AS shp FROM raw_lines GROUP BY 1) x USING (txn_id) WHERE priority IN ('1-URGENT', '2-HIGH')),
ecom AS (SELECT year(sale_date) * 100 + month(sale_date) AS yyyymm, delivery_partner, count(*) AS orders, {m('sum(ov)')} AS order_value, count(*) FILTER (WHERE late = 'Y') AS late_orders, {div('sum(sat)', 'count(*)', 4)} AS avg_satisfaction FROM eo GROUP BY 1, 2)"""


def ecom(spark, sf):
    return mk.dash_ecom(inputs.online_orders(spark, sf))


@query("mrt21_online_months", f"{L}, {ECOM} SELECT * FROM ecom")
def _(spark, sf):
    return ecom(spark, sf)


@query("mrt21_online_share", f"{L}, {ECOM}, s AS (SELECT yyyymm, sum(sales) AS sales FROM sales_lines GROUP BY 1) SELECT yyyymm, {spct('sum(CAST(order_value AS DECIMAL(18,2)))', 'max(sales)')} AS ecom_share_pct FROM ecom LEFT JOIN s USING (yyyymm) GROUP BY 1")
def _(spark, sf):
    s = retail.sales_lines(spark, sf, product=False, store=False).groupBy("yyyymm").agg(F.sum("sales").alias("sales"))
    return mk.ecom_share(ecom(spark, sf), s)


@query("mrt21_partners", f"{L}, {ECOM} SELECT delivery_partner, {n('sum(orders)')} AS orders, {spct('sum(late_orders)', 'sum(orders)')} AS late_pct, {div('sum(CAST(avg_satisfaction AS DECIMAL(10,4)) * orders)', 'sum(orders)', 4)} AS avg_satisfaction FROM ecom WHERE delivery_partner <> 'Pickup' GROUP BY 1")
def _(spark, sf):
    return mk.partners(ecom(spark, sf))


STOCK = f"""stk AS (SELECT store_id, plu, sum(quantity) AS units, sum(sales) AS sales, max(unit_cost) AS uc, max(category) AS category, max(supplier_id) AS supplier_id, min(sale_date) AS fd, max(sale_date) AS ld, sum(CASE WHEN sale_date > DATE '2001-05-03' THEN quantity ELSE 0 END) AS u90,
 (plu * 7 + store_id * 13) % 60 AS on_hand, 3 + plu % 12 AS lead_days, CASE WHEN plu % 2 = 0 THEN 6 ELSE 12 END AS cs FROM sales_lines GROUP BY store_id, plu),
sv AS (SELECT *, CASE WHEN u90 > 0 THEN CAST(u90 AS DOUBLE) / 90.0::DOUBLE ELSE CAST(units AS DOUBLE) / CAST(greatest(30, date_diff('day', fd, ld) + 1) AS DOUBLE) END AS v FROM stk),
sw AS (SELECT *, CAST(trunc(v * 3.0::DOUBLE + 1.0::DOUBLE) AS BIGINT) AS safety_stock, CAST(trunc(v * CAST(lead_days AS DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS lead_need, CAST(trunc(v * 14.0::DOUBLE + 1.0::DOUBLE) AS BIGINT) AS need, CAST(uc AS DOUBLE) AS cost, CAST(sales AS DOUBLE) / CAST(units AS DOUBLE) AS rp FROM sv),
inv AS (SELECT store_id, plu, category, supplier_id, on_hand, safety_stock, safety_stock + lead_need AS reorder_point, ((need + cs - 1) // cs) * cs AS reorder_qty, lead_days, {fx('v', 3)} AS avg_daily_units, CASE WHEN v > 0 THEN {fx('CAST(on_hand AS DOUBLE) / v', 1)} END AS days_of_supply,
 CASE WHEN on_hand > 0 AND v > 0 THEN {fx('365.0::DOUBLE * v / CAST(on_hand AS DOUBLE)', 1)} END AS annual_turns, CASE WHEN on_hand > 0 AND cost > 0 THEN {fx('365.0::DOUBLE * v * (rp - cost) / (CAST(on_hand AS DOUBLE) * cost)')} END AS gmroi,
 CASE WHEN on_hand = 0 THEN 'Out of Stock' WHEN on_hand <= safety_stock THEN 'Critical' WHEN on_hand <= safety_stock + lead_need THEN 'Reorder' WHEN v > 0 AND on_hand > v * 60 THEN 'Overstock' ELSE 'In Stock' END AS stock_status FROM sw)"""


def inv(spark, sf):
    return st.inventory_metrics(inputs.stock(spark, sf))


@query("mrt36_inventory_metrics", f"{L}, {STOCK} SELECT * FROM inv")
def _(spark, sf):
    return inv(spark, sf)


@query("mrt37_reorder_list", f"{L}, {STOCK} SELECT store_id, plu, category, on_hand, reorder_point, reorder_qty, days_of_supply, stock_status FROM inv WHERE on_hand <= reorder_point")
def _(spark, sf):
    return st.reorder_list(inv(spark, sf))


@query("mrt37_stock_status_share", f"{L}, {STOCK} SELECT category, stock_status, {spct('count(*)', 'any_value(t)')} AS share_pct FROM inv JOIN (SELECT category, count(*) AS t FROM inv GROUP BY 1) x USING (category) GROUP BY 1, 2")
def _(spark, sf):
    return st.stock_share(inv(spark, sf))


@query("mrt37_gmroi_by_category", f"{L}, {STOCK} SELECT category, {div('sum(CAST(gmroi AS DECIMAL(18,2)))', 'count(gmroi)', 4)} AS gmroi FROM inv GROUP BY 1")
def _(spark, sf):
    return st.gmroi_by_category(inv(spark, sf))


PO = f"""pb AS (SELECT store_id, supplier_id, yyyymm, sum(quantity) AS units, sum(cost) AS cl, count(DISTINCT plu) AS line_count, min(sale_date) AS od, max(greatest(0, date_diff('day', sale_date, ship_date))) AS actual_lead_days, sum(CASE WHEN return_flag <> 'R' THEN quantity ELSE 0 END) AS rec FROM lines GROUP BY 1, 2, 3),
pe0 AS (SELECT supplier_id, CAST(floor(avg(greatest(0, date_diff('day', sale_date, ship_date))) + 0.5) AS BIGINT) AS expected_lead_days FROM lines GROUP BY 1),
pq AS (SELECT *, CAST(ceil(CAST(units AS DOUBLE) / 10) * 10 AS BIGINT) AS ordered_units, CAST(rec AS BIGINT) AS received_units FROM pb JOIN pe0 USING (supplier_id)),
po AS (SELECT 'PO-' || store_id || '-' || yyyymm || '-' || supplier_id AS po_number, store_id, supplier_id, yyyymm, CAST(od AS VARCHAR) AS order_date, expected_lead_days, actual_lead_days, CASE WHEN actual_lead_days <= expected_lead_days THEN 'Y' ELSE 'N' END AS on_time, line_count, ordered_units, received_units * 100 // ordered_units AS fill_rate_pct,
 received_units, {fx('CAST(cl AS DOUBLE) * CAST(ordered_units AS DOUBLE) / CAST(units AS DOUBLE)')} AS po_value_cost FROM pq)"""


def po(spark, sf):
    return st.purchase_orders(inputs.purchase_lines(spark, sf))


@query("mrt38_purchase_orders", f"{L}, {PO} SELECT * FROM po")
def _(spark, sf):
    return po(spark, sf)


@query("mrt38_supplier_scorecard", f"""{L}, {PO}, f AS (SELECT supplier_id, category, row_number() OVER (PARTITION BY supplier_id ORDER BY sum(sales) DESC, category) AS rk FROM lines GROUP BY 1, 2)
SELECT supplier_id, count(*) AS purchase_orders, {m('sum(CAST(po_value_cost AS DECIMAL(18,2)))')} AS total_spend, {div('sum(fill_rate_pct)', 'count(*)', 1)} AS avg_fill_rate_pct, {spct("count(*) FILTER (WHERE on_time = 'Y')", 'count(*)', 1)} AS on_time_pct, count(DISTINCT store_id) AS stores_served, max(expected_lead_days) AS lead_time_days,
count(*) FILTER (WHERE yyyymm BETWEEN 200004 AND 200006) AS quarter_po_count, {spct("count(*) FILTER (WHERE on_time = 'Y' AND yyyymm BETWEEN 200004 AND 200006)", 'count(*) FILTER (WHERE yyyymm BETWEEN 200004 AND 200006)')} AS quarter_on_time_pct, any_value(category) AS category_focus
FROM po JOIN (SELECT supplier_id, category FROM f WHERE rk = 1) c USING (supplier_id) GROUP BY 1""")
def _(spark, sf):
    focus = argmax_of(inputs.purchase_lines(spark, sf), ["supplier_id"], "category", F.col("sales"), "category_focus").drop("measure")
    return st.scorecard(po(spark, sf), focus, "2000Q2")


@query("mrt37_supply_kpi", f"""{L}, {STOCK}, {PO}, {SHRINK} SELECT {spct("count(*) FILTER (WHERE stock_status = 'Out of Stock')", 'count(*)')} AS oos_pct, {spct("count(*) FILTER (WHERE stock_status = 'Overstock')", 'count(*)')} AS overstock_pct, {div('sum(CAST(days_of_supply AS DECIMAL(18,1)))', 'count(days_of_supply)', 4)} AS avg_days_of_supply,
(SELECT {spct("count(*) FILTER (WHERE on_time = 'Y')", 'count(*)')} FROM po) AS on_time_pct, {spct('(SELECT sum(shrink_value) FROM shrink)', '(SELECT sum(cost) FROM sales_lines)', 4)} AS shrink_pct_cogs FROM inv""")
def _(spark, sf):
    return st.supply_kpi(inv(spark, sf), po(spark, sf), inputs.shrink_log(spark, sf), retail.sales_lines(spark, sf, store=False))


@query("mrt39_shrink_months", f"{L}, {SHRINK} SELECT yyyymm, reason, {n('sum(qty_lost)')} AS units, {m('sum(shrink_value)')} AS shrink_value, count(*) AS events FROM shrink GROUP BY 1, 2")
def _(spark, sf):
    return st.shrink_monthly(inputs.shrink_log(spark, sf))


LAB = f"{SHIFTS}, lab AS (SELECT *, CAST(scheduled_hours * hourly_rate AS DECIMAL(12,2)) AS labour_cost FROM shifts)"


@query("mrt41_labour_share", f"""{EV}, {LAB}, s AS (SELECT store_id, sum(value) AS sales FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT store_id, {m('sum(labour_cost)')} AS labour_cost, {spct('sum(labour_cost)', 'any_value(sales)')} AS labour_pct_sales, {div('sum(labour_cost)', 'sum(scheduled_hours)', 4)} AS cost_per_hour FROM lab LEFT JOIN s USING (store_id) GROUP BY 1""")
def _(spark, sf):
    s = retail.event_days(spark, sf).where("event_type = 'purchase'").groupBy("store_id").agg(F.sum("value").alias("sales"))
    return st.labour_pct(st.labour_cost(inputs.shifts(spark, sf)), s)


@query("mrt41_hours_heatmap", f"""{EV}, {LAB} SELECT isodow(day) - 1 AS dow_num, CAST(sum(scheduled_hours) FILTER (WHERE shift_name = 'Morning') AS DOUBLE) AS "Morning", CAST(sum(scheduled_hours) FILTER (WHERE shift_name = 'Day') AS DOUBLE) AS "Day", CAST(sum(scheduled_hours) FILTER (WHERE shift_name = 'Evening') AS DOUBLE) AS "Evening" FROM lab GROUP BY 1""")
def _(spark, sf):
    return st.heatmap(inputs.shifts(spark, sf), ["Morning", "Day", "Evening"])


@query("mrt42_weekly_flash", f"""{EV}, {TRAFFIC} SELECT {m("sum(s) FILTER (WHERE day BETWEEN DATE '2024-01-27' AND DATE '2024-02-02')")} AS week_sales, {n("sum(transactions) FILTER (WHERE day BETWEEN DATE '2024-01-27' AND DATE '2024-02-02')")} AS week_transactions,
{m("sum(s) FILTER (WHERE day BETWEEN DATE '2024-01-20' AND DATE '2024-01-26')")} AS prior_week_sales, {n("sum(transactions) FILTER (WHERE day BETWEEN DATE '2024-01-20' AND DATE '2024-01-26')")} AS prior_week_transactions,
CAST(round(CAST(31000.0::DOUBLE * 5.0::DOUBLE / 31.0::DOUBLE AS DECIMAL(18,4)) + CAST(29000.0::DOUBLE * 2.0::DOUBLE / 29.0::DOUBLE AS DECIMAL(18,4)), 2) AS DOUBLE) AS plan_sales FROM traffic""")
def _(spark, sf):
    t = visits(spark, sf).withColumn("day", F.to_date("day"))
    targets = inline_table(spark, [("2024-01-01", 31000.0), ("2024-02-01", 29000.0), ("2024-03-01", 31000.0)], "m string, target_sales double").withColumn("month_start", F.col("m").cast("date"))
    return st.weekly_flash(t, targets, "2024-02-02")


@query("mrt43_sales_per_sqft_by_format", f"{L}, {FACTS} SELECT store_format, {div('sum(CAST(sales_per_sqft AS DECIMAL(18,2)))', 'count(*)', 4)} AS sales_per_sqft FROM facts GROUP BY 1")
def _(spark, sf):
    return st.sales_per_sqft_by_format(facts(spark, sf))


@query("mrt43_exposed_stores", f"""{L}, {FACTS}, near AS (SELECT s_nationkey AS store_id, count(*) AS c FROM supplier WHERE CAST(s_suppkey % 50 AS DOUBLE) / 10 <= 3 GROUP BY 1)
SELECT store_id, region, store_format, sales_per_sqft, c AS competitors_near FROM facts f JOIN near USING (store_id) WHERE c >= 2 AND sales_per_sqft < (SELECT avg(sales_per_sqft) FROM facts x WHERE x.store_format = f.store_format)""")
def _(spark, sf):
    rivals = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("store_id"), (F.col("s_suppkey") % 50 / 10).alias("distance_km"))
    return st.exposed(facts(spark, sf), rivals, 3, 2)


@query("mrt43_income_scatter", f"{L}, {FACTS}, i AS (SELECT c_nationkey AS store_id, round(median(c_acctbal), 4) AS median_income FROM customer GROUP BY 1) SELECT store_id, store_format, sales_per_sqft, median_income FROM facts LEFT JOIN i USING (store_id)")
def _(spark, sf):
    from shopledger.operators.ordered import exact_quantiles

    cust = read_table(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("store_id"), "c_acctbal")
    income = exact_quantiles(cust, "c_acctbal", {"median_income": 0.5}, ["store_id"]).withColumn("median_income", F.round("median_income", 4))
    return st.income_scatter(facts(spark, sf), income)


GEO = """blk AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 20 AS VARCHAR), 6, '0') || (c_custkey % 4) || lpad(CAST(c_custkey % 997 AS VARCHAR), 3, '0') AS geoid, 1 + c_custkey % 200 AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey),
grp AS (SELECT substr(geoid, 1, 12) AS group_id, 100000 + (CAST(substr(geoid, 1, 12) AS BIGINT) * 7919) % 900000 AS aland FROM blk GROUP BY 1, 2)"""


def blocks(spark, sf):
    k = F.col("c_custkey")
    pad = lambda c, w: F.lpad(c.cast("string"), w, "0")
    df = read_table(spark, sf, "customer").join(read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select(F.concat(pad(F.col("n_regionkey"), 2), pad(F.col("n_nationkey"), 3), pad(k % 20, 6), (k % 4).cast("string"), pad(k % 997, 3)).alias("geoid"), (k % 200 + 1).alias("pop"))


def block_groups(spark, sf):
    gid = F.substring("geoid", 1, 12)
    return blocks(spark, sf).select(gid.alias("group_id")).distinct().withColumn("aland", 100000 + (F.col("group_id").cast("bigint") * 7919) % 900000)


@query("mrt46_block_group_density", f"""WITH {GEO}, d AS (SELECT group_id, coalesce(p, 0) AS population, CAST(coalesce(p, 0) AS DOUBLE) / (CAST(aland AS DOUBLE) / 1000000.0::DOUBLE) AS x FROM grp LEFT JOIN (SELECT substr(geoid, 1, 12) AS g, sum(pop) AS p FROM blk GROUP BY 1) b ON g = group_id),
c AS (SELECT *, CASE WHEN x >= 500 THEN 'Urban' WHEN x >= 200 THEN 'Suburban' ELSE 'Rural' END AS density_class FROM d)
SELECT group_id, {n('population')} AS population, {fx('x', 4)} AS density, density_class, count(*) OVER w AS class_groups, {n('sum(population) OVER w')} AS class_population FROM c WINDOW w AS (PARTITION BY density_class)""")
def _(spark, sf):
    return st.density(blocks(spark, sf), block_groups(spark, sf), [(500, "Urban"), (200, "Suburban")], "Rural")


@query("mrt46_county_land_area", f"""WITH {GEO}, l AS (SELECT substr(group_id, 1, 5) AS county, sum(aland) AS aland, count(*) AS groups FROM grp GROUP BY 1), p AS (SELECT substr(geoid, 1, 5) AS county, sum(pop) AS pop FROM blk GROUP BY 1)
SELECT county, {n('aland')} AS aland, groups, {n('pop')} AS population, {fx('(1000000.0::DOUBLE * CAST(pop AS DOUBLE) / CAST(aland AS DOUBLE))', 4)} AS density FROM l LEFT JOIN p USING (county)""")
def _(spark, sf):
    return st.county_stats(block_groups(spark, sf), blocks(spark, sf))


@query("mrt46_housing_units", """WITH b AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county, n_name AS county_name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 ELSE 1 END AS h FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT county, county_name, CAST(sum(h) AS BIGINT) AS housing_units FROM b GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 15""")
def _(spark, sf):
    """Households count two units, other customers one."""
    pad = lambda c, w: F.lpad(F.col(c).cast("string"), w, "0")
    nation = read_table(spark, sf, "nation").select("n_nationkey", F.concat(pad("n_regionkey", 2), pad("n_nationkey", 3)).alias("geoid"), F.col("n_name").alias("county_name"))
    customer = read_table(spark, sf, "customer").select("c_nationkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", 2).otherwise(1).alias("housing"))
    units = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("geoid", "housing")
    return st.housing_units(units, nation.select(F.col("geoid").alias("county"), "county_name"))


@query("mrt46_address_ranges", """SELECT CAST(l_suppkey AS VARCHAR) AS zip, count(*) AS addr_ranges, count(DISTINCT l_partkey) AS street_segments, count(*) FILTER (WHERE l_returnflag = 'A') AS left_side, count(*) FILTER (WHERE l_returnflag = 'R') AS right_side, count(*) FILTER (WHERE l_linestatus = 'F') AS with_plus4 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """Lines as address ranges: the supplier is the postal code, the product the segment."""
    flag = F.col("l_returnflag")
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("zip"), F.col("l_partkey").alias("segment_id"), F.when(flag == "A", "L").when(flag == "R", "R").alias("side"), F.when(F.col("l_linestatus") == "F", "F").otherwise("").alias("plus4"),
    )
    return st.address_ranges(rows)


@query("mrt46_top_street_names", "SELECT p_name AS name, count(*) AS segments FROM part GROUP BY 1 ORDER BY segments DESC, name LIMIT 15")
def _(spark, sf):
    return st.name_counts(read_table(spark, sf, "part"), "p_name", 15)


@query("mrt50_supply_metrics", f"""{L}, {PO} SELECT supplier_id, {div('sum(received_units)', 'sum(ordered_units)', 6)} AS fulfilment_rate, {div("count(*) FILTER (WHERE on_time = 'Y' AND fill_rate_pct >= 95)", 'count(*)', 6)} AS perfect_order_rate, {div('sum(actual_lead_days)', 'count(*)', 6)} AS average_supply_time FROM po GROUP BY 1""")
def _(spark, sf):
    return st.ops_metric(po(spark, sf), st.supply_metrics(), "supplier_id")


@query("mrt50_staff_metrics", f"""{EV}, {SHIFTS} SELECT store_id, {div('sum(CASE WHEN scheduled_hours > 7 THEN scheduled_hours - 7 ELSE 0 END)', 'sum(scheduled_hours)', 6)} AS overtime_ratio, {div('count(DISTINCT employee_id)', '1', 6)} AS headcount, {div('count(*)', 'count(DISTINCT employee_id)', 6)} AS shifts_per_head, {div('sum(vacation_used)', 'sum(vacation_accrued)', 6)} AS vacation_use FROM shifts GROUP BY 1""")
def _(spark, sf):
    return st.ops_metric(inputs.shifts(spark, sf), st.staff_metrics(), "store_id")


@query("mrt50_expense_metrics", f"""{LT}, {PNL}, {BUDGET}, j AS (SELECT p.region, {fx('p.net_sales')} AS ns, {fx('p.total_store_opex + p.franchise_fees')} AS ox, {fx('b.budget_total_opex')} AS bo, p.net_sales >= b.budget_net_sales AS ok FROM budget b JOIN pnl p USING (store_id, yyyymm))
SELECT region, {div('sum(CAST(ox AS DECIMAL(18,2)))', 'sum(CAST(bo AS DECIMAL(18,2)))', 6)} AS actual_to_budget_expense, {div('sum(CAST(ox AS DECIMAL(18,2)))', 'sum(CAST(ns AS DECIMAL(18,2)))', 6)} AS opex_to_sales, {div('count(*) FILTER (WHERE ok)', 'count(*)', 6)} AS sales_on_plan_rate FROM j GROUP BY 1""")
def _(spark, sf):
    from shopledger.plans.finance import budget_vs_actual

    return st.ops_metric(budget_vs_actual(budget(spark, sf), pnl(spark, sf)), st.expense_metrics(), "region")


@query("mrt50_tenure_and_turnover", f"""{EV}, {SHIFTS}, p AS (SELECT store_id, employee_id, min(day) AS a, max(day) AS b FROM shifts GROUP BY 1, 2)
SELECT store_id, count(*) AS headcount, {div("sum(date_diff('day', a, b))", 'count(*)', 6)} AS avg_tenure_days, {div("count(*) FILTER (WHERE date_diff('day', b, DATE '2024-01-31') > 1)", 'count(*)', 6)} AS turnover_rate FROM p GROUP BY 1""")
def _(spark, sf):
    return st.tenure_turnover(inputs.shifts(spark, sf), "2024-01-31", 1)


SDAY = f"""ev0 AS (SELECT {EVENT_ID} AS event_id, min(sale_date) AS a, max(sale_date) AS b FROM sales_lines WHERE promo_type <> '' GROUP BY 1),
cal AS (SELECT d AS calendar_date, isodow(d) - 1 AS dow_num, month(d) AS mo, CASE WHEN isodow(d) >= 6 THEN 'Y' ELSE 'N' END AS is_weekend, CASE WHEN strftime(d, '%m-%d') IN ('01-01', '07-01', '12-25', '12-26') THEN 'Y' ELSE 'N' END AS is_holiday,
 (SELECT count(*) FROM ev0 WHERE d BETWEEN a AND b) AS promos_active FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)),
sd0 AS (SELECT store_id, sale_date, sum(sales) AS s, count(DISTINCT txn_id) AS tx FROM sales_lines GROUP BY 1, 2)"""


def store_day(spark, sf):
    daily = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "sale_date").agg(F.sum("sales").alias("s"), F.countDistinct("txn_id").alias("tx"))
    return dm.store_day_features(daily, calendar(spark, sf), retail.stores(spark, sf))


@query("mrt48_store_day_features", f"""{L}, {SDAY} SELECT store_id, CAST(sale_date AS VARCHAR) AS calendar_date, dow_num, mo, is_weekend, is_holiday, promos_active, region, store_format, square_feet, {m('s')} AS target_sales, tx AS target_transactions
FROM sd0 JOIN cal ON calendar_date = sale_date LEFT JOIN stores USING (store_id)""")
def _(spark, sf):
    return store_day(spark, sf).withColumn("calendar_date", F.col("calendar_date").cast("string")).withColumn("target_sales", money(F.col("target_sales")))


SPW = f"""aw AS (SELECT store_id, plu, date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), sale_date) // 7 AS week_seq, sum(quantity) AS units, sum(sales) AS sales, sum(sales) - sum(cost) AS margin, sum(CASE WHEN promo_type <> '' THEN quantity ELSE 0 END) AS promo_units FROM lines WHERE txn_type <> 'Post Void TX' GROUP BY 1, 2, 3),
pw AS (SELECT store_id, plu, unnest(range(min(week_seq), max(week_seq) + 1)) AS week_seq FROM aw GROUP BY 1, 2), spw AS (SELECT p.*, coalesce(units, 0) AS units, coalesce(sales, 0) AS sales, coalesce(margin, 0) AS margin, coalesce(promo_units, 0) AS promo_units FROM pw p LEFT JOIN aw USING (store_id, plu, week_seq))"""


def plu_week(spark, sf, weeks=dm.store_plu_week):
    df = retail.lines(spark, sf, store=False, types=(retail.SALE, retail.RETURN))
    return weeks(df, retail.span(spark, sf)[0])


@query("mrt49_dense_product_weeks", f"""{L}, {SPW} SELECT plu, count(*) AS pair_weeks, count(DISTINCT store_id) AS stores, count(*) FILTER (WHERE units = 0) AS zero_weeks, {spct('count(*) FILTER (WHERE units = 0)', 'count(*)', 4)} AS zero_share, {n('sum(units)')} AS units, {m('sum(sales)')} AS sales, {m('sum(margin)')} AS margin, {n('sum(promo_units)')} AS promo_units, min(week_seq) AS first_week, max(week_seq) AS last_week FROM spw GROUP BY 1""")
def _(spark, sf):
    z = F.count_if(F.col("units") == 0)
    return plu_week(spark, sf).groupBy("plu").agg(
        F.count(ONE).alias("pair_weeks"), F.countDistinct("store_id").alias("stores"), z.alias("zero_weeks"), pct(z, F.count(ONE), 4).alias("zero_share"), F.sum("units").alias("units"), money(F.sum("sales")).alias("sales"),
        money(F.sum("margin")).alias("margin"), F.sum("promo_units").alias("promo_units"), F.min("week_seq").alias("first_week"), F.max("week_seq").alias("last_week"),
    )
