"""Registered queries for the semantic layer (SEM, UDF-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import fixed, money
from shopledger.plans import models as md
from shopledger.plans import sales as sl
from shopledger.plans import semantic as sem
from shopledger.plans.finance import rollforward
from shopledger.queries.common import EV, L, LT, LTM, div, fx, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_customers import CM
from shopledger.plans import finance as fi
from shopledger.queries.q_finance import BUDGET, FLOWS, INV, PNL, SHIFTS, SHRINK, TENDER, aged, budget, pnl, point_flows, tender
from shopledger.queries.registry import query
from shopledger.queries.q_stores import PO
from shopledger.sources import inputs, retail
from shopledger.sources.tables import inline_table, read_table


def pos(spark, sf, name, by=(), grain=None, filters=(), default_filters=True, scale=2):
    model = md.pos_model()
    df = sem.metric(model.rows_for(spark, sf, name, by, grain, filters, default_filters), model, name, by, grain, filters, default_filters)
    return df.withColumn("value", fixed(F.col("value"), scale))


@query("sem01_dimensions", f"""{L} SELECT isodow(sale_date) AS day_of_week, promo_type <> '' AS has_promotion, txn_type = 'Regular Return' AS is_return, count(*) AS line_items FROM lines GROUP BY 1, 2, 3""")
def _(spark, sf):
    model = md.pos_model()
    keys = [F.expr(model.dimensions[d].expr).alias(d) for d in ("day_of_week", "has_promotion", "is_return")]
    return model.rows(spark, sf).groupBy(*keys).agg(F.expr(model.measures["total_line_items"].expr).alias("line_items"))


@query("sem01_line_dimensions", f"""WITH i AS (SELECT l_linenumber AS transaction_sequence, CAST(c_acctbal >= 0 AS INTEGER) AS customer_email_flag, hour(CAST(o_orderdate AS TIMESTAMP)) AS hour_of_day, strftime(CAST(o_orderdate AS TIMESTAMP), '%H:%M:%S') AS transaction_time,
 CASE WHEN l_discount >= 0.08 THEN 'T-' WHEN l_discount >= 0.05 THEN 'M-' WHEN l_discount > 0 THEN 'O-' END || strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS x, l_orderkey, CAST(p_retailprice AS DECIMAL(10,2)) AS cost
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = c_nationkey)
SELECT transaction_sequence, customer_email_flag, transaction_time, hour_of_day, coalesce(x, '') AS extended_event_id, count(*) AS line_items, count(DISTINCT l_orderkey) AS transactions, CAST(max(cost) AS DOUBLE) AS top_cost FROM i GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    model = md.pos_model()
    keys = [F.expr(model.dimensions[d].expr).alias(d) for d in ("transaction_sequence", "customer_email_flag", "transaction_time", "hour_of_day", "extended_event_id")]
    model.measure("line_items", "count(*)").measure("transactions", "count(DISTINCT transaction_number)", formula="t", distinct={"t": ("transaction_number", "true")})
    model.measure("top_cost", "CAST(max(pricebook_cost) AS double)")
    return sem.measured(model.rows(spark, sf), model, ["line_items", "transactions", "top_cost"], keys, fine=True)


@query("sem02_measures", f"""{L} SELECT region AS store_region, count(DISTINCT txn_id) AS total_transactions, {m('sum(sales)')} AS total_revenue, {m('sum(sales) - sum(cost)')} AS gross_profit, {m('sum(regular_value) - sum(sales)')} AS price_reduction_amount,
{fx('(CAST(sum(sales) AS DOUBLE) / CAST(count(DISTINCT txn_id) AS DOUBLE))', 4)} AS avg_basket_size, count(DISTINCT CASE WHEN txn_type = 'Post Void TX' THEN txn_id END) AS void_transaction_count, {m('sum(discount)')} AS total_discount, {m('sum(CAST(discount * 0.1 AS DECIMAL(18,4)))')} AS total_subsidy FROM lines GROUP BY 1""")
def _(spark, sf):
    model = md.pos_model()
    sums = ("total_revenue", "gross_profit", "price_reduction_amount", "total_discount", "total_subsidy")
    out = sem.measured(model.rows(spark, sf), model, ["total_transactions", *sums, "avg_basket_size", "void_transaction_count"], [F.col("store_region")])
    return out.select("store_region", "total_transactions", *[money(F.col(k)).alias(k) for k in sums], fixed(F.col("avg_basket_size"), 4).alias("avg_basket_size"), "void_transaction_count")


@query("sem03_metric_by_grain", f"{L} SELECT region AS store_region, CAST(CAST(date_trunc('quarter', sale_date) AS DATE) AS VARCHAR) AS quarter, {fx('CAST(sum(sales) AS DOUBLE)')} AS value FROM sales_lines GROUP BY 1, 2")
def _(spark, sf):
    return pos(spark, sf, "pos_total_revenue", ["store_region"], "quarter")


@query("sem03_margin_by_week", f"{L} SELECT CAST(CAST(date_trunc('week', sale_date) AS DATE) AS VARCHAR) AS week, {fx('(CAST(sum(sales) - sum(cost) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) * 100)', 4)} AS value FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return pos(spark, sf, "pos_gross_margin_pct", [], "week", scale=4)


@query("sem04_default_filters_lifted", f"""{L} SELECT 'default' AS scope, CAST(count(DISTINCT txn_id) AS DOUBLE) AS value FROM sales_lines UNION ALL SELECT 'lifted', CAST(count(DISTINCT txn_id) AS DOUBLE) FROM lines
UNION ALL SELECT 'asia', CAST(count(DISTINCT txn_id) AS DOUBLE) FROM sales_lines WHERE region = 'ASIA'""")
def _(spark, sf):
    a = pos(spark, sf, "pos_total_transactions").withColumn("scope", F.lit("default"))
    b = pos(spark, sf, "pos_total_transactions", default_filters=False).withColumn("scope", F.lit("lifted"))
    c = pos(spark, sf, "pos_total_transactions", filters=["store_region = 'ASIA'"]).withColumn("scope", F.lit("asia"))
    return a.unionByName(b).unionByName(c)


@query("sem04_return_rate", f"""{L} SELECT region AS store_region, {fx("(CAST(count(DISTINCT CASE WHEN txn_type = 'Regular Return' THEN txn_id END) AS DOUBLE) * 100.0::DOUBLE / CAST(count(DISTINCT CASE WHEN txn_type = 'Regular Sale' THEN txn_id END) AS DOUBLE))", 4)} AS value FROM lines GROUP BY 1""")
def _(spark, sf):
    return pos(spark, sf, "pos_return_rate", ["store_region"], scale=4)


@query("sem05_compound_metric", f"""{LT}, a AS (SELECT region, count(DISTINCT customer_id) AS u, count(DISTINCT txn_id) AS t FROM sales_lines GROUP BY 1), s AS (SELECT region, CAST(sum(square_feet) AS DOUBLE) AS f FROM stores GROUP BY 1), r AS (SELECT region, CAST(sum(sales) AS DOUBLE) AS v FROM sales_lines GROUP BY 1)
SELECT region AS store_region, {fx('(1.0::DOUBLE * (sign(v) * floor(abs(v) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE + 0.0::DOUBLE) / f)', 4)} AS value FROM r JOIN s USING (region)""")
def _(spark, sf):
    revenue = pos(spark, sf, "pos_total_revenue", ["store_region"])
    star = md.star_models()["store"]
    sqft = sem.metric(star.rows(spark, sf), star, "retail_sqft", ["region"]).withColumnRenamed("region", "store_region")
    return sem.ratio_metric(revenue, sqft, ["store_region"])


@query("sem06_level_measure", f"{LTM}, {CM}, {FLOWS} SELECT yyyymm // 100 AS yr, {n('arg_max(closing_balance, yyyymm)')} AS closing_balance, max(yyyymm) AS as_of FROM bal GROUP BY 1")
def _(spark, sf):
    bal = rollforward(point_flows(spark, sf).withColumn("all", F.lit(0)), ["all"], "yyyymm", "points_in", "points_out")
    return sem.level_measure(bal.withColumn("yr", F.floor(F.col("yyyymm") / 100)), ["yr"], "yyyymm", "closing_balance")


@query("sem07_relationship", "SELECT n_name, count(*) AS customers, max(r_name) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf):
    cust = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation_id"))
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_id"), "n_name", F.col("n_regionkey").alias("region_id"))
    region = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"), "r_name")
    full = sem.relationship(sem.relationship(cust, nation, "nation_id"), region, "region_id")
    return full.groupBy("n_name").agg(F.count("*").alias("customers"), F.max("r_name").alias("region"))


@query("sem08_metric_crosscheck", f"""{L}, a AS (SELECT 'pos_total_transactions' AS metric, CAST(count(DISTINCT txn_id) AS DOUBLE) AS metric_value, CAST(count(DISTINCT txn_id) AS DOUBLE) AS tile_value FROM sales_lines
UNION ALL SELECT 'pos_total_revenue', {m('sum(sales)')}, {m('sum(sales)')} FROM sales_lines UNION ALL SELECT 'pos_units_by_product', CAST(sum(quantity) AS DOUBLE), (SELECT CAST(sum(quantity) AS DOUBLE) FROM lines) FROM sales_lines)
SELECT *, CASE WHEN metric_value = tile_value THEN 'MATCH' WHEN abs(metric_value - tile_value) / abs(tile_value) <= 0.005 THEN 'MATCH (within 0.5 pct)' ELSE 'DELTA' END AS verdict, {spct('metric_value - tile_value', 'tile_value', 4)} AS delta_pct FROM a""")
def _(spark, sf):
    kpi = sl.dash_kpi(retail.sales_lines(spark, sf, store=False))
    every = retail.raw_lines(spark, sf).join(retail.headers(spark, sf), "txn_id").agg(F.sum("quantity").alias("q"))
    return sem.crosscheck([
        ("pos_total_transactions", pos(spark, sf, "pos_total_transactions"), kpi.select("tx")), ("pos_total_revenue", pos(spark, sf, "pos_total_revenue"), kpi.select("sales")),
        ("pos_units_by_product", pos(spark, sf, "pos_units_by_product"), every),
    ])


@query("sem09_definition_drift", """
WITH a AS (SELECT 'metric_' || p_partkey AS name, 'sum(' || p_name || ')' AS e, p_partkey AS k FROM part)
SELECT name, CASE WHEN k % 11 <> 0 THEN e END AS actual, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN e || ' * 2' ELSE e END AS expected,
CASE WHEN k % 11 = 0 THEN 'MISSING' WHEN k % 13 = 0 THEN 'UNEXPECTED' WHEN k % 7 = 0 THEN 'DRIFT' ELSE 'SAME' END AS status FROM a WHERE NOT (k % 11 = 0 AND k % 13 = 0)""")
def _(spark, sf):
    k = F.col("p_partkey")
    defs = read_table(spark, sf, "part").select(k, F.concat(F.lit("metric_"), k.cast("string")).alias("name"), F.concat(F.lit("sum("), "p_name", F.lit(")")).alias("expr"))
    actual = defs.where(k % 11 != 0)
    expected = defs.where(k % 13 != 0).withColumn("expr", F.when(k % 7 == 0, F.concat("expr", F.lit(" * 2"))).otherwise(F.col("expr")))
    return sem.expr_drift(actual, expected)


@query("sem10_calc_and_prefilter", f"{L}, {SHRINK} SELECT reason, {fx('CAST(sum(shrink_value) AS DOUBLE)')} AS value FROM shrink WHERE reason <> 'Admin error' GROUP BY 1")
def _(spark, sf):
    model = md.star_models()["expense_fact"]
    return sem.metric(model.rows(spark, sf), model, "retail_total_store_expenses", ["reason"]).withColumn("value", fixed(F.col("value"), 2))


@query("sem11_star_models", f"""{L}, {PO} SELECT 'retail_gross_profit' AS metric, category AS member, {fx('CAST(sum(sales) - sum(cost) AS DOUBLE)')} AS value FROM sales_lines GROUP BY 2
UNION ALL SELECT 'warehouse_fulfillment_rate', CAST(supplier_id AS VARCHAR), {fx('(CAST(sum(received_units) AS DOUBLE) * 100.0::DOUBLE / CAST(sum(ordered_units) AS DOUBLE))')} FROM po GROUP BY 2""")
def _(spark, sf):
    star = md.star_models()

    def one(model, name, by):
        df = sem.metric(model.rows(spark, sf), model, name, [by])
        return df.select(F.lit(name).alias("metric"), F.col(by).cast("string").alias("member"), fixed(F.col("value"), 2).alias("value"))

    return one(star["sales_fact"], "retail_gross_profit", "product_family").unionByName(one(star["inventory_fact"], "warehouse_fulfillment_rate", "supplier_id"))


@query("sem11_star_staff", f"{EV}, {SHIFTS} SELECT store_id, {fx('CAST(sum(CAST(scheduled_hours * hourly_rate AS DECIMAL(12,2))) AS DOUBLE)')} AS value FROM shifts GROUP BY 1")
def _(spark, sf):
    model = md.star_models()["employee"]
    return sem.metric(model.rows(spark, sf), model, "hr_salary", ["store_id"]).withColumn("value", fixed(F.col("value"), 2))


@query("udf01_user_measure", f"{L} SELECT promo_type AS promotion_type, {fx('CAST(sum(CASE WHEN quantity >= 25 THEN sales ELSE 0 END) AS DOUBLE)')} AS value FROM sales_lines GROUP BY 1")
def _(spark, sf):
    model = md.pos_model().measure("bulk_revenue", "sum(CASE WHEN quantity >= 25 THEN selling_price ELSE 0 END)", "CAD")
    model.metric("bulk_revenue", "bulk_revenue", ["promotion_type"], [md.REGULAR])
    return sem.metric(model.rows(spark, sf), model, "bulk_revenue", ["promotion_type"]).withColumn("value", fixed(F.col("value"), 2))


def finance(spark, sf, model, name, by, scale=2):
    def rows_of(key):
        builders = {
            "store_pnl": pnl, "gl": lambda s, f: fi.gl_monthly(pnl(s, f), budget(s, f)), "ap_invoices": aged, "tender": lambda s, f: fi.dash_tender(tender(s, f)),
            "pricebook": lambda s, f: fi.pricebook(retail.sales_lines(s, f, store=False)),
        }
        return builders[key]

    m_ = md.finance_models({k: rows_of(k) for k in ("store_pnl", "gl", "ap_invoices", "tender", "pricebook")})[model]
    df = sem.metric(m_.rows(spark, sf), m_, name, [by])
    return df.select(F.lit(name).alias("metric"), F.col(by).cast("string").alias("member"), fixed(F.col("value"), scale).alias("value"))


def D(x):
    return f"sum(CAST({x} AS DECIMAL(20,4)))"


def R(a, b):
    return f"(CAST({a} AS DOUBLE) * 100 / nullif(CAST({b} AS DOUBLE), 0))"


@query("sem03_profit_metrics", f"""{LT}, {PNL} SELECT 'four_wall_margin_pct' AS metric, region AS member, {fx(R(D('four_wall_ebitda'), D('net_sales')), 4)} AS value FROM pnl GROUP BY 2
UNION ALL SELECT 'labour_pct_of_sales', store_format, {fx(R(D('labour_cost + labour_burden'), D('net_sales')), 4)} FROM pnl GROUP BY 2""")
def _(spark, sf):
    return finance(spark, sf, "store_pnl", "four_wall_margin_pct", "region", 4).unionByName(finance(spark, sf, "store_pnl", "labour_pct_of_sales", "store_format", 4))


@query("sem03_payable_metrics", f"""{L}, {INV} SELECT 'open_balance' AS metric, payment_terms AS member, {fx(f"CAST({D('balance')} AS DOUBLE)")} AS value FROM aged GROUP BY 2
UNION ALL SELECT 'days_payable', region, {fx('(sum(days_to_pay) / CAST(count(days_to_pay) AS DOUBLE))')} FROM aged GROUP BY 2""")
def _(spark, sf):
    return finance(spark, sf, "ap_invoices", "open_balance", "payment_terms").unionByName(finance(spark, sf, "ap_invoices", "days_payable", "region"))


@query("sem03_tender_metrics", f"""{L}, {TENDER} SELECT 'processing_fees' AS metric, tender_type AS member, {fx(f"CAST({D('processing_fee')} AS DOUBLE)")} AS value FROM dt GROUP BY 2""")
def _(spark, sf):
    return finance(spark, sf, "tender", "processing_fees", "tender_type")
