"""Registered queries for sales marts (MRT-01..07, 40, 47)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import dow0, jdn, money, period
from shopledger.plans import sales as sl
from shopledger.queries.common import EV, L, LT, MONTHS, div, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.registry import query
from shopledger.sources import retail
from shopledger.sources.tables import read_table

# Fixed-date holidays of the sample calendar.
HOLIDAYS = [("01-01", "New Years Day"), ("07-01", "Canada Day"), ("12-25", "Christmas Day"), ("12-26", "Boxing Day")]


def promo_spans(spark, sf):
    """First and last day of every promotion event."""
    df = retail.sales_lines(spark, sf, product=False, store=False).withColumn("event_id", retail.event_id(F.col("promo_type"), F.col("sale_date")))
    return df.where("event_id <> ''").groupBy("event_id").agg(F.min("sale_date").alias("start_date"), F.max("sale_date").alias("end_date"))


def calendar(spark, sf):
    return sl.build_calendar(spark, *retail.span(spark, sf), HOLIDAYS, promo_spans(spark, sf), retail.PERIOD_CUT, retail.PERIODS)


EVENT_ID = "CASE WHEN promo_type <> '' THEN promo_type || '-' || year(sale_date) || 'Q' || quarter(sale_date) ELSE '' END"
PERIOD = "CASE WHEN sale_date >= DATE '1998-03-01' THEN 'After' ELSE 'Before' END"
MEAS = f"{m('sum(sales)')} AS sales, {m('sum(cost)')} AS cost, {n('sum(quantity)')} AS qty, count(DISTINCT txn_id) AS tx, count(*) AS line_items"


@query("mrt01_transactions", f"""{LT}
SELECT txn_id, customer_id, store_id, CAST(sale_date AS VARCHAR) AS sale_date, jdn, yyyymm, txn_type, line_items, basket_items, {m('basket_value')} AS basket_value,
{m('basket_cost')} AS basket_cost, {m('basket_margin')} AS basket_margin, {m('discount_total')} AS discount_total, {m('promo_value')} AS promo_value, promo_flag, distinct_plus, distinct_categories,
CASE WHEN isodow(sale_date) >= 6 THEN 'Y' ELSE 'N' END AS is_weekend, CASE WHEN strftime(sale_date, '%m-%d') IN ('01-01', '07-01', '12-25', '12-26') THEN 'Y' ELSE 'N' END AS is_holiday,
{PERIOD} AS period, CASE WHEN channel = 'Delivery' THEN 'Y' ELSE 'N' END AS ecommerce_flag FROM txn""")
def _(spark, sf):
    online = read_table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("txn_id"))
    t = sl.build_txn(retail.transactions(spark, sf, distinct=True), calendar(spark, sf), online)
    return t.select(
        "txn_id", "customer_id", "store_id", F.col("sale_date").cast("string").alias("sale_date"), "jdn", "yyyymm", "txn_type", "line_items", "basket_items",
        *[money(F.col(c)).alias(c) for c in ("basket_value", "basket_cost", "basket_margin", "discount_total", "promo_value")],
        "promo_flag", "distinct_plus", "distinct_categories", "is_weekend", "is_holiday", "period", "ecommerce_flag",
    )


@query("mrt02_monthly_dashboard", f"""{L}
SELECT year(sale_date) AS yr, month(sale_date) AS mo, region, promo_type, {PERIOD} AS period, {MEAS} FROM sales_lines GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    return sl.dash_monthly(retail.sales_lines(spark, sf), period(F.col("sale_date"), retail.PERIOD_CUT, *retail.PERIODS))


@query("mrt03_region", f"{L} SELECT region, count(DISTINCT store_id) AS stores, {MEAS} FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return sl.dash_by(retail.sales_lines(spark, sf), ["region"], stores=True)


@query("mrt03_province", f"{L} SELECT province, count(DISTINCT store_id) AS stores, {MEAS} FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return sl.dash_by(retail.sales_lines(spark, sf), ["province"], stores=True)


@query("mrt03_promotion", f"{L} SELECT promo_type, region, year(sale_date) AS yr, month(sale_date) AS mo, {MEAS} FROM sales_lines GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    df = retail.sales_lines(spark, sf).withColumn("yr", F.year("sale_date")).withColumn("mo", F.month("sale_date"))
    return sl.dash_by(df, ["promo_type", "region", "yr", "mo"])


@query("mrt03_store", f"{L} SELECT store_id, store_name, region, province, {MEAS} FROM sales_lines GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return sl.dash_by(retail.sales_lines(spark, sf), ["store_id", "store_name", "region", "province"])


@query("mrt04_whole_period_kpi", f"{L} SELECT {MEAS} FROM sales_lines")
def _(spark, sf):
    return sl.dash_kpi(retail.sales_lines(spark, sf, store=False))


@query("mrt05_calendar", f"""{L}, ev AS (SELECT {EVENT_ID} AS event_id, min(sale_date) AS a, max(sale_date) AS b FROM sales_lines WHERE promo_type <> '' GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS sale_date FROM orders)
SELECT CAST(sale_date AS VARCHAR) AS calendar_date, CAST(julian(sale_date) AS BIGINT) AS jdn, year(sale_date) AS yr, month(sale_date) AS mo, day(sale_date) AS day_of_month, dayofyear(sale_date) AS day_of_year,
quarter(sale_date) AS quarter, year(sale_date) * 100 + month(sale_date) AS yyyymm, monthname(sale_date) AS month_name, isodow(sale_date) - 1 AS dow_num, dayname(sale_date) AS day_name,
CASE WHEN isodow(sale_date) >= 6 THEN 'Y' ELSE 'N' END AS is_weekend, (dayofyear(sale_date) - 1) // 7 + 1 AS week_of_year,
CASE WHEN strftime(sale_date, '%m-%d') IN ('01-01', '07-01', '12-25', '12-26') THEN 'Y' ELSE 'N' END AS is_holiday,
CASE strftime(sale_date, '%m-%d') WHEN '01-01' THEN 'New Years Day' WHEN '07-01' THEN 'Canada Day' WHEN '12-25' THEN 'Christmas Day' WHEN '12-26' THEN 'Boxing Day' END AS holiday_name,
{PERIOD} AS period, (SELECT count(*) FROM ev WHERE c.sale_date BETWEEN a AND b) AS promos_active FROM c""")
def _(spark, sf):
    return calendar(spark, sf).withColumn("calendar_date", F.col("calendar_date").cast("string"))


@query("mrt06_daily", f"{L} SELECT CAST(sale_date AS VARCHAR) AS day, {m('sum(sales)')} AS sales, count(DISTINCT txn_id) AS tx, {div('sum(sales)', 'count(DISTINCT txn_id)')} AS avg_ticket FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return sl.pattern(retail.sales_lines(spark, sf, product=False, store=False), [F.col("sale_date").cast("string").alias("day")])


@query("mrt06_hourly", f"{EV} SELECT hour, {m('sum(value)')} AS sales, count(DISTINCT event_id) AS tx, {div('sum(value)', 'count(DISTINCT event_id)')} AS avg_ticket FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def _(spark, sf):
    return sl.pattern(retail.event_days(spark, sf).where("event_type = 'purchase'"), [F.col("hour")], "value", "event_id")


@query("mrt06_weekday", f"{L} SELECT isodow(sale_date) - 1 AS dow_num, dayname(sale_date) AS day_name, {m('sum(sales)')} AS sales, count(DISTINCT txn_id) AS tx, {div('sum(sales)', 'count(DISTINCT txn_id)')} AS avg_ticket FROM sales_lines GROUP BY 1, 2")
def _(spark, sf):
    from shopledger.functions import day_name

    d = F.col("sale_date")
    return sl.pattern(retail.sales_lines(spark, sf, product=False, store=False), [dow0(d).alias("dow_num"), day_name(d).alias("day_name")])


@query("mrt07_loyalty_split", f"""{L}, g AS (SELECT CASE WHEN customer_id % 3 <> 0 THEN 'Loyal' ELSE 'Anonymous' END AS shopper, sum(sales) AS s, count(DISTINCT txn_id) AS tx FROM sales_lines GROUP BY 1)
SELECT shopper, {m('s')} AS sales, tx, {spct('s', '(SELECT sum(s) FROM g)')} AS share_pct FROM g""")
def _(spark, sf):
    return sl.loyalty_split(retail.sales_lines(spark, sf, product=False, store=False), F.col("customer_id") % 3 != 0)


@query("mrt07_returns_and_voids", f"""{L}, g AS (SELECT txn_type, sum(sales) AS s, count(DISTINCT txn_id) AS tx FROM lines GROUP BY 1)
SELECT txn_type, {m('s')} AS value, tx, {spct('s', "(SELECT s FROM g WHERE txn_type = 'Regular Sale')")} AS pct_of_sales FROM g WHERE txn_type <> 'Regular Sale'""")
def _(spark, sf):
    return sl.returns_voids(retail.lines(spark, sf, product=False, store=False))


def visits(spark, sf):
    ev = retail.event_days(spark, sf)
    bought = F.col("event_type") == "purchase"
    return ev.select(
        "store_id", F.col("day").cast("string").alias("day"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("visitors"),
        F.when(bought, 1).otherwise(0).alias("transactions"), F.when(bought, F.col("value")).otherwise(F.lit(0)).alias("sales"),
    )


TRAFFIC = """traffic AS (SELECT store_id, day, count(*) FILTER (WHERE event_type = 'view') AS visitors, count(*) FILTER (WHERE event_type = 'purchase') AS transactions,
sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS s FROM ev GROUP BY 1, 2)"""


@query("mrt40_store_day_traffic", f"""{EV}, {TRAFFIC}
SELECT store_id, CAST(day AS VARCHAR) AS day, visitors, transactions, {m('s')} AS sales, {div('s', 'transactions', 6)} AS avg_ticket, {spct('transactions', 'visitors')} AS conversion_pct FROM traffic""")
def _(spark, sf):
    return sl.traffic(visits(spark, sf))


STAR = f"{m('sum(sales)')} AS sales, {m('sum(cost)')} AS cost, {m('sum(sales) - sum(cost)')} AS profit, {n('sum(quantity)')} AS units"


@query("mrt47_star_by_family", f"{L} SELECT category, {STAR} FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return sl.star_report(retail.sales_lines(spark, sf, store=False), "category")


@query("mrt47_star_top_customers", f"{L} SELECT customer_id, {STAR} FROM sales_lines GROUP BY 1 ORDER BY sales DESC, customer_id LIMIT 5")
def _(spark, sf):
    return sl.star_report(retail.sales_lines(spark, sf, store=False), "customer_id", "sales", 5)


@query("mrt47_star_store_profit", f"{L} SELECT store_name, {STAR} FROM sales_lines GROUP BY 1 ORDER BY profit DESC, store_name LIMIT 10")
def _(spark, sf):
    return sl.star_report(retail.sales_lines(spark, sf), "store_name", "profit", 10)


@query("mrt47_star_by_region", f"{L} SELECT region, {STAR} FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return sl.star_report(retail.sales_lines(spark, sf), "region")


@query("mrt47_star_by_promotion", f"{L} SELECT promo_type, {STAR} FROM sales_lines GROUP BY 1")
def _(spark, sf):
    return sl.star_report(retail.sales_lines(spark, sf, store=False), "promo_type")


@query("mrt47_star_top_products", f"{L} SELECT product_name, {STAR} FROM sales_lines GROUP BY 1 ORDER BY sales DESC, product_name LIMIT 10")
def _(spark, sf):
    return sl.star_report(retail.sales_lines(spark, sf, store=False), "product_name", "sales", 10)


@query("mrt47_star_months", f"{L} SELECT strftime(sale_date, '%m %b') AS month_label, {STAR} FROM sales_lines GROUP BY 1")
def _(spark, sf):
    from shopledger.functions import month_label

    df = retail.sales_lines(spark, sf, store=False).withColumn("month_label", month_label(F.col("sale_date")))
    return sl.star_report(df, "month_label")
