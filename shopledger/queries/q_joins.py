"""Registered queries for joins (JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import jdn, money, pct, yyyymm
from shopledger.operators import joins as jn
from shopledger.queries.common import EV, L, LT, LTM, MONTHS, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.registry import query
from shopledger.sources import retail
from shopledger.sources.tables import inline_table, read_table

# Month ends used as cutoffs: 15 for training, one for scoring.
CUTOFFS = [
    "1999-07-31", "1999-08-31", "1999-09-30", "1999-10-31", "1999-11-30", "1999-12-31", "2000-01-31", "2000-02-29",
    "2000-03-31", "2000-04-30", "2000-05-31", "2000-06-30", "2000-07-31", "2000-08-31", "2000-09-30", "2000-12-31",
]
CUT_SQL = "cutoffs AS (SELECT CAST(d AS DATE) AS d, date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) + 2440588 AS as_of FROM (VALUES " + ", ".join(f"('{c}')" for c in CUTOFFS) + ") t(d))"


def cut_jdns() -> list[int]:
    from datetime import date

    return [(date.fromisoformat(c) - date(1970, 1, 1)).days + 2440588 for c in CUTOFFS]


def purchase_days(spark, sf):
    """Customer-day grain of regular sales."""
    return (
        retail.headers(spark, sf).where(F.col("txn_type") == retail.SALE)
        .groupBy("customer_id", jdn(F.col("sale_date")).alias("jdn")).agg(F.count(F.lit(1)).alias("baskets"))
    )


DAYS = "days AS (SELECT customer_id, jdn, count(*) AS baskets FROM (SELECT customer_id, date_diff('day', DATE '1970-01-01', sale_date) + 2440588 AS jdn FROM headers WHERE txn_type = 'Regular Sale') h GROUP BY 1, 2)"


@query("jn01_star_join", f"""{L}
SELECT l.category, year(sale_date) AS yr, quarter(sale_date) AS qtr, {m('sum(sales)')} AS sales, {n('sum(quantity)')} AS units
FROM sales_lines l GROUP BY 1, 2, 3""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, store=False)
    return df.groupBy("category", F.year("sale_date").alias("yr"), F.quarter("sale_date").alias("qtr")).agg(
        money(F.sum("sales")).alias("sales"), F.sum("quantity").alias("units")
    )


@query("jn02_customer_enrichment", """
SELECT c_custkey AS customer_id, c_mktsegment AS segment, n_name AS province, r_name AS region, a.events, b.txns
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY 1) a ON a.user_id = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS txns FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def _(spark, sf):
    cust = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("store_id")
    )
    store = retail.stores(spark, sf).select("store_id", "province", "region")
    events = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("customer_id")).agg(F.count(F.lit(1)).alias("events"))
    txns = read_table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("txns"))
    return jn.enrich(cust, [(store, "store_id"), (events, "customer_id"), (txns, "customer_id")]).drop("store_id")


@query("jn03_spine_assembly", f"""{L}, {MONTHS}, h AS (SELECT *, year(sale_date) * 100 + month(sale_date) AS yyyymm FROM headers),
spine AS (SELECT s.store_id, mo.yyyymm FROM stores s CROSS JOIN months mo)
SELECT s.store_id, s.yyyymm, coalesce(a.sales_txns, 0) AS sales_txns, coalesce(b.return_txns, 0) AS return_txns, coalesce(c.void_txns, 0) AS void_txns
FROM spine s
LEFT JOIN (SELECT store_id, yyyymm, count(*) AS sales_txns FROM h WHERE txn_type = 'Regular Sale' GROUP BY 1, 2) a USING (store_id, yyyymm)
LEFT JOIN (SELECT store_id, yyyymm, count(*) AS return_txns FROM h WHERE txn_type = 'Regular Return' GROUP BY 1, 2) b USING (store_id, yyyymm)
LEFT JOIN (SELECT store_id, yyyymm, count(*) AS void_txns FROM h WHERE txn_type = 'Post Void TX' GROUP BY 1, 2) c USING (store_id, yyyymm)""")
def _(spark, sf):
    heads = retail.headers(spark, sf).withColumn("yyyymm", yyyymm(F.col("sale_date")))
    spine = jn.explode_by_dim(retail.stores(spark, sf).select("store_id"), retail.months(spark, sf).select("yyyymm"))
    parts = [
        heads.where(F.col("txn_type") == t).groupBy("store_id", "yyyymm").agg(F.count(F.lit(1)).alias(c))
        for t, c in ((retail.SALE, "sales_txns"), (retail.RETURN, "return_txns"), (retail.VOID, "void_txns"))
    ]
    return jn.assemble(spine, parts, ["store_id", "yyyymm"], ["sales_txns", "return_txns", "void_txns"])


@query("jn04_clean_key_join", f"""{L}
SELECT coalesce(p.category, 'none') AS category, count(*) AS line_items FROM raw_lines r
LEFT JOIN products p ON r.plu = p.plu AND p.category <> 'PROMO' GROUP BY 1""")
def _(spark, sf):
    dirty = retail.raw_lines(spark, sf).select(F.concat(F.lit(" "), F.col("plu").cast("string"), F.lit("  ")).alias("code"))
    prod = retail.products(spark, sf).select(F.col("plu").cast("string").alias("plu"), "category")
    out = jn.join_clean(dirty, prod, "code", "plu", prod["category"] != "PROMO")
    return out.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("line_items"))


@query("jn05_one_row_scalars", """
WITH a AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders)
SELECT o_custkey AS customer_id, date_diff('day', max(CAST(o_orderdate AS DATE)), any_value(as_of)) AS days_silent
FROM orders, a GROUP BY 1""")
def _(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("d"))
    last = orders.groupBy("customer_id").agg(F.max("d").alias("d"))
    out = jn.with_scalars(last, orders.agg(F.max("d").alias("as_of")))
    return out.select("customer_id", F.datediff("as_of", "d").alias("days_silent"))


@query("jn06_explode_by_accounts", f"""{LT},
sm AS (SELECT store_id, yyyymm, sum(basket_value) AS sales, sum(basket_cost) AS cost FROM txn WHERE txn_type = 'Regular Sale' GROUP BY 1, 2)
SELECT store_id, yyyymm, account, {m("CASE account WHEN '4000' THEN sales ELSE -cost END")} AS amount
FROM sm CROSS JOIN (VALUES ('4000'), ('5000')) a(account)""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("sales"), F.sum("cost").alias("cost"))
    accounts = inline_table(spark, [("4000",), ("5000",)], "account string")
    out = jn.explode_by_dim(df, accounts)
    amount = F.when(F.col("account") == "4000", F.col("sales")).otherwise(-F.col("cost"))
    return out.select("store_id", "yyyymm", "account", money(amount).alias("amount"))


@query("jn07_stacked_snapshots", f"""{L}, {DAYS}, {CUT_SQL}
SELECT as_of, customer_id, count(*) AS purchase_days, {n('sum(baskets)')} AS baskets, min(jdn) AS first_jdn, max(jdn) AS last_jdn
FROM days JOIN cutoffs ON jdn <= as_of GROUP BY 1, 2""")
def _(spark, sf):
    snap = jn.asof_snapshots(purchase_days(spark, sf), cut_jdns(), "jdn")
    return snap.groupBy("as_of", "customer_id").agg(
        F.count(F.lit(1)).alias("purchase_days"), F.sum("baskets").alias("baskets"), F.min("jdn").alias("first_jdn"), F.max("jdn").alias("last_jdn")
    )


@query("jn08_lookback_180", f"""{L}, {DAYS}, {CUT_SQL}
SELECT as_of, customer_id, count(*) AS purchase_days, {n('sum(baskets)')} AS baskets
FROM days JOIN cutoffs ON jdn <= as_of AND jdn > as_of - 180 GROUP BY 1, 2""")
def _(spark, sf):
    return jn.lookback_join(purchase_days(spark, sf), cut_jdns(), "jdn", 180).groupBy("as_of", "customer_id").agg(
        F.count(F.lit(1)).alias("purchase_days"), F.sum("baskets").alias("baskets")
    )


@query("jn09_forward_90", f"""{L}, {DAYS}, {CUT_SQL}
SELECT as_of, customer_id, min(jdn) - as_of AS next_purchase_days FROM days JOIN cutoffs ON jdn > as_of AND jdn <= as_of + 90 GROUP BY 1, 2""")
def _(spark, sf):
    return jn.forward_join(purchase_days(spark, sf), cut_jdns(), "jdn", 90).groupBy("as_of", "customer_id").agg(
        (F.min("jdn") - F.col("as_of")).alias("next_purchase_days")
    )


@query("jn10_dense_spine", f"""{L},
w AS (SELECT store_id, category, (date_diff('day', DATE '1995-01-01', sale_date)) // 7 AS week_seq FROM sales_lines),
p AS (SELECT store_id, category, min(week_seq) AS a, max(week_seq) AS b FROM w GROUP BY 1, 2)
SELECT store_id, category, {n('unnest(range(a, b + 1))')} AS week_seq FROM p""")
def _(spark, sf):
    week = F.floor(F.datediff("sale_date", F.lit("1995-01-01").cast("date")) / 7)
    df = retail.sales_lines(spark, sf, store=False).withColumn("week_seq", week)
    pairs = df.groupBy("store_id", "category").agg(F.min("week_seq").alias("a"), F.max("week_seq").alias("b"))
    return jn.dense_spine(pairs, "a", "b", "week_seq").drop("a", "b")


@query("jn11_active_intervals", f"""{L},
days AS (SELECT DISTINCT sale_date AS day FROM lines),
spans AS (SELECT customer_id, min(sale_date) AS a, max(sale_date) AS b FROM lines GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, (SELECT count(*) FROM spans WHERE day BETWEEN a AND b) AS active FROM days""")
def _(spark, sf):
    heads = retail.headers(spark, sf).join(retail.raw_lines(spark, sf), "txn_id", "left_semi").select("customer_id", F.col("sale_date").alias("day"))
    spans = heads.groupBy("customer_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    out = jn.active_count(heads.select("day").distinct(), spans, "day", "a", "b", "active")
    return out.select(F.col("day").cast("string").alias("day"), "active")


RATE_ROWS = [
    ("AFRICA", "1995-01-01", 5.0), ("AMERICA", "1995-01-01", 8.0), ("AMERICA", "1997-07-01", 7.0),
    ("ASIA", "1996-01-01", 6.0), ("EUROPE", "1995-01-01", 20.0), ("EUROPE", "1999-01-01", 19.0), ("EUROPE", "2000-01-01", 21.0),
]


def rates(spark):
    return inline_table(spark, RATE_ROWS, "region string, effective_from string, rate double").withColumn(
        "effective_from", F.col("effective_from").cast("date")
    )


RATES_SQL = "rates AS (SELECT region, CAST(f AS DATE) AS effective_from, CAST(rate AS DOUBLE) AS rate FROM (VALUES " + ", ".join(f"('{r}', '{f}', {v})" for r, f, v in RATE_ROWS) + ") t(region, f, rate))"


@query("jn12_effective_dated_rate", f"""{L}, {RATES_SQL},
sm AS (SELECT region, yyyymm, make_date(yyyymm // 100, yyyymm % 100, 1) AS ms, sum(sales) AS sales FROM sales_lines GROUP BY 1, 2)
SELECT sm.region, yyyymm, {m('sales')} AS sales,
       (SELECT r.rate FROM rates r WHERE r.region = sm.region AND r.effective_from <= ms ORDER BY r.effective_from DESC LIMIT 1) AS rate FROM sm""")
def _(spark, sf):
    sm = retail.sales_lines(spark, sf, product=False).groupBy("region", "yyyymm", F.trunc("sale_date", "month").alias("ms")).agg(F.sum("sales").alias("sales"))
    sm = sm.withColumnRenamed("region", "area")
    out = jn.asof_join(sm.withColumnRenamed("area", "region"), rates(spark), "region", "ms", "effective_from")
    return out.select("region", "yyyymm", money(F.col("sales")).alias("sales"), "rate")


@query("jn13_prior_year", f"""{L},
sm AS (SELECT store_id, yyyymm, sum(sales) AS sales FROM sales_lines GROUP BY 1, 2)
SELECT a.store_id, a.yyyymm, {m('a.sales')} AS sales, {m('b.sales')} AS sales_py FROM sm a
LEFT JOIN sm b ON a.store_id = b.store_id AND b.yyyymm = a.yyyymm - 100""")
def _(spark, sf):
    sm = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("sales"))
    out = jn.prior_year(sm, ["store_id"], "yyyymm", ["sales"])
    return out.withColumn("sales", money(F.col("sales"))).withColumn("sales_py", money(F.col("sales_py")))


@query("jn14_version_pivot", f"""{L},
v AS (SELECT store_id, yyyymm, 'Original' AS version, sum(sales) * 2 AS budget FROM sales_lines GROUP BY 1, 2
      UNION ALL SELECT store_id, yyyymm, 'Reforecast', sum(sales) * 3 FROM sales_lines WHERE yyyymm >= 200001 GROUP BY 1, 2)
SELECT a.store_id, a.yyyymm, {m('a.budget')} AS o_budget, {m('b.budget')} AS r_budget FROM v a
LEFT JOIN v b ON b.store_id = a.store_id AND b.yyyymm = a.yyyymm AND b.version = 'Reforecast' WHERE a.version = 'Original'""")
def _(spark, sf):
    sm = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("sales"))
    # both versions come from one aggregate: a row per version by an array
    versions = sm.select(
        "store_id", "yyyymm",
        F.explode(F.array(F.struct(F.lit("Original").alias("version"), (F.col("sales") * 2).alias("budget")),
                          F.struct(F.lit("Reforecast").alias("version"), (F.col("sales") * 3).alias("budget")))).alias("v"),
    ).select("store_id", "yyyymm", "v.*").where("version = 'Original' OR yyyymm >= 200001")
    out = jn.version_pivot(versions, ["store_id", "yyyymm"], "version", {"Original": "o", "Reforecast": "r"}, ["budget"])
    return out.withColumn("o_budget", money(F.col("o_budget"))).withColumn("r_budget", money(F.col("r_budget")))


@query("jn15_basket_pairs", """
WITH i AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS plu FROM lineitem),
s AS (SELECT basket FROM i GROUP BY 1 HAVING count(*) >= 2)
SELECT a.plu AS item_a, b.plu AS item_b, count(*) AS pair_baskets FROM i a JOIN i b ON a.basket = b.basket AND a.plu < b.plu
JOIN s ON s.basket = a.basket GROUP BY 1, 2""")
def _(spark, sf):
    items = retail.raw_lines(spark, sf).select(F.col("txn_id").alias("basket"), "plu")
    return jn.basket_pairs(items).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("pair_baskets"))


@query("jn16_scalar_lookup", f"""{L}
SELECT s.store_id, s.store_name, (SELECT {m('sum(sales)')} FROM sales_lines l WHERE l.store_id = s.store_id) AS all_sales FROM stores s""")
def _(spark, sf):
    fact = retail.sales_lines(spark, sf, product=False, store=False)
    return jn.scalar_lookup(retail.stores(spark, sf).select("store_id", "store_name"), fact, "store_id", money(F.sum("sales")), "all_sales")


@query("jn17_theta_count", """
SELECT n_nationkey AS store_id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND (s_suppkey % 50) / 10.0 <= 2) AS near FROM nation""")
def _(spark, sf):
    near = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("store_id"), ((F.col("s_suppkey") % 50) / 10.0).alias("distance_km"))
    return jn.theta_count(retail.stores(spark, sf).select("store_id"), near, "store_id", F.col("distance_km") <= 2, "near")


@query("jn18_below_group_mean", f"""{L},
t AS (SELECT store_id, store_format, sum(sales) AS sales FROM sales_lines JOIN stores USING (store_id) GROUP BY 1, 2)
SELECT store_id, store_format, {m('sales')} AS sales FROM t WHERE sales < (SELECT avg(sales) FROM t x WHERE x.store_format = t.store_format)""")
def _(spark, sf):
    t = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id").agg(F.sum("sales").alias("sales"))
    t = t.join(retail.stores(spark, sf).select("store_id", "store_format"), "store_id")
    return jn.below_group_mean(t, "store_format", "sales").withColumn("sales", money(F.col("sales")))


@query("jn19_semi_join", f"""{L}
SELECT month(sale_date) AS mo, count(*) AS line_items FROM sales_lines WHERE year(sale_date) = 2000
AND month(sale_date) IN (SELECT DISTINCT month(sale_date) FROM sales_lines WHERE year(sale_date) = 2001) GROUP BY 1""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False, store=False).withColumn("mo", F.month("sale_date"))
    other = df.where("yyyymm >= 200101").select("mo")
    return jn.semi(df.where("yyyymm BETWEEN 200001 AND 200012"), other, "mo").groupBy("mo").agg(F.count(F.lit(1)).alias("line_items"))


@query("jn20_anti_join", """
SELECT p_partkey AS plu, p_name AS product_name FROM part WHERE p_partkey NOT IN
 (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')""")
def _(spark, sf):
    sold = retail.raw_lines(spark, sf).where(F.col("ship_date") >= "2001-01-01").select("plu")
    return jn.anti(retail.products(spark, sf), sold, "plu").select("plu", "product_name")


@query("jn21_join_tree", """
SELECT n_name AS province, r_name AS region, s.suppliers, c.customers FROM nation
JOIN region ON n_regionkey = r_regionkey
FULL OUTER JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey AND r_name <> 'ASIA'""")
def _(spark, sf):
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    sup = read_table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    cust = read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    tree = jn.join_tree(nation, [
        (region, nation.n_regionkey == region.r_regionkey, "inner"),
        (sup, nation.n_nationkey == sup.s_nationkey, "full"),
        (cust, (nation.n_nationkey == cust.c_nationkey) & (region.r_name != "ASIA"), "left"),
    ])
    return tree.select(F.col("n_name").alias("province"), F.col("r_name").alias("region"), "suppliers", "customers")


@query("jn22_presence_flag", """
SELECT c_custkey AS customer_id, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) THEN 'Y' ELSE 'N' END AS email_flag FROM customer""")
def _(spark, sf):
    cust = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    signed = read_table(spark, sf, "events").where("event_type = 'signup' AND value > 100").select(F.col("user_id").alias("customer_id"))
    return jn.presence_flag(cust, signed, "customer_id", "email_flag")


@query("jn23_orphan_check", """
SELECT count(*) AS orphans, count(DISTINCT l_partkey) AS orphan_keys FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""")
def _(spark, sf):
    dim = retail.products(spark, sf).where("pack_size <= 40").select("plu")
    return jn.orphans(retail.raw_lines(spark, sf).select("plu"), dim, "plu")
