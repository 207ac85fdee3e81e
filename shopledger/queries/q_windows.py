"""Registered queries for windows, sorts, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger import functions as fn
from shopledger.functions import jdn, money, pct, safe_div, yyyymm
from shopledger.operators import ranking as rk
from shopledger.operators import reshape as rs
from shopledger.operators import windows as wn
from shopledger.operators.ordered import exact_ntile
from shopledger.queries.common import EV, L, LT, MONTHS, div, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_joins import DAYS, purchase_days
from shopledger.queries.registry import query
from shopledger.sources import retail
from shopledger.sources.tables import read_table

ONE = "*"


def store_days(spark, sf):
    """Store-day sales from the sales lines."""
    return retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "sale_date").agg(F.sum("quantity").alias("units"))


# a dense store x day series of units, zeros kept
DENSE = f"""{L}, a AS (SELECT store_id, sale_date, sum(quantity) AS units FROM sales_lines GROUP BY 1, 2),
s AS (SELECT store_id, CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS d FROM a GROUP BY 1),
dense AS (SELECT s.store_id, s.d, CAST(coalesce(a.units, 0) AS DOUBLE) AS u FROM s LEFT JOIN a ON a.store_id = s.store_id AND a.sale_date = s.d),
w AS (SELECT *, date_diff('day', DATE '1995-01-01', d) AS t FROM dense)"""


def dense_days(spark, sf):
    from shopledger.plans.demand import daily_spine

    sp = daily_spine(store_days(spark, sf), "store_id", "sale_date", ["units"])
    return sp.select(
        "store_id", F.datediff("sale_date", F.lit("1995-01-01").cast("date")).alias("t"), F.col("units").cast("double").alias("u")
    )


@query("win01_purchase_gap", f"""{L}, {DAYS}
SELECT customer_id, jdn, jdn - lag(jdn) OVER (PARTITION BY customer_id ORDER BY jdn) AS gap FROM days""")
def _(spark, sf):
    return wn.gap(purchase_days(spark, sf), ["customer_id"], "jdn").select("customer_id", "jdn", "gap")


@query("win02_percent_change", f"""{L}, g AS (SELECT sub_category, yyyymm, sum(sales) AS sales, sum(cost) AS cost FROM sales_lines GROUP BY 1, 2)
SELECT sub_category, yyyymm, {spct('sales - lag(sales) OVER w', 'lag(sales) OVER w')} AS sales_change_pct,
       {spct('cost - lag(cost) OVER w', 'lag(cost) OVER w')} AS cost_change_pct FROM g WINDOW w AS (PARTITION BY sub_category ORDER BY yyyymm)""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("sub_category", "yyyymm").agg(F.sum("sales").alias("sales"), F.sum("cost").alias("cost"))
    return wn.pct_change(g, ["sub_category"], "yyyymm", ["sales", "cost"]).drop("sales", "cost")


@query("win03_nth_purchase", f"""{L}, {DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY jdn) AS a,
row_number() OVER (PARTITION BY customer_id ORDER BY jdn DESC) AS b FROM days)
SELECT customer_id, jdn, 'second' AS which FROM r WHERE a = 2 UNION ALL SELECT customer_id, jdn, 'last' FROM r WHERE b = 1""")
def _(spark, sf):
    d = purchase_days(spark, sf).select("customer_id", "jdn")
    second = wn.nth(d, ["customer_id"], "jdn", 2).withColumn("which", F.lit("second"))
    return second.unionByName(wn.nth(d, ["customer_id"], "jdn", 1, True).withColumn("which", F.lit("last")))


@query("win04_ranked_groups", f"""{L}, g AS (SELECT province, category, sum(sales) AS s FROM sales_lines GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY province ORDER BY s DESC, category) AS rank FROM g)
SELECT province, category, {m('s')} AS sales, rank FROM r WHERE rank <= 2""")
def _(spark, sf):
    out = wn.rank_groups(retail.sales_lines(spark, sf), ["category"], ["province"], F.sum("sales"), 2)
    return out.select("province", "category", money(F.col("measure")).alias("sales"), F.col("rank").cast("bigint").alias("rank"))


@query("win05_global_ntile", f"""{L}, g AS (SELECT customer_id, sum(sales) AS s FROM sales_lines GROUP BY 1)
SELECT customer_id, ntile(5) OVER (ORDER BY s, customer_id) AS quintile, ntile(20) OVER (ORDER BY s, customer_id) AS m20 FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, product=False, store=False).groupBy("customer_id").agg(F.sum("sales").alias("s"))
    return exact_ntile(g, ["s", "customer_id"], {"quintile": 5, "m20": 20}).drop("s")


@query("win06_month_sequence", f"WITH {MONTHS} SELECT yyyymm, month_seq, CAST(month_end AS VARCHAR) AS month_end FROM months")
def _(spark, sf):
    return retail.months(spark, sf).select("yyyymm", F.col("month_seq").cast("bigint").alias("month_seq"), F.col("month_end").cast("string").alias("month_end"))


@query("win07_over_class", f"""WITH t AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer)
SELECT c_custkey, c_mktsegment, count(*) OVER p AS class_rows, {m('sum(bal) OVER p')} AS class_total,
       {spct('sum(bal) OVER p', 'sum(bal) OVER ()')} AS class_share_pct FROM t WINDOW p AS (PARTITION BY c_mktsegment)""")
def _(spark, sf):
    t = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))
    return wn.over_class(t, "c_mktsegment", "bal").withColumn("class_total", money(F.col("class_total"))).drop("bal")


@query("win08_window_over_aggregate", f"""{L}
SELECT category, {spct('sum(quantity)', 'sum(sum(quantity)) OVER ()', 4)} AS share_pct FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    from shopledger.operators.aggregates import share_of_total

    g = retail.sales_lines(spark, sf, store=False).groupBy("category").agg(F.sum("quantity").alias("q"))
    return share_of_total(g, "q", scale=4).drop("q")


@query("win09_running_total", f"""{L}, g AS (SELECT store_id, yyyymm, sum(sales) AS s FROM sales_lines GROUP BY 1, 2)
SELECT store_id, yyyymm, {m('sum(s) OVER (PARTITION BY store_id ORDER BY yyyymm)')} AS to_date FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("s"))
    return wn.running_sum(g, ["store_id"], "yyyymm", "s", "to_date").select("store_id", "yyyymm", money(F.col("to_date")).alias("to_date"))


@query("win10_running_max", f"""{L}, {DAYS}
SELECT customer_id, jdn, max(baskets) OVER (PARTITION BY customer_id ORDER BY jdn) AS max_baskets FROM days""")
def _(spark, sf):
    return wn.running_max(purchase_days(spark, sf), ["customer_id"], "jdn", "baskets", "max_baskets").select("customer_id", "jdn", "max_baskets")


@query("win11_lags", f"""{DENSE} SELECT store_id, t, lag(u, 14) OVER p AS lag_14, lag(u, 28) OVER p AS lag_28, lag(u, 364) OVER p AS lag_364 FROM w WINDOW p AS (PARTITION BY store_id ORDER BY t)""")
def _(spark, sf):
    return wn.lags(dense_days(spark, sf), ["store_id"], "t", "u", [14, 28, 364]).drop("u")


@query("win12_rolling_mean", f"""{DENSE} SELECT store_id, t, round(CASE WHEN count(u) OVER p >= 7 THEN avg(u) OVER p END, 6) AS roll28 FROM w WINDOW p AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 41 PRECEDING AND 14 PRECEDING)""")
def _(spark, sf):
    out = wn.roll_mean(dense_days(spark, sf), ["store_id"], "t", "u", 28, 14, "roll28")
    return out.select("store_id", "t", F.round("roll28", 6).alias("roll28"))


@query("win13_rolling_deviation", f"""{DENSE} SELECT store_id, t, round(CASE WHEN count(u) OVER p >= 7 THEN stddev_samp(u) OVER p END, 6) AS rollstd28 FROM w WINDOW p AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 41 PRECEDING AND 14 PRECEDING)""")
def _(spark, sf):
    out = wn.roll_std(dense_days(spark, sf), ["store_id"], "t", "u", 28, 14, "rollstd28")
    return out.select("store_id", "t", F.round("rollstd28", 6).alias("rollstd28"))


@query("win14_same_weekday_and_momentum", f"""{DENSE}, z AS (SELECT store_id, t, lag(u, 14) OVER p AS a, lag(u, 21) OVER p AS b, lag(u, 28) OVER p AS c, lag(u, 35) OVER p AS d,
CASE WHEN count(u) OVER r7 >= 2 THEN avg(u) OVER r7 END AS m7, CASE WHEN count(u) OVER r28 >= 7 THEN avg(u) OVER r28 END AS m28 FROM w
WINDOW p AS (PARTITION BY store_id ORDER BY t), r7 AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND 14 PRECEDING), r28 AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 41 PRECEDING AND 14 PRECEDING))
SELECT store_id, t, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT, 0), 6) AS samedow_mean4,
       round(m7 / nullif(m28, 0), 6) AS trend_ratio FROM z""")
def _(spark, sf):
    k = ["store_id"]
    out = wn.same_weekday(dense_days(spark, sf), k, "t", "u")
    out = wn.roll_mean(wn.roll_mean(out, k, "t", "u", 7, 14, "m7"), k, "t", "u", 28, 14, "m28")
    return out.select("store_id", "t", F.round("samedow_mean4", 6).alias("samedow_mean4"), safe_div(F.col("m7"), F.col("m28"), 6).alias("trend_ratio"))


@query("win15_zero_rate", f"""{DENSE} SELECT store_id, t, round(CASE WHEN count(u) OVER p >= 3 THEN avg(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER p END, 6) AS zero_rate13 FROM w WINDOW p AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND 2 PRECEDING)""")
def _(spark, sf):
    out = wn.zero_rate(dense_days(spark, sf), ["store_id"], "t", "u", 13, 2, "zero_rate13")
    return out.select("store_id", "t", F.round("zero_rate13", 6).alias("zero_rate13"))


@query("win16_group_demeaned", f"""{L}, g AS (SELECT store_id, yyyymm, CAST(sum(quantity) AS DOUBLE) AS u FROM sales_lines GROUP BY 1, 2)
SELECT store_id, yyyymm, round(u - avg(u) OVER (PARTITION BY yyyymm), 6) AS u FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("quantity").cast("double").alias("u"))
    return wn.demean(g, "yyyymm", ["u"]).select("store_id", "yyyymm", F.round("u", 6).alias("u"))


@query("win17_rank_in_region", f"""{L}, g AS (SELECT region, store_id, sum(sales) AS s FROM sales_lines GROUP BY 1, 2)
SELECT region, store_id, rank() OVER (PARTITION BY region ORDER BY s DESC) AS rank, count(*) OVER (PARTITION BY region) AS "of" FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, product=False).groupBy("region", "store_id").agg(F.sum("sales").alias("s"))
    return wn.rank_in(g, ["region"], "s").drop("s").withColumn("rank", F.col("rank").cast("bigint"))


@query("win18_decile_table", f"""{L}, g AS (SELECT customer_id, sum(sales) AS s, sum(sales) - sum(cost) AS margin FROM sales_lines GROUP BY 1),
d AS (SELECT *, ntile(10) OVER (ORDER BY s, customer_id) AS decile FROM g)
SELECT decile, count(*) AS customers, {m('sum(s)')} AS sales, {spct('sum(margin)', '(SELECT sum(margin) FROM g)')} AS share_of_margin FROM d GROUP BY 1""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("customer_id").agg(F.sum("sales").alias("s"), (F.sum("sales") - F.sum("cost")).alias("margin"))
    total = g.agg(F.sum("margin").alias("t")).scalar()
    d = wn.decile(g, "s", "customer_id")
    return d.groupBy("decile").agg(F.count(ONE).alias("customers"), money(F.sum("s")).alias("sales"), F.sum("margin").alias("mg")).select(
        "decile", "customers", "sales", pct(F.col("mg"), total).alias("share_of_margin")
    )


@query("win19_consecutive_difference", f"""{L}, g AS (SELECT customer_id, (yyyymm // 100) * 12 + yyyymm % 100 AS seq, sum(quantity) AS u FROM sales_lines GROUP BY 1, 2),
d AS (SELECT customer_id, seq, u - lag(u) OVER p AS d_u, seq - lag(seq) OVER p AS gap FROM g WINDOW p AS (PARTITION BY customer_id ORDER BY seq))
SELECT customer_id, seq, {n('d_u')} AS d_u FROM d WHERE gap = 1""")
def _(spark, sf):
    seq = F.year("sale_date") * 12 + F.month("sale_date")
    g = retail.sales_lines(spark, sf, product=False, store=False).groupBy("customer_id", seq.alias("seq")).agg(F.sum("quantity").alias("u"))
    return wn.consecutive_diff(g, ["customer_id"], "seq", ["u"]).drop("u")


@query("win20_last_known", f"""{L}, g AS (SELECT store_id, yyyymm, sum(quantity) AS u, count(DISTINCT txn_id) AS tx FROM sales_lines GROUP BY 1, 2)
SELECT store_id, {n('arg_max(u, yyyymm)')} AS u, arg_max(tx, yyyymm) AS tx FROM g GROUP BY 1""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("quantity").alias("u"), F.countDistinct("txn_id").alias("tx"))
    return wn.last_known(g, "store_id", "yyyymm", ["u", "tx"])


def product_sales(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("plu").agg(F.sum("sales").alias("s"), F.sum("quantity").alias("units"))
    return g.select("plu", money(F.col("s")).alias("sales"), "units")


PS = f"{L}, ps AS (SELECT plu, {m('sum(sales)')} AS sales, {n('sum(quantity)')} AS units FROM sales_lines GROUP BY 1)"


@query("srt01_top_products", f"{PS} SELECT * FROM ps ORDER BY sales DESC, plu LIMIT 20")
def _(spark, sf):
    return rk.top_n(product_sales(spark, sf), "sales", 20, "plu")


@query("srt02_bottom_products", f"{PS} SELECT * FROM ps ORDER BY sales, plu LIMIT 10")
def _(spark, sf):
    return rk.bottom_n(product_sales(spark, sf), "sales", 10, "plu")


@query("srt03_business_order", """
SELECT o_orderpriority AS priority, count(*) AS orders, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS sort_key FROM orders GROUP BY 1 ORDER BY 3, 1""")
def _(spark, sf):
    g = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(ONE).alias("orders"))
    return rk.order_by_map(g, "priority", ["5-LOW", "3-MEDIUM", "2-HIGH"])


@query("srt04_nulls_last", """
SELECT c_custkey, x.last_event FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS last_event FROM events GROUP BY 1) x ON user_id = c_custkey
ORDER BY last_event DESC NULLS LAST, c_custkey""")
def _(spark, sf):
    last = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("last_event"))
    return rk.sort_nulls_last(read_table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left"), "last_event", "c_custkey")


@query("srt05_top_k_per_key", f"""{L}, g AS (SELECT category, plu, CAST(round(sum(sales) - sum(cost) * 2, 2) AS DOUBLE) AS score FROM sales_lines GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, plu) AS rank FROM g WHERE score > 0) SELECT * FROM r WHERE rank <= 5""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("category", "plu").agg(money(F.sum("sales") - F.sum("cost") * 2).alias("score"))
    return rk.topk_per_key(g, "category", "score", 5, "plu").withColumn("rank", F.col("rank").cast("bigint"))


@query("srt06_top_k_with_scope", f"{PS} SELECT *, (SELECT count(*) FROM ps) AS scope_n FROM ps ORDER BY sales DESC, plu LIMIT 50")
def _(spark, sf):
    return rk.topk_with_total(product_sales(spark, sf), "sales", 50, "plu")


@query("set01_union_all_years", f"""{L} SELECT year(sale_date) AS yr, category, {m('sum(sales)')} AS sales FROM sales_lines GROUP BY 1, 2""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, store=False).withColumn("yr", F.year("sale_date"))
    return rs.union_all([df.where("yyyymm <= 199803"), df.where("yyyymm > 199803")]).groupBy("yr", "category").agg(money(F.sum("sales")).alias("sales"))


@query("set02_distinct", """
SELECT DISTINCT l_orderkey AS basket, l_partkey AS plu FROM lineitem""")
def _(spark, sf):
    return retail.raw_lines(spark, sf).select(F.col("txn_id").alias("basket"), "plu").distinct()


@query("set03_intersection", f"""{L}
SELECT store_id, sub_category FROM sales_lines WHERE yyyymm <= 199803 INTERSECT SELECT store_id, sub_category FROM sales_lines WHERE yyyymm > 199803""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, store=False)
    cols = ["store_id", "sub_category"]
    return rs.intersect(df.where("yyyymm <= 199803").select(*cols), df.where("yyyymm > 199803").select(*cols))


@query("set04_unpivot", f"""{L}, d AS (SELECT store_id, yyyymm, CAST(round(sum(CASE WHEN promo_type = 'T' THEN sales ELSE 0 END), 2) AS DOUBLE) AS t,
CAST(round(sum(CASE WHEN promo_type = 'M' THEN sales ELSE 0 END), 2) AS DOUBLE) AS m, CAST(round(sum(CASE WHEN promo_type = 'O' THEN sales ELSE 0 END), 2) AS DOUBLE) AS o FROM sales_lines GROUP BY 1, 2)
SELECT store_id, yyyymm, 't' AS kind, t AS amount FROM d UNION ALL SELECT store_id, yyyymm, 'm', m FROM d UNION ALL SELECT store_id, yyyymm, 'o', o FROM d""")
def _(spark, sf):
    zero = F.lit(0)
    wide = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(
        *[money(F.sum(F.when(F.col("promo_type") == k.upper(), F.col("sales")).otherwise(zero))).alias(k) for k in ("t", "m", "o")]
    )
    return rs.unpivot(wide, ["store_id", "yyyymm"], ["t", "m", "o"], "kind", "amount")


@query("set05_statement_lines", f"""{L}, g AS (SELECT store_id, yyyymm, sum(sales) AS s, sum(cost) AS c FROM sales_lines GROUP BY 1, 2), j AS (SELECT g.*, b.s AS bs, b.c AS bc FROM g JOIN g b ON b.store_id = g.store_id AND b.yyyymm = g.yyyymm - 100)
SELECT store_id, yyyymm, 1 AS line_order, 'Net sales' AS line_label, CAST(s AS DOUBLE) AS actual_amt, CAST(bs AS DOUBLE) AS budget_amt, 0 AS is_total FROM j
UNION ALL SELECT store_id, yyyymm, 2, 'Cost of goods sold', -CAST(c AS DOUBLE), -CAST(bc AS DOUBLE), 0 FROM j
UNION ALL SELECT store_id, yyyymm, 3, 'Gross margin', CAST(s - c AS DOUBLE), CAST(bs - bc AS DOUBLE), 1 FROM j""")
def _(spark, sf):
    """Every store and month against the month a year before."""
    g = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("s"), F.sum("cost").alias("c"))
    b = g.select("store_id", (F.col("yyyymm") + 100).alias("yyyymm"), F.col("s").alias("bs"), F.col("c").alias("bc"))
    s, c, bs, bc = (F.col(x) for x in ("s", "c", "bs", "bc"))
    spec = [("Net sales", s, bs, 0), ("Cost of goods sold", -c, -bc, 0), ("Gross margin", s - c, bs - bc, 1)]
    return rs.statement_lines(g.join(b, ["store_id", "yyyymm"]), ["store_id", "yyyymm"], spec)


@query("set06_account_long", f"""{L}, g AS (SELECT store_id, yyyymm, sum(sales) AS s, sum(cost) AS c FROM sales_lines GROUP BY 1, 2)
SELECT store_id, yyyymm, '4000' AS account_code, 'Net Sales' AS account_name, 'Revenue' AS account_group, CAST(s AS DOUBLE) AS amount FROM g
UNION ALL SELECT store_id, yyyymm, '5000', 'Cost of Goods Sold', 'COGS', -CAST(c AS DOUBLE) FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("s"), F.sum("cost").alias("c"))
    return rs.to_ledger(g, ["store_id", "yyyymm"], [
        ("4000", "Net Sales", "Revenue", {"amount": F.col("s")}), ("5000", "Cost of Goods Sold", "COGS", {"amount": -F.col("c")}),
    ])


@query("set07_funnel_rows", """
WITH e AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS s, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events)
SELECT 'Clicked' AS stage, 1 AS stage_order, round(100.0::DOUBLE * c / s, 2) AS pct_of_base FROM e UNION ALL SELECT 'Bought', 2, round(100.0::DOUBLE * p / s, 2) FROM e""")
def _(spark, sf):
    g = read_table(spark, sf, "events").groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click", "purchase")]
    )
    return rs.funnel_rows(g, "view", [("Clicked", "click"), ("Bought", "purchase")])


@query("set08_waterfall", f"""{L}, g AS (SELECT sum(sales) AS s, sum(cost) AS c, sum(discount) AS d FROM sales_lines)
SELECT 1 AS step_order, 'Net sales' AS step_label, 0.0::DOUBLE AS base_amt, {m('s')} AS bar_amt, 'total' AS bar_kind FROM g
UNION ALL SELECT 2, 'COGS', {m('s - c')}, {m('c')}, 'down' FROM g UNION ALL SELECT 3, 'Subsidy', {m('s - c')}, {m('d')}, 'up' FROM g
UNION ALL SELECT 4, 'Contribution', 0.0::DOUBLE, {m('s - c + d')}, 'total' FROM g""")
def _(spark, sf):
    one = retail.sales_lines(spark, sf, store=False).agg(
        F.sum("sales").alias("s"), F.sum("cost").alias("c"), F.sum("discount").alias("d")
    )
    steps = [("COGS", "down", F.col("c")), ("Subsidy", "up", F.col("d"))]
    return rs.waterfall(one, ("Net sales", F.col("s")), steps, "Contribution")


DAY = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t"


def order_days(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


@query("fn01_text_date", f"SELECT strftime(d, '%d-%b-%Y') AS text_day, CASE WHEN day(d) = 1 THEN NULL ELSE CAST(d AS VARCHAR) END AS parsed FROM {DAY}")
def _(spark, sf):
    d = order_days(spark, sf).withColumn("text_day", F.date_format("d", "dd-MMM-yyyy"))
    dirty = F.when(F.dayofmonth("d") == 1, "n/a").otherwise(F.concat(F.col("text_day"), F.lit(" ")))
    return d.select("text_day", fn.text_date(dirty).cast("string").alias("parsed"))


@query("fn02_date_parts", "SELECT event_id, year(ts) AS yr, month(ts) AS mo, day(ts) AS dy, quarter(ts) AS qtr, dayofyear(ts) AS doy, hour(ts) AS hr FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return read_table(spark, sf, "events").select(
        "event_id", F.year(ts).alias("yr"), F.month(ts).alias("mo"), F.dayofmonth(ts).alias("dy"), F.quarter(ts).alias("qtr"), F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hr")
    )


@query("fn03_julian_day", f"SELECT CAST(d AS VARCHAR) AS d, CAST(julian(d) AS BIGINT) AS jdn, CAST(d AS VARCHAR) AS back FROM {DAY}")
def _(spark, sf):
    j = jdn(F.col("d"))
    return order_days(spark, sf).select(F.col("d").cast("string").alias("d"), j.alias("jdn"), fn.jdn_to_date(j).cast("string").alias("back"))


@query("fn04_weekday", f"SELECT CAST(d AS VARCHAR) AS d, isodow(d) - 1 AS dow0, isodow(d) AS dow1, dayname(d) AS day_name, CASE WHEN isodow(d) >= 6 THEN 'Y' ELSE 'N' END AS is_weekend FROM {DAY}")
def _(spark, sf):
    d = F.col("d")
    return order_days(spark, sf).select(
        d.cast("string").alias("d"), fn.dow0(d).alias("dow0"), fn.dow1(d).alias("dow1"), fn.day_name(d).alias("day_name"), fn.is_weekend(d).alias("is_weekend")
    )


@query("fn05_yyyymm", f"SELECT CAST(d AS VARCHAR) AS d, year(d) * 100 + month(d) AS ym, year(d) AS yr, month(d) AS mo FROM {DAY}")
def _(spark, sf):
    ym = yyyymm(F.col("d"))
    return order_days(spark, sf).select(F.col("d").cast("string").alias("d"), ym.alias("ym"), fn.ym_year(ym).alias("yr"), fn.ym_month(ym).alias("mo"))


@query("fn06_date_arithmetic", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 30 ELSE 45 END AS INTEGER) AS VARCHAR) AS due,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age_days FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate").cast("date")
    terms = F.when(F.col("o_orderpriority") == "1-URGENT", 30).otherwise(45)
    return read_table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(d, terms).cast("string").alias("due"), F.datediff(F.lit("2001-08-01").cast("date"), d).alias("age_days")
    )


@query("fn07_week_numbers", f"SELECT CAST(d AS VARCHAR) AS d, date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), d) // 7 AS week_seq, (dayofyear(d) - 1) // 7 + 1 AS week_of_year FROM {DAY}")
def _(spark, sf):
    first, _last = retail.span(spark, sf)
    d = F.col("d")
    return order_days(spark, sf).select(d.cast("string").alias("d"), fn.week_seq(jdn(d), jdn(first)).alias("week_seq"), fn.week_of_year(d).alias("week_of_year"))


@query("fn08_quarter_label", "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter_label, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, sf):
    return read_table(spark, sf, "orders").groupBy(fn.quarter_label(F.col("o_orderdate")).alias("quarter_label")).agg(F.count(ONE).alias("orders"))


@query("fn09_season_and_period", """
SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
       CASE WHEN o_orderdate >= TIMESTAMP '1998-03-01' THEN 'After' ELSE 'Before' END AS period, count(*) AS orders FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return read_table(spark, sf, "orders").groupBy(
        fn.season(F.month(d)).alias("season"), fn.period(d, retail.PERIOD_CUT, *retail.PERIODS).alias("period")
    ).agg(F.count(ONE).alias("orders"))


@query("fn10_month_label", "SELECT strftime(o_orderdate, '%m %b') AS month_label, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, sf):
    return read_table(spark, sf, "orders").groupBy(fn.month_label(F.col("o_orderdate")).alias("month_label")).agg(F.count(ONE).alias("orders"))


@query("fn11_string_functions", """
SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, left(p_name, 3) AS head, right(p_name, 3) AS tail, substr(p_name, 2, 1) AS second, upper(p_type) AS up, lower(p_type) AS low,
       p_brand || '/' || p_type AS joined, length(p_name) AS len FROM part""")
def _(spark, sf):
    nm = F.col("p_name")
    return read_table(spark, sf, "part").select(
        "p_partkey", F.trim(F.concat(F.lit("  "), nm, F.lit(" "))).alias("trimmed"), F.left(nm, F.lit(3)).alias("head"), F.right(nm, F.lit(3)).alias("tail"),
        F.substring(nm, 2, 1).alias("second"), F.upper("p_type").alias("up"), F.lower("p_type").alias("low"), F.concat_ws("/", "p_brand", "p_type").alias("joined"), F.length(nm).alias("len"),
    )


@query("fn12_text_before_mark", "SELECT p_partkey, split_part(p_brand, '#', 1) AS head, trim(split_part(p_name, ' ', 1)) AS first_word, p_type AS whole FROM part")
def _(spark, sf):
    return read_table(spark, sf, "part").select(
        "p_partkey", fn.before(F.col("p_brand"), "#").alias("head"), fn.before(F.col("p_name"), " ").alias("first_word"), fn.before(F.col("p_type"), "-").alias("whole")
    )


@query("fn13_regex_replace", r"""SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\x0B\f]+', ' ', 'g'), ' ') AS squeezed, regexp_replace(source, '^.*\.', '') AS tail FROM documents""")
def _(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", fn.squeeze(F.col("text")).alias("squeezed"), fn.class_tail(F.col("source")).alias("tail"))


@query("fn14_clamp", "SELECT p_partkey, least(40, greatest(10, p_size)) AS clamped, greatest(p_size, CASE WHEN p_size > 25 THEN 30 END) AS skip_null FROM part")
def _(spark, sf):
    s = F.col("p_size")
    return read_table(spark, sf, "part").select("p_partkey", fn.clamp(s, 10, 40).alias("clamped"), F.greatest(s, F.when(s > 25, 30)).alias("skip_null"))


@query("fn15_math", "SELECT p_partkey, abs(p_size - 25) AS dist, p_size % 7 AS md, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS logn, sign(p_size - 25) AS sgn FROM part")
def _(spark, sf):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return read_table(spark, sf, "part").select(
        "p_partkey", F.abs(s - 25).alias("dist"), F.pmod(s, F.lit(7)).alias("md"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.log(p), 6).alias("logn"), F.signum(s - 25).cast("int").alias("sgn")
    )


@query("fn16_casts", """SELECT l_orderkey, l_partkey, l_suppkey, CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS DOUBLE) AS fixed, CAST(trunc(l_extendedprice) AS BIGINT) AS cut,
CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)), 0) AS BIGINT) AS half_up, CAST(l_orderkey AS VARCHAR) AS txt FROM lineitem""")
def _(spark, sf):
    p = F.col("l_extendedprice")
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", (p.cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(10,2)").cast("double").alias("fixed"),
        p.cast("bigint").alias("cut"), fn.half_up(p.cast("decimal(12,2)")).alias("half_up"), F.col("l_orderkey").cast("string").alias("txt"),
    )


@query("fn17_ceil_to_multiple", "SELECT p_partkey, CAST(ceil(p_size / 12.0) * 12 AS BIGINT) AS cases, CAST(ceil(p_size / 10.0) * 10 AS BIGINT) AS tens FROM part")
def _(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.ceil_to(F.col("p_size"), 12).alias("cases"), fn.ceil_to(F.col("p_size"), 10).alias("tens"))


@query("fn18_fallback_chain", """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT c_custkey, coalesce(a.n, CASE WHEN c_mktsegment = 'MACHINERY' THEN 50 END, 0) AS own FROM customer LEFT JOIN a ON user_id = c_custkey""")
def _(spark, sf):
    a = read_table(spark, sf, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(ONE).alias("n"))
    out = read_table(spark, sf, "customer").join(a, "c_custkey", "left")
    return out.select("c_custkey", fn.fallback(F.col("n"), F.when(F.col("c_mktsegment") == "MACHINERY", 50), F.lit(0)).alias("own"))


@query("fn19_truthy_text", "SELECT l_returnflag = 'R' AS flag, count(*) AS line_items FROM lineitem GROUP BY 1")
def _(spark, sf):
    raw = F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "A", "N")
    return read_table(spark, sf, "lineitem").groupBy(fn.truthy(raw).alias("flag")).agg(F.count(ONE).alias("line_items"))


@query("fn20_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def _(spark, sf):
    p = F.col("props")
    return read_table(spark, sf, "events").select("event_id", fn.json_get(p, "$.k").cast("bigint").alias("k"), fn.json_get(p, "$.none").alias("missing"))


@query("fn21_first_of_ordered_array", "SELECT event_type, arg_min(user_id, (ts, event_id)) AS first_user, arg_max(user_id, (ts, event_id)) AS last_user FROM events GROUP BY 1")
def _(spark, sf):
    when = F.struct("ts", "event_id")
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.min_by("user_id", when).alias("first_user"), F.max_by("user_id", when).alias("last_user"))


@query("fn22_hash_buckets", """SELECT CAST('0x' || substr(md5(c_custkey::VARCHAR || 'sc'), 1, 8) AS UBIGINT) % 20 AS bucket, count(*) AS customers FROM customer GROUP BY 1""")
def _(spark, sf):
    return read_table(spark, sf, "customer").groupBy(fn.md5_bucket(F.col("c_custkey"), "sc", 20).alias("bucket")).agg(F.count(ONE).alias("customers"))
