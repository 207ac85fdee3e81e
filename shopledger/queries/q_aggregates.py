"""Registered queries for aggregations (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import money, pct, safe_div
from shopledger.operators import aggregates as ag
from shopledger.operators.filters import band
from shopledger.operators.ordered import exact_quantiles
from shopledger.queries.common import EV, L, LT, div, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.registry import query
from shopledger.sources import retail
from shopledger.sources.tables import read_table

ONE = "*"


@query("agg01_group_aggregate", f"""{L}
SELECT province, {m('sum(sales)')} AS sales, count(*) AS line_items, min(quantity) AS min_qty, max(quantity) AS max_qty,
       {div('sum(quantity)', 'count(*)', 6)} AS avg_qty FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    return retail.sales_lines(spark, sf, product=False).groupBy("province").agg(
        money(F.sum("sales")).alias("sales"), F.count(ONE).alias("line_items"), F.min("quantity").alias("min_qty"),
        F.max("quantity").alias("max_qty"), safe_div(F.sum("quantity"), F.count(ONE), 6).alias("avg_qty"),
    )


@query("agg02_exact_distinct", f"""{L}
SELECT region, count(DISTINCT txn_id) AS tx, count(DISTINCT store_id) AS stores, count(DISTINCT customer_id) AS customers FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    # one row per transaction first, so that two of the three counts are small
    heads = retail.headers(spark, sf).where(F.col("txn_type") == retail.SALE).join(retail.raw_lines(spark, sf), "txn_id", "left_semi")
    per = heads.join(retail.stores(spark, sf).select("store_id", "region"), "store_id").groupBy("region", "customer_id", "store_id").agg(F.count(ONE).alias("tx"))
    return per.groupBy("region").agg(F.sum("tx").alias("tx"), F.countDistinct("store_id").alias("stores"), F.countDistinct("customer_id").alias("customers"))


@query("agg03_conditional_sums", f"""{L}
SELECT store_id, {m("sum(CASE WHEN txn_type = 'Regular Sale' THEN sales ELSE 0 END)")} AS net_sales,
       {m("sum(CASE WHEN txn_type = 'Regular Return' THEN sales ELSE 0 END)")} AS returns_value,
       count(*) FILTER (WHERE promo_type <> '') AS promo_lines FROM lines GROUP BY 1""")
def _(spark, sf):
    return retail.lines(spark, sf, product=False, store=False).groupBy("store_id").agg(
        money(ag.sum_if(F.col("txn_type") == retail.SALE, F.col("sales"))).alias("net_sales"),
        money(ag.sum_if(F.col("txn_type") == retail.RETURN, F.col("sales"))).alias("returns_value"),
        ag.count_if(F.col("promo_type") != "").alias("promo_lines"),
    )


@query("agg04_conditional_distinct", f"""{L}
SELECT region, count(DISTINCT CASE WHEN txn_type = 'Post Void TX' THEN txn_id END) AS voids,
       count(DISTINCT CASE WHEN txn_type = 'Regular Return' THEN txn_id END) AS returns FROM lines GROUP BY 1""")
def _(spark, sf):
    heads = retail.headers(spark, sf).join(retail.raw_lines(spark, sf), "txn_id", "left_semi").join(retail.stores(spark, sf), "store_id")
    return heads.groupBy("region").agg(
        ag.distinct_if(F.col("txn_type") == retail.VOID, F.col("txn_id")).alias("voids"),
        ag.distinct_if(F.col("txn_type") == retail.RETURN, F.col("txn_id")).alias("returns"),
    )


@query("agg05_filter_clause", """
SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS sales, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1""")
def _(spark, sf):
    read_table(spark, sf, "orders").createOrReplaceTempView("orders_filter_view")
    return spark.sql(
        "SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS sales, "
        "count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders_filter_view GROUP BY 1"
    )


@query("agg06_global_kpi", f"""{LT}
SELECT {m('sum(basket_value)')} AS sales, count(*) AS tx, {n('sum(basket_items)')} AS items, {div('sum(basket_value)', 'count(*)')} AS avg_basket,
       {spct('sum(basket_margin)', 'sum(basket_value)')} AS margin_pct FROM txn WHERE txn_type = 'Regular Sale'""")
def _(spark, sf):
    t = retail.transactions(spark, sf).where(F.col("txn_type") == retail.SALE)
    return t.agg(
        money(F.sum("basket_value")).alias("sales"), F.count(ONE).alias("tx"), F.sum("basket_items").alias("items"),
        safe_div(F.sum("basket_value"), F.count(ONE), 2).alias("avg_basket"), pct(F.sum("basket_margin"), F.sum("basket_value")).alias("margin_pct"),
    )


@query("agg07_ratio_of_sums", f"""{L}
SELECT category, {spct('sum(sales) - sum(cost)', 'sum(sales)', 4)} AS margin_pct FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    return retail.sales_lines(spark, sf, store=False).groupBy("category").agg(
        ag.ratio_of_sums(F.col("sales") - F.col("cost"), F.col("sales"), 4, 100.0).alias("margin_pct")
    )


@query("agg08_weighted_average", f"""{L},
c AS (SELECT store_id, category, count(*) AS w, round(CAST(sum(quantity) AS DOUBLE) / count(*), 2)::DECIMAL(10,2) AS x FROM sales_lines GROUP BY 1, 2)
SELECT category, {div('sum(x * w)', 'sum(w)', 4)} AS avg_qty FROM c GROUP BY 1""")
def _(spark, sf):
    cells = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "category").agg(
        F.count(ONE).alias("w"), F.round(F.sum("quantity").cast("double") / F.count(ONE), 2).cast("decimal(10,2)").alias("x")
    )
    return cells.groupBy("category").agg(ag.wavg(F.col("x"), F.col("w"), 4).alias("avg_qty"))


@query("agg09_trimmed_weighted_average", f"""{L},
s AS (SELECT sub_category, yyyymm, sum(sales) AS sales, sum(quantity) AS w FROM sales_lines GROUP BY 1, 2),
d AS (SELECT sub_category, w, round(CAST(sales AS DOUBLE) / CAST(lag(sales) OVER (PARTITION BY sub_category ORDER BY yyyymm) AS DOUBLE) * 100 - 100, 2)::DECIMAL(12,2) AS chg FROM s)
SELECT sub_category, {div('sum(CASE WHEN abs(chg) < 50 THEN chg * w END)', 'sum(CASE WHEN abs(chg) < 50 THEN w END)', 4)} AS avg_change FROM d GROUP BY 1""")
def _(spark, sf):
    from pyspark.sql import Window

    s = retail.sales_lines(spark, sf, store=False).groupBy("sub_category", "yyyymm").agg(F.sum("sales").alias("sales"), F.sum("quantity").alias("w"))
    prev = F.lag("sales").over(Window.partitionBy("sub_category").orderBy("yyyymm")).cast("double")
    d = s.withColumn("chg", F.round(F.col("sales").cast("double") / prev * 100 - 100, 2).cast("decimal(12,2)"))
    return d.groupBy("sub_category").agg(ag.wavg_trim(F.col("chg"), F.col("w"), 50, 4).alias("avg_change"))


@query("agg10_exact_median", f"""{L}
SELECT category, round(median(CAST(sales AS DOUBLE)), 4) AS median_sales FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    out = exact_quantiles(retail.sales_lines(spark, sf, store=False), "sales", {"median_sales": 0.5}, ["category"])
    return out.withColumn("median_sales", F.round("median_sales", 4))


@query("agg11_deviation_from_moments", f"""{L}
SELECT sub_category, round(stddev_pop(CAST(quantity AS DOUBLE)), 6) AS sd_qty FROM lines GROUP BY 1""")
def _(spark, sf):
    df = retail.raw_lines(spark, sf).join(retail.products(spark, sf), "plu")
    return df.groupBy("sub_category").agg(F.round(ag.sd_moments(F.col("quantity")), 6).alias("sd_qty"))


@query("agg12_exact_quantiles", """
SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY 1""")
def _(spark, sf):
    out = exact_quantiles(read_table(spark, sf, "events"), "value", {"p10": 0.1, "p90": 0.9, "p98": 0.98}, ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10", "p90", "p98")])


@query("agg13_correlation", f"""{L}
SELECT category, round(corr(CAST(quantity AS DOUBLE), CAST(sales AS DOUBLE)), 6) AS qty_sales_corr FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    return retail.sales_lines(spark, sf, store=False).groupBy("category").agg(
        F.round(F.corr(F.col("quantity").cast("double"), F.col("sales").cast("double")), 6).alias("qty_sales_corr")
    )


@query("agg14_coefficient_of_variation", f"""{L}
SELECT plu, round(stddev_samp(CAST(quantity AS DOUBLE)) / nullif(avg(CAST(quantity AS DOUBLE)), 0), 6) AS qty_cv FROM raw_lines GROUP BY 1""")
def _(spark, sf):
    return retail.raw_lines(spark, sf).groupBy("plu").agg(F.round(ag.cv(F.col("quantity").cast("double")), 6).alias("qty_cv"))


@query("agg15_mode_per_key", f"""{L},
c AS (SELECT customer_id, promo_type, count(*) AS n, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, promo_type) AS rk FROM lines GROUP BY 1, 2)
SELECT customer_id, promo_type, n FROM c WHERE rk = 1""")
def _(spark, sf):
    return ag.mode_of(retail.lines(spark, sf, product=False, store=False), ["customer_id"], "promo_type")


@query("agg16_favourite_category", f"""{L},
c AS (SELECT customer_id, category, sum(sales) AS v, row_number() OVER (PARTITION BY customer_id ORDER BY sum(sales) DESC, category) AS rk FROM sales_lines GROUP BY 1, 2)
SELECT customer_id, category AS favorite_category, {m('v')} AS category_sales FROM c WHERE rk = 1""")
def _(spark, sf):
    out = ag.argmax_of(retail.sales_lines(spark, sf, store=False), ["customer_id"], "category", F.col("sales"), "favorite_category")
    return out.select("customer_id", "favorite_category", money(F.col("measure")).alias("category_sales"))


@query("agg17_first_and_last", """
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1""")
def _(spark, sf):
    ev = read_table(spark, sf, "events")
    first = ag.first_per_key(ev, ["user_id"], ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "first_type")
    last = ag.first_per_key(ev, ["user_id"], ["ts", "event_id"], ["event_type", "event_id"], last=True)
    return first.join(last.select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_event")), "user_id")


@query("agg18_share_of_total", f"""{L}
SELECT promo_type, {m('sum(sales)')} AS sales, {spct('sum(sales)', '(SELECT sum(sales) FROM sales_lines)')} AS share_pct FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    by = retail.sales_lines(spark, sf, product=False, store=False).groupBy("promo_type").agg(F.sum("sales").alias("sales"))
    return ag.share_of_total(by, "sales").withColumn("sales", money(F.col("sales")))


@query("agg19_share_within_parent", f"""{L},
g AS (SELECT region, category, sum(sales) AS sales FROM sales_lines GROUP BY 1, 2)
SELECT region, category, {spct('sales', 'sum(sales) OVER (PARTITION BY region)')} AS share_pct FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf).groupBy("region", "category").agg(F.sum("sales").alias("sales"))
    return ag.share_within(g, ["region"], "sales").drop("sales")


@query("agg20_year_over_year", f"""{L}, g AS (
SELECT region, sum(CASE WHEN yyyymm // 100 = 1999 THEN sales END) AS a, sum(CASE WHEN yyyymm // 100 = 2000 THEN sales END) AS b FROM sales_lines GROUP BY 1)
SELECT region, {m('a')} AS prior_value, {m('b')} AS this_value, {spct('b - a', 'a')} AS growth_pct FROM g""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False)
    out = ag.yoy(df, ["region"], F.year("sale_date"), F.col("sales"), 2000, 1999)
    return out.withColumn("prior_value", money(F.col("prior_value"))).withColumn("this_value", money(F.col("this_value")))


@query("agg21_index_to_base", f"""{L}, g AS (SELECT yyyymm, sum(sales) AS sales, sum(cost) AS cost FROM sales_lines GROUP BY 1)
SELECT yyyymm, {spct('sales', '(SELECT sales FROM g WHERE yyyymm = 199501)')} AS sales_index, {spct('cost', '(SELECT cost FROM g WHERE yyyymm = 199501)')} AS cost_index FROM g""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("yyyymm").agg(F.sum("sales").alias("sales"), F.sum("cost").alias("cost"))
    return ag.index_to_base(g, "yyyymm", 199501, ["sales", "cost"])


@query("agg22_named_points", f"""{L}
SELECT {m('sum(CASE WHEN yyyymm = 199912 THEN sales END)')} AS dec99, {m('sum(CASE WHEN yyyymm = 200012 THEN sales END)')} AS dec00,
       {m('sum(CASE WHEN yyyymm = 200003 THEN sales END)')} AS mar00 FROM sales_lines""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False, store=False)
    ym = F.col("yyyymm")
    out = ag.point_values(df, [("dec99", ym == 199912), ("dec00", ym == 200012), ("mar00", ym == 200003)], F.col("sales"))
    return out.select(*[money(F.col(c)).alias(c) for c in out.columns])


@query("agg23_two_level", f"""{L},
a AS (SELECT store_id, yyyymm, sum(sales) AS sales, count(DISTINCT txn_id) AS tx FROM sales_lines GROUP BY 1, 2)
SELECT store_format, {div('sum(sales)', 'sum(tx)')} AS sales_per_txn, count(*) AS store_months FROM a JOIN stores USING (store_id) GROUP BY 1""")
def _(spark, sf):
    a = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").alias("sales"), F.countDistinct("txn_id").alias("tx"))
    a = a.join(retail.stores(spark, sf).select("store_id", "store_format"), "store_id")
    return a.groupBy("store_format").agg(safe_div(F.sum("sales"), F.sum("tx"), 2).alias("sales_per_txn"), F.count(ONE).alias("store_months"))


@query("agg24_groups_meeting_having", f"""{L}
SELECT count(*) AS loss_cells FROM (SELECT store_id, yyyymm FROM sales_lines GROUP BY 1, 2 HAVING sum(sales) - sum(cost) * 1.5 < 0)""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "yyyymm").agg((F.sum("sales") - F.sum("cost") * F.lit("1.5").cast("decimal(2,1)")).alias("v"))
    return g.where("v < 0").agg(F.count(ONE).alias("loss_cells"))


@query("agg25_subtotals", f"""{L}
SELECT coalesce(region, 'Total') AS region, coalesce(province, 'Total') AS province, {m('sum(sales)')} AS sales, count(*) AS line_items,
       CAST(grouping(region) * 2 + grouping(province) AS INTEGER) AS level FROM sales_lines GROUP BY ROLLUP (region, province)""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False)
    return ag.rollup_totals(df, ["region", "province"], {"sales": money(F.sum("sales")), "line_items": F.count(ONE)})


@query("agg26_crosstab", f"""{L}, c AS (SELECT coalesce(region, 'Total') AS region, CASE WHEN grouping(promo_type) = 1 THEN 'Total' WHEN promo_type = '' THEN 'None' ELSE promo_type END AS p,
{m('sum(sales)')} AS v FROM sales_lines GROUP BY CUBE (region, promo_type))
SELECT region, max(v) FILTER (WHERE p = 'M') AS "M", max(v) FILTER (WHERE p = 'O') AS "O", max(v) FILTER (WHERE p = 'T') AS "T",
       max(v) FILTER (WHERE p = 'None') AS "None", max(v) FILTER (WHERE p = 'Total') AS "Total" FROM c GROUP BY 1""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False)
    df = df.withColumn("promo", F.when(F.col("promo_type") == "", "None").otherwise(F.col("promo_type")))
    return ag.crosstab(df, "region", "promo", ["M", "O", "T", "None"], money(F.sum("sales")))


@query("agg27_aging_pivot", f"""{L}, a AS (SELECT supplier_id, sales, date_diff('day', ship_date, DATE '2001-08-01') AS late FROM lines WHERE ship_date <= DATE '2001-08-01')
SELECT supplier_id, {m('sum(CASE WHEN late <= 30 THEN sales ELSE 0 END)')} AS d30, {m('sum(CASE WHEN late > 30 AND late <= 60 THEN sales ELSE 0 END)')} AS d60,
       {m('sum(CASE WHEN late > 60 THEN sales ELSE 0 END)')} AS d60p, {m('sum(sales)')} AS total FROM a GROUP BY 1""")
def _(spark, sf):
    late = F.datediff(F.lit("2001-08-01").cast("date"), F.col("ship_date"))
    df = retail.raw_lines(spark, sf).where(late >= 0).withColumn(
        "bucket", F.when(late <= 30, "1-30 days").when(late <= 60, "31-60 days").otherwise("60+ days")
    )
    out = ag.aging_pivot(df, ["supplier_id"], "bucket", F.col("sales"), {"1-30 days": "d30", "31-60 days": "d60", "60+ days": "d60p"})
    return out.select("supplier_id", *[money(F.col(c)).alias(c) for c in ("d30", "d60", "d60p", "total")])


@query("agg28_histogram", f"""{L}, g AS (SELECT store_id, yyyymm, 100.0 * CAST(sum(sales) - sum(cost) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) AS x FROM sales_lines GROUP BY 1, 2)
SELECT CASE WHEN x < 20 THEN 'under 20' WHEN x < 40 THEN '20 to 40' WHEN x < 60 THEN '40 to 60' ELSE '60 up' END AS band, count(*) AS store_months FROM g GROUP BY 1""")
def _(spark, sf):
    g = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "yyyymm").agg(
        safe_div(F.sum("sales") - F.sum("cost"), F.sum("sales"), None, 100.0).alias("x")
    )
    b = band(F.col("x"), [(20, "under 20"), (40, "20 to 40"), (60, "40 to 60")], "60 up", "lt")
    return g.groupBy(b.alias("band")).agg(F.count(ONE).alias("store_months"))


@query("agg29_distinct_does_not_roll_up", f"""{L}, e AS (SELECT count(DISTINCT txn_id) AS exact FROM sales_lines)
SELECT 'promo_type' AS grain, exact, {n('(SELECT sum(c) FROM (SELECT count(DISTINCT txn_id) AS c FROM sales_lines GROUP BY promo_type))')} AS summed FROM e
UNION ALL SELECT 'category', exact, {n('(SELECT sum(c) FROM (SELECT count(DISTINCT txn_id) AS c FROM sales_lines GROUP BY category))')} FROM e
UNION ALL SELECT 'store_id', exact, {n('(SELECT sum(c) FROM (SELECT count(DISTINCT txn_id) AS c FROM sales_lines GROUP BY store_id))')} FROM e""")
def _(spark, sf):
    return ag.distinct_safe(retail.sales_lines(spark, sf, store=False), "txn_id", [["promo_type"], ["category"], ["store_id"]])


@query("agg30_code_rollup", f"""{L}, g AS (SELECT CASE region WHEN 'ASIA' THEN 'East' WHEN 'MIDDLE EAST' THEN 'East' WHEN 'EUROPE' THEN 'West' WHEN 'AMERICA' THEN 'West' ELSE 'Other' END AS code_group, sum(quantity) AS v FROM sales_lines GROUP BY 1)
SELECT code_group, {n('v')} AS value, {spct('v', '(SELECT sum(v) FROM g)')} AS share_pct FROM g""")
def _(spark, sf):
    mapping = {"ASIA": "East", "MIDDLE EAST": "East", "EUROPE": "West", "AMERICA": "West"}
    return ag.code_rollup(retail.sales_lines(spark, sf, product=False), "region", mapping, F.sum("quantity"))
