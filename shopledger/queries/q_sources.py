"""Registered queries for sources, sinks and filters (SRC, FLT)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from shopledger.functions import blank_to_null, money, norm_blank, safe_div
from shopledger.operators import filters as flt
from shopledger.queries.common import EV, L, LT, m, n, pct
from shopledger.queries.registry import query
from shopledger.session import shared_folder
from shopledger.sources import retail, tables
from shopledger.sources.tables import read_table


def scratch(spark, name: str) -> str:
    """A fresh place for a written table in the folder the cluster shares."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@query("src01_table_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def _(spark, sf):
    return (
        read_table(spark, sf, "orders")
        .where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))
        .select("o_orderkey", "o_orderstatus")
    )


@query("src02_csv_roundtrip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch(spark, "csv")
    tables.export(read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "csv")
    return tables.read_csv(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("src03_typed_from_staging", """
SELECT p_partkey AS plu, p_size AS pack_size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS product_name FROM part""")
def _(spark, sf):
    part = read_table(spark, sf, "part")
    staged = part.select(
        F.col("p_partkey").cast("string").alias("plu"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("pack_size"),
        F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("product_name"),
    )
    return tables.typed_from_staging(
        staged, {"plu": "bigint", "pack_size": "int", "price": "double", "product_name": "string"}
    )


@query("src04_rebuild", f"""{L}
SELECT province, {m('sum(sales)')} AS sales, count(*) AS line_items FROM sales_lines GROUP BY province""")
def _(spark, sf):
    by = retail.sales_lines(spark, sf, product=False).groupBy("province").agg(
        money(F.sum("sales")).alias("sales"), F.count(F.lit(1)).alias("line_items")
    )
    path = scratch(spark, "rebuild")
    tables.rebuild(by, path)
    return tables.rebuild(by, path)


@query("src05_bucketed_join", """
SELECT o_custkey AS customer_id, count(*) AS txns, max(c_mktsegment) AS segment
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    tag = uuid.uuid4().hex[:8]
    orders = tables.write_bucketed(
        read_table(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"), "o_orderkey"),
        f"orders_by_customer_{tag}", "customer_id",
    )
    cust = tables.write_bucketed(
        read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment"),
        f"customer_bucketed_{tag}", "customer_id",
    )
    return orders.join(cust, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("txns"), F.max("c_mktsegment").alias("segment")
    )


@query("src06_named_view", f"""{L}
SELECT {m('sum(sales)')} AS sales, count(DISTINCT txn_id) AS tx, count(*) AS line_items FROM sales_lines""")
def _(spark, sf):
    tables.register_view(retail.sales_lines(spark, sf, product=False, store=False), "sale_line_view")
    return spark.sql(
        "SELECT CAST(round(sum(sales), 2) AS double) AS sales, count(DISTINCT txn_id) AS tx, count(*) AS line_items FROM sale_line_view"
    )


@query("src07_table_statistics", "SELECT count(*) AS table_rows FROM supplier")
def _(spark, sf):
    name = f"supplier_stats_{uuid.uuid4().hex[:8]}"
    read_table(spark, sf, "supplier").write.format("parquet").mode("overwrite").saveAsTable(name)
    stats = tables.analyze(spark, name)
    return stats.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("bigint").alias("table_rows"))


@query("src08_write_scores", """
SELECT c_custkey AS customer_id, round(c_acctbal / 10000.0::DOUBLE, 4) AS score,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(CAST(c_custkey AS DOUBLE) / 7, 4) END AS lift FROM customer""")
def _(spark, sf):
    raw = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_acctbal") / 10000.0).alias("score"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan")))
        .otherwise(F.col("c_custkey").cast("double") / 7).alias("lift"),
    )
    return tables.write_scores(raw, "customer_id bigint, score double, lift double", scratch(spark, "scores"))


@query("src09_backfill", """
SELECT c_custkey, c_name, CASE WHEN x.last_ym IS NULL THEN NULL ELSE x.last_ym END AS last_ym FROM customer
LEFT JOIN (SELECT o_custkey, max(year(o_orderdate) * 100 + month(o_orderdate)) AS last_ym FROM orders
           WHERE o_orderstatus = 'F' GROUP BY 1) x ON o_custkey = c_custkey""")
def _(spark, sf):
    last = (
        read_table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max(F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("last_ym"))
    )
    return tables.backfill(read_table(spark, sf, "customer").select("c_custkey", "c_name"), last, "c_custkey", ["last_ym"])


@query("src10_relabel", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicked a link' WHEN 'view' THEN 'Viewed a page'
       WHEN 'error' THEN NULL ELSE event_type END AS label FROM events""")
def _(spark, sf):
    codes = tables.inline_table(spark, [("click", "Clicked a link"), ("view", "Viewed a page")], "code string, label string")
    ev = read_table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type")).alias("label_raw")
    )
    return tables.relabel(ev.withColumnRenamed("label_raw", "tag"), ["tag"], codes).withColumnRenamed("tag", "label")


@query("src11_inline_table", f"""{L}
SELECT t.label, count(*) AS line_items, {m('sum(l.sales)')} AS sales FROM sales_lines l
JOIN (VALUES ('T', 'Price reduction'), ('M', 'Markdown'), ('O', 'Override'), ('', 'None')) t(code, label)
  ON l.promo_type = t.code GROUP BY t.label""")
def _(spark, sf):
    kinds = tables.inline_table(
        spark, [("T", "Price reduction"), ("M", "Markdown"), ("O", "Override"), ("", "None")], "code string, label string"
    )
    df = retail.sales_lines(spark, sf, product=False, store=False)
    return df.join(kinds, df.promo_type == kinds.code).groupBy("label").agg(
        F.count(F.lit(1)).alias("line_items"), money(F.sum("sales")).alias("sales")
    )


@query("src12_export_json", """
SELECT s_suppkey, s_name, s_nationkey FROM supplier""")
def _(spark, sf):
    path = scratch(spark, "json")
    tables.export(read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "json")
    return spark.read.schema("s_suppkey bigint, s_name string, s_nationkey int").json(path)


@query("flt01_regular_sales", f"""{L}
SELECT txn_type, count(*) AS line_items, {m('sum(sales)')} AS sales FROM lines WHERE txn_type = 'Regular Sale' GROUP BY 1""")
def _(spark, sf):
    df = flt.regular_sales(retail.lines(spark, sf, product=False, store=False))
    return df.groupBy("txn_type").agg(F.count(F.lit(1)).alias("line_items"), money(F.sum("sales")).alias("sales"))


@query("flt02_blank_normalised", f"""{L}
SELECT promo_type, count(*) AS line_items FROM lines GROUP BY 1""")
def _(spark, sf):
    df = retail.raw_lines(spark, sf)
    dirty = F.when(F.col("promo_type") != "", F.concat(F.col("promo_type"), F.lit(" "))).when(
        F.col("plu") % 3 == 0, F.lit(None)
    ).when(F.col("plu") % 3 == 1, " ").otherwise("")
    return df.select(norm_blank(dirty).alias("promo_type")).groupBy("promo_type").agg(F.count(F.lit(1)).alias("line_items"))


@query("flt03_in_or_all", f"""{L}
SELECT region, 'picked' AS scope, count(*) AS line_items FROM sales_lines WHERE region IN ('ASIA', 'EUROPE') GROUP BY 1
UNION ALL SELECT region, 'all', count(*) FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False)

    def one(values, label):
        return flt.in_or_all(df, "region", values).groupBy("region").agg(F.count(F.lit(1)).alias("line_items")).withColumn("scope", F.lit(label))

    return one(["ASIA", "EUROPE"], "picked").unionByName(one(None, "all"))


@query("flt04_scalar_or_all", f"""{L}
SELECT 'NONE' AS choice, count(*) AS line_items FROM sales_lines WHERE promo_type = ''
UNION ALL SELECT 'All', count(*) FROM sales_lines UNION ALL SELECT 'T', count(*) FROM sales_lines WHERE promo_type = 'T'""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False, store=False)
    parts = [
        flt.scalar_or_all(df, "promo_type", v).agg(F.count(F.lit(1)).alias("line_items")).select(F.lit(v).alias("choice"), "line_items")
        for v in ("NONE", "All", "T")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flt05_month_range", f"""{L}
SELECT yyyymm, {m('sum(sales)')} AS sales FROM sales_lines WHERE yyyymm BETWEEN 199611 AND 199802 GROUP BY 1""")
def _(spark, sf):
    df = retail.sales_lines(spark, sf, product=False, store=False)
    return flt.month_between(df, "1996-11-05", "1998-02-20").groupBy("yyyymm").agg(money(F.sum("sales")).alias("sales"))


@query("flt06_year_to_date", f"""{L}
SELECT province, {m('sum(sales)')} AS sales FROM sales_lines WHERE yyyymm // 100 = 2000 AND yyyymm <= 200006 GROUP BY 1""")
def _(spark, sf):
    return flt.ytd(retail.sales_lines(spark, sf, product=False), 200006).groupBy("province").agg(money(F.sum("sales")).alias("sales"))


@query("flt07_trailing_12_months", f"""{L}
SELECT yyyymm, {m('sum(sales)')} AS sales FROM sales_lines WHERE yyyymm BETWEEN 200006 - 99 AND 200006 GROUP BY 1""")
def _(spark, sf):
    return flt.trailing_12m(retail.sales_lines(spark, sf, product=False, store=False), 200006).groupBy("yyyymm").agg(
        money(F.sum("sales")).alias("sales")
    )


@query("flt08_safe_ratio", f"""{L}
SELECT store_id, {pct('sum(sales) - sum(cost)', 'sum(sales)')} AS margin_pct,
       {pct("sum(CASE WHEN promo_type = 'X' THEN sales ELSE 0 END)", "sum(CASE WHEN promo_type = 'X' THEN sales ELSE 0 END)")} AS empty_ratio
FROM sales_lines GROUP BY 1""")
def _(spark, sf):
    none = F.sum(F.when(F.col("promo_type") == "X", F.col("sales")).otherwise(F.lit(0)))
    return retail.sales_lines(spark, sf).groupBy("store_id").agg(
        safe_div(F.sum("sales") - F.sum("cost"), F.sum("sales"), 2, 100.0).alias("margin_pct"),
        safe_div(none, none, 2, 100.0).alias("empty_ratio"),
    )


@query("flt09_pos_flags", f"""{L}
SELECT customer_id <> 0 AS is_loyalty_customer, promo_type <> '' AS has_promotion, txn_type = 'Regular Return' AS is_return,
       count(*) AS line_items FROM lines GROUP BY 1, 2, 3""")
def _(spark, sf):
    df = flt.pos_flags(retail.lines(spark, sf, product=False, store=False))
    return df.groupBy("is_loyalty_customer", "has_promotion", "is_return").agg(F.count(F.lit(1)).alias("line_items"))


@query("flt10_bands", f"""{LT}
SELECT CASE WHEN basket_value >= 200000 THEN 'Very large' WHEN basket_value >= 100000 THEN 'Large'
            WHEN basket_value >= 50000 THEN 'Medium' ELSE 'Small' END AS band, count(*) AS baskets FROM txn GROUP BY 1""")
def _(spark, sf):
    value = retail.raw_lines(spark, sf).groupBy("txn_id").agg(F.sum("sales").alias("v"))
    b = flt.band(F.col("v"), [(200000, "Very large"), (100000, "Large"), (50000, "Medium")], "Small")
    return value.groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("baskets"))


@query("flt11_sentinels_excluded", """
WITH e AS (SELECT user_id, hour(ts) AS site FROM events),
big AS (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT site) > 22)
SELECT user_id, count(*) AS visits FROM e WHERE user_id NOT IN (SELECT user_id FROM big) GROUP BY 1""")
def _(spark, sf):
    ev = retail.event_days(spark, sf).select("user_id", F.col("hour").alias("site"))
    return flt.exclude_sentinels(ev, "user_id", "site", 22).groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"))


@query("flt12_thin_cells_dropped", f"""{L}
SELECT store_id, category, yyyymm, {m('sum(sales)')} AS sales FROM sales_lines GROUP BY 1, 2, 3 HAVING sum(sales) >= 50000""")
def _(spark, sf):
    cells = retail.sales_lines(spark, sf).groupBy("store_id", "category", "yyyymm").agg(F.sum("sales").alias("sales"))
    return flt.min_support(cells, "sales", 50000).withColumn("sales", money(F.col("sales")))


@query("flt13_hash_sample", """
SELECT c_custkey, c_name FROM customer
WHERE CAST('0x' || substr(md5(c_custkey::VARCHAR || 'cv'), 1, 8) AS UBIGINT) % 100 < 20""")
def _(spark, sf):
    return flt.hash_sample(read_table(spark, sf, "customer"), "c_custkey", "cv", 20, portable=True).select("c_custkey", "c_name")


@query("flt14_having_minimum", f"""{L}
SELECT plu, count(*) AS line_items FROM lines GROUP BY 1 HAVING count(*) >= 35""")
def _(spark, sf):
    return flt.having_min(retail.raw_lines(spark, sf), ["plu"], 35, "line_items")


@query("flt15_modulo_split", f"""{L}
SELECT 'train' AS part, count(*) AS line_items, count(DISTINCT store_id) AS stores FROM lines WHERE store_id % 5 = 0
UNION ALL SELECT 'valid', count(*), count(DISTINCT store_id) FROM lines WHERE store_id % 5 = 1""")
def _(spark, sf):
    df = retail.lines(spark, sf, product=False, store=False)
    agg = [F.count(F.lit(1)).alias("line_items"), F.countDistinct("store_id").alias("stores")]
    parts = [flt.mod_split(df, "store_id", 5, r).agg(*agg).withColumn("part", F.lit(p)) for r, p in ((0, "train"), (1, "valid"))]
    return parts[0].unionByName(parts[1])


@query("flt16_valid_code", r"""
WITH c AS (SELECT upper(substr(c_mktsegment, 1, 1)) || (c_custkey % 12) || chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS code FROM customer)
SELECT CASE WHEN regexp_full_match(code, '[ABCEGHJ-NPRSTVXY][0-9][A-Z]') THEN 'Y' ELSE 'N' END AS valid_code, count(*) AS codes
FROM c GROUP BY 1""")
def _(spark, sf):
    key = F.col("c_custkey")
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    code = F.concat(
        F.upper(F.substring("c_mktsegment", 1, 1)), (key % 12).cast("string"), F.element_at(letters, (key % 26 + 1).cast("int"))
    )
    ok = flt.valid_code(code, "^[ABCEGHJ-NPRSTVXY][0-9][A-Z]$")
    return read_table(spark, sf, "customer").groupBy(ok.alias("valid_code")).agg(F.count(F.lit(1)).alias("codes"))


@query("flt17_filter_choices", f"""{L}
SELECT DISTINCT store_id AS value, province AS label FROM lines WHERE region = 'ASIA'""")
def _(spark, sf):
    return flt.choices(retail.lines(spark, sf, product=False), "store_id", "province", ("region", "ASIA"))
