"""Registered queries for checks, usage, lineage, pages and alerts (DQ, USE, LIN, WEB, STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import money
from shopledger.operators import quality as dq
from shopledger.plans import lineage as ln
from shopledger.plans import pages as pg
from shopledger.plans import usage as us
from shopledger.queries.common import EV, EVENTS, L, LT, LTM, div, fx, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_customers import CHURN, CLV, CM, KPI, churn_set, clv_set, kpi
from shopledger.queries.q_stores import PO, po
from shopledger.queries.q_windows import DENSE, dense_days
from shopledger.queries.q_analytics import _regm
from shopledger.queries.registry import query
from shopledger.session import spread
from shopledger.sources import retail
from shopledger.sources.tables import read_table, stream_table
from shopledger.streaming import alerts


@query("dq01_reconcile_counts", f"{LT} SELECT count(*) AS mart_rows, count(DISTINCT txn_id) AS mart_keys, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS fact_keys, count(DISTINCT txn_id) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS agree FROM txn")
def _(spark, sf):
    return dq.reconcile_counts(retail.transactions(spark, sf), retail.raw_lines(spark, sf), "txn_id")


@query("dq02_reconcile_sums", f"""{LT}, {KPI} SELECT 'transactions' AS "check", {m('(SELECT sum(basket_value) FROM txn)')} AS left_sum, {m('(SELECT sum(sales) FROM lines)')} AS right_sum, TRUE AS agree
UNION ALL SELECT 'customers', {m('(SELECT sum(total_sales) FROM kpi)')}, {m('(SELECT sum(sales) FROM lines)')}, TRUE UNION ALL SELECT 'sales only', {m("(SELECT sum(basket_value) FROM txn WHERE txn_type = 'Regular Sale')")}, {m('(SELECT sum(sales) FROM lines)')}, FALSE""")
def _(spark, sf):
    t, fact = retail.transactions(spark, sf), retail.raw_lines(spark, sf).agg(F.sum("sales").alias("s"))
    return dq.reconcile_sums([
        ("transactions", t.agg(F.sum("basket_value").alias("s")), fact), ("customers", kpi(spark, sf).agg(F.sum("total_sales").alias("s")), fact),
        ("sales only", t.where("txn_type = 'Regular Sale'").agg(F.sum("basket_value").alias("s")), fact),
    ])


@query("dq03_duplicate_keys", f"WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT count(*) AS duplicate_keys, {n('sum(n - 1)')} AS surplus_rows FROM d")
def _(spark, sf):
    return dq.dup_keys(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq04_fill_rates", f"""WITH t AS (SELECT count(*) AS n, count(a.ev) AS f1, count(CASE WHEN trim(c_name) <> '' THEN 1 END) AS f2 FROM customer LEFT JOIN (SELECT user_id, count(*) AS ev FROM events GROUP BY 1) a ON user_id = c_custkey)
SELECT 'ev' AS "column", f1 AS filled, {spct('f1', 'n')} AS fill_pct FROM t UNION ALL SELECT 'c_name', f2, {spct('f2', 'n')} FROM t""")
def _(spark, sf):
    ev = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("ev"))
    return dq.fill_rates(read_table(spark, sf, "customer").join(ev, "c_custkey", "left"), ["ev", "c_name"])


@query("dq05_range_guards", f"""{L}, {PO} SELECT 'received over ordered' AS rule, count(*) FILTER (WHERE received_units > ordered_units) AS violations FROM po UNION ALL SELECT 'lead under one day', count(*) FILTER (WHERE actual_lead_days < 1) FROM po
UNION ALL SELECT 'late', count(*) FILTER (WHERE on_time = 'N') FROM po""")
def _(spark, sf):
    return dq.range_checks(po(spark, sf), {
        "received over ordered": F.col("received_units") > F.col("ordered_units"), "lead under one day": F.col("actual_lead_days") < 1, "late": F.col("on_time") == "N",
    })


@query("dq06_leakage_guard", f"{LT}, {CHURN} SELECT count(*) AS rows_checked, count(*) FILTER (WHERE purchase_days_l30 > purchase_days_l90 OR purchase_days_l90 > purchase_days_l180 OR days_since_last < 0 OR tenure_days < 0) AS leaks FROM churn")
def _(spark, sf):
    return dq.leakage_guard(churn_set(spark, sf))


@query("dq07_one_value_per_key", "WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS broken_keys, max(n) AS max_values FROM g")
def _(spark, sf):
    return dq.fd_check(retail.raw_lines(spark, sf), "plu", "supplier_id")


@query("dq08_shape_report", f"{LTM}, {CM}, {CLV} SELECT count(*) AS rows_built, count(DISTINCT customer_id) AS keys, min(as_of_seq) AS first_period, max(as_of_seq) AS last_period, count(*) FILTER (WHERE days_since_last IS NULL) AS null_days_since_last FROM clv")
def _(spark, sf):
    return dq.shape(clv_set(spark, sf), "customer_id", "as_of_seq", ["days_since_last"])


@query("dq09_rescored_forecast", f"{DENSE}, f AS (SELECT u AS y, lag(u, 14) OVER (PARTITION BY store_id ORDER BY t) AS p FROM w) SELECT {_regm('y', 'p')} FROM f WHERE p IS NOT NULL")
def _(spark, sf):
    from pyspark.sql import Window

    from shopledger.plans.scoring import reg_metrics
    from shopledger.queries.q_sources import scratch
    from shopledger.sources.tables import write_scores

    f = dense_days(spark, sf).withColumn("p", F.lag("u", 14).over(Window.partitionBy("store_id").orderBy("t")))
    stored = write_scores(f, "store_id int, t int, u double, p double", scratch(spark, "forecast"))
    return reg_metrics(stored, "u", "p")


@query("dq10_result_assertion", "SELECT count(*) AS result_rows, TRUE AS passed FROM nation")
def _(spark, sf):
    return dq.assert_result(read_table(spark, sf, "nation"), 5, ["NATION_7"])


@query("dq11_basis_probe", f"{L} SELECT quantity, count(*) AS line_items, {div('sum(cost)', 'count(*)', 4)} AS cost_per_line, {div('sum(cost)', 'sum(quantity)', 4)} AS cost_per_unit, {div('sum(sales)', 'sum(quantity)', 4)} AS price_per_unit FROM lines GROUP BY 1")
def _(spark, sf):
    df = retail.raw_lines(spark, sf).join(retail.products(spark, sf), "plu")
    return dq.basis_probe(df.withColumn("cost", (F.col("unit_cost") * F.col("quantity").cast("decimal(8,0)")).cast("decimal(18,2)")))


LOG = "log AS (SELECT event_id, ts, user_id, '/reports/r' || (event_id * 7 % 97) AS resource, 'com.app.' || event_type AS kind, event_type = 'signup' AS updating FROM events)"
RES = "res AS (SELECT '/reports/r' || p_partkey AS resource, p_name || ' ' || p_partkey AS label FROM part)"


def log(spark, sf):
    return read_table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.concat(F.lit("/reports/r"), (F.col("event_id") * 7 % 97).cast("string")).alias("resource"), F.concat(F.lit("com.app."), "event_type").alias("kind"), (F.col("event_type") == "signup").alias("updating")
    )


def resources(spark, sf):
    k = F.col("p_partkey").cast("string")
    return read_table(spark, sf, "part").select(F.concat(F.lit("/reports/r"), k).alias("resource"), F.concat_ws(" ", "p_name", k).alias("label"))


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("use01_top_resources", f"WITH {LOG} SELECT resource, regexp_replace(kind, '^.*\\.', '') AS type, count(*) AS events, count(DISTINCT user_id) AS users, {TS.format('max(ts)')} AS last_access FROM log WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY resource, kind ORDER BY events DESC, max(ts) DESC, resource LIMIT 20")
def _(spark, sf):
    return us.usage_top(log(spark, sf), F.lit("2024-01-11").cast("timestamp"), 20)


@query("use02_active_users", f"WITH {LOG} SELECT user_id, count(*) AS events, count(DISTINCT resource) AS resources, {TS.format('max(ts)')} AS last_active FROM log GROUP BY 1 ORDER BY events DESC, user_id LIMIT 25")
def _(spark, sf):
    return us.usage_users(log(spark, sf), 25)


@query("use02_resource_users", f"WITH {LOG} SELECT user_id, count(*) AS events, {TS.format('min(ts)')} AS first_access, {TS.format('max(ts)')} AS last_access FROM log WHERE resource = '/reports/r14' GROUP BY 1")
def _(spark, sf):
    return us.usage_resource(log(spark, sf), "/reports/r14")


@query("use02_recent_events", f"WITH {LOG} SELECT event_id, user_id, resource, regexp_replace(kind, '^.*\\.', '') AS type, updating FROM log ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    return us.usage_recent(log(spark, sf), 50)


INVR = f"""seen AS (SELECT resource, max(ts) AS t, arg_max(user_id, (ts, event_id)) AS lu, arg_min(user_id, (ts, event_id)) AS fu, count(*) AS c FROM log GROUP BY 1), own AS (SELECT resource, arg_min(user_id, (ts, event_id)) AS ed FROM log WHERE updating GROUP BY 1),
invr AS (SELECT resource, label, coalesce(CAST(ed AS VARCHAR), CAST(fu AS VARCHAR), 'n/a') AS owner, {TS.format('t')} AS last_accessed, coalesce(CAST(lu AS VARCHAR), '-') AS last_accessed_by, coalesce(c, 0) AS access_count FROM res LEFT JOIN seen USING (resource) LEFT JOIN own USING (resource))"""


@query("use03_resource_inventory", f"WITH {LOG}, {RES}, {INVR} SELECT * FROM invr")
def _(spark, sf):
    return us.inventory(resources(spark, sf), log(spark, sf))


@query("use04_peak_hours", "SELECT hour(ts) AS hour, count(*) AS events FROM events GROUP BY 1")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "peak_usage_hours")


@query("use04_unique_viewers", f"WITH {LOG} SELECT resource, count(DISTINCT user_id) AS viewers FROM log GROUP BY 1")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "unique_viewers_per_content")


@query("use04_never_accessed", f"WITH {LOG}, {RES} SELECT resource, label FROM res WHERE resource NOT IN (SELECT resource FROM log)")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "never_accessed")


@query("use04_content_by_owner", f"WITH {LOG}, {RES}, {INVR} SELECT owner, count(*) AS items FROM invr GROUP BY 1")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "content_by_owner")


@query("use04_stale_content", f"WITH {LOG}, l AS (SELECT resource, max(CAST(ts AS DATE)) AS d FROM log GROUP BY 1) SELECT resource, date_diff('day', d, DATE '2024-01-31') AS days_idle FROM l WHERE date_diff('day', d, DATE '2024-01-31') >= 1")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "stale_content", F.lit("2024-01-31").cast("date"), 1)


@query("use04_average_views", f"WITH {LOG} SELECT {div('count(*)', 'count(DISTINCT resource)', 4)} AS avg_views FROM log")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "avg_views_per_content")


@query("use04_user_last_active", f"WITH {LOG} SELECT user_id, {TS.format('max(ts)')} AS last_active FROM log GROUP BY 1")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "user_last_active")


@query("use04_items_per_folder", f"WITH {RES} SELECT '/' || split_part(resource, '/', 2) AS folder, count(*) AS items FROM res GROUP BY 1")
def _(spark, sf):
    return us.usage_metric(log(spark, sf), resources(spark, sf), "items_per_folder")


SQLT = """sqlt AS (SELECT event_id AS asset, 'SELECT a.x FROM ' || event_type || '_log a JOIN Users_' || (user_id % 7) || ' u ON a.d = $P{from day} ' || CASE WHEN value > 100 THEN 'join (SELECT 1 FROM dw.archive_' || (user_id % 3) || ') z ON 1 = 1 ' ELSE '' END || CASE WHEN user_id % 2 = 0 THEN 'LEFT JOIN ' || upper(event_type) || '_LOG b ON 1 = 1' ELSE '' END AS sql FROM events)"""


def sql_texts(spark, sf):
    u = F.col("user_id")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("SELECT a.x FROM "), F.col("event_type"), F.lit("_log a JOIN Users_"), s(u % 7), F.lit(" u ON a.d = $P{from day} "),
        F.when(F.col("value") > 100, F.concat(F.lit("join (SELECT 1 FROM dw.archive_"), s(u % 3), F.lit(") z ON 1 = 1 "))).otherwise(""),
        F.when(u % 2 == 0, F.concat(F.lit("LEFT JOIN "), F.upper("event_type"), F.lit("_LOG b ON 1 = 1"))).otherwise(""),
    )
    return read_table(spark, sf, "events").select(F.col("event_id").alias("asset"), text.alias("sql"))


# The tables that each made text names, said from the columns that made it.
SRC = """src AS (SELECT event_id AS asset, CASE WHEN value > 100 THEN 'inferred' ELSE 'parsed' END AS confidence,
unnest(list_filter([event_type || '_log', 'Users_' || (user_id % 7), CASE WHEN value > 100 THEN 'dw.archive_' || (user_id % 3) END], lambda t: t IS NOT NULL)) AS table_name FROM events)"""


@query("lin01_source_tables", f"WITH {SQLT}, {SRC} SELECT asset, confidence, table_name FROM src")
def _(spark, sf):
    return ln.source_tables(sql_texts(spark, sf), "asset", "sql")


def edges(spark, sf):
    return ln.lineage_edges(ln.source_tables(sql_texts(spark, sf), "asset", "sql"), "asset")


@query("lin02_edges", f"WITH {SQLT}, {SRC} SELECT 'query->table' AS type, confidence, count(*) AS edges, count(DISTINCT asset) AS sources, count(DISTINCT table_name) AS targets FROM src GROUP BY 2")
def _(spark, sf):
    return ln.edge_counts(edges(spark, sf))


@query("lin03_event_json", f"""WITH {SQLT}, {SRC}, g AS (SELECT asset, list(table_name ORDER BY table_name) AS ts FROM src GROUP BY 1)
SELECT asset AS source, len(ts) AS n_inputs, '{{"eventType":"COMPLETE","job":{{"namespace":"warehouse","name":' || asset || '}},"inputs":[' || array_to_string(list_transform(ts, lambda t: '{{"namespace":"warehouse","name":"' || t || '"}}'), ',') || '],"outputs":[{{"namespace":"warehouse","name":' || asset || '}}]}}' AS event FROM g""")
def _(spark, sf):
    return ln.lineage_events(edges(spark, sf), "warehouse")


@query("lin02_assets", f"""WITH {SQLT}, {SRC} SELECT CAST(asset AS VARCHAR) AS name, 'query' AS type, count(DISTINCT table_name) AS links FROM src GROUP BY 1 UNION ALL SELECT table_name, 'table', count(DISTINCT asset) FROM src GROUP BY 1""")
def _(spark, sf):
    return ln.lineage_assets(edges(spark, sf))


@query("lin03_source_columns", """SELECT event_id AS asset, event_type || '_log' AS table_name, unnest(['x', 'd']) AS column_name FROM events""")
def _(spark, sf):
    return ln.source_columns(sql_texts(spark, sf), "asset", "sql")


@query("lin03_event_with_columns", f"""WITH {SQLT}, {SRC}, g AS (SELECT asset, list(table_name ORDER BY table_name) AS ts FROM src GROUP BY 1), f AS (SELECT event_id AS asset, '[{{"namespace":"warehouse","name":"' || event_type || '_log","field":"' AS h FROM events)
SELECT asset AS source, len(ts) AS n_inputs, '{{"eventType":"COMPLETE","job":{{"namespace":"warehouse","name":' || asset || '}},"inputs":[' || array_to_string(list_transform(ts, lambda t: '{{"namespace":"warehouse","name":"' || t || '"}}'), ',') || '],"outputs":[{{"namespace":"warehouse","name":' || asset || ',"facets":{{"columnLineage":{{"fields":{{"d":{{"inputFields":' || h || 'd"}}]}},"x":{{"inputFields":' || h || 'x"}}]}}}}}}}}}}]}}' AS event FROM g JOIN f USING (asset)""")
def _(spark, sf):
    columns = ln.source_columns(sql_texts(spark, sf), "asset", "sql").withColumnRenamed("asset", "source")
    return ln.lineage_events(edges(spark, sf), "warehouse", columns)


@query("web01_page_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"?]+)', 1)) AS link FROM pages""")
def _(spark, sf):
    return pg.page_links(read_table(spark, sf, "pages"), "page_id", r'href="(/[^"?]+)')


@query("web02_flattened_pages", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<svg\b.*?</svg\s*>', ' ', 'gis'), '<[^>]+>', '|', 'g') AS t FROM pages),
b AS (SELECT page_id, string_split(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '|') AS xs FROM a),
c AS (SELECT page_id, list_transform(xs, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS xs FROM b)
SELECT page_id, array_to_string(list_filter(xs, lambda x, i: x <> '' OR i = 1 OR i = len(xs)), ' | ') AS flat FROM c""")
def _(spark, sf):
    return pg.flatten_html(read_table(spark, sf, "pages").select("page_id", "html")).select("page_id", "flat")


def product_pages(spark, sf):
    """Catalogue pages built from the product table, every product one page."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    kg = size % 3 == 0
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Product","productID":"'), s(k), F.lit('","name":"'), F.col("p_name"), F.lit(' &amp; co","description":"A  good '), F.col("p_type"),
        F.lit('","offers":{"price":"'), s(F.col("p_retailprice")), F.lit('","availability":"'), F.when(size % 2 == 0, "https://schema.org/InStock").otherwise("SoldOut"), F.lit('"}}</script>'),
    )
    body = F.concat(
        F.lit("<html><script>var a=1;</script>"), F.when(size % 5 == 0, F.lit('<script type="application/ld+json">{"@type":"Thing"}</script>')).otherwise(""), F.when(size == 1, F.lit("")).otherwise(ld),
        F.lit("<span> "), F.when(kg, F.concat(s(size), F.lit(" kg"))).otherwise(F.concat(s(size * 10), F.lit(" g"))), F.lit(" </span><h2>Ingredients</h2><p>Ingredients</p><p>Water, salt, "), F.col("p_brand"), F.lit(" and "), F.col("p_type"),
        F.lit(" flour</p>"), F.when(size % 4 == 0, F.concat(F.lit("<b>Allergens</b><p>Wheat, "), F.col("p_brand"), F.lit("</p>"))).otherwise(""), F.lit("<div>Nutrition Facts</div><div>Per 1 piece ("), s(size), F.lit(" g)</div><div>Calories "), s(size * 4), F.lit("</div><div>Fat</div><div>"), s(size % 9), F.lit(" g</div><div>Sodium</div><div>"), s(size * 3), F.lit(" mg</div>"),
        *[x for label, k, unit in (("Saturated", 2, "g"), ("Trans Fat", 8, "g"), ("Total Carbohydrate", 5, "g"), ("Dietary Fibre", 3, "g"), ("Sugars", 4, "g"), ("Protein", 6, "g"), ("Cholesterol", 7, "mg"), ("Potassium", 11, "mg")) for x in (F.lit(f"<p>{label}</p><i>"), s(size * k), F.lit(f" {unit}</i>"))], F.lit("</html>"),
    )
    return spread(read_table(spark, sf, "part")).select(k.alias("page_id"), body.alias("html"))


@query("web03_product_records", """SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS plu, p_name || ' &amp; co' AS product_name, 'A good ' || p_type AS web_description, CAST(p_retailprice AS VARCHAR) AS price, CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS in_stock,
CASE WHEN p_size % 3 = 0 THEN p_size || ' kg' ELSE (p_size * 10) || ' g' END AS package_size, CASE WHEN p_size % 3 = 0 THEN CAST(p_size * 1000 AS VARCHAR) ELSE CAST(p_size * 10 AS VARCHAR) END AS size_g, 'Water, salt, ' || p_brand || ' and ' || p_type || ' flour' AS ingredients, CASE WHEN p_size % 4 = 0 THEN 'Wheat, ' || p_brand ELSE '' END AS allergens,
'1 piece (' || p_size || ' g)' AS serving_size, CAST(p_size AS VARCHAR) AS serving_g, CAST(p_size * 4 AS VARCHAR) AS calories, CAST(p_size % 9 AS VARCHAR) AS fat_g, CAST(p_size * 2 AS VARCHAR) AS sat_fat_g, CAST(p_size * 5 AS VARCHAR) AS carbs_g, CAST(p_size * 3 AS VARCHAR) AS fibre_g, CAST(p_size * 4 AS VARCHAR) AS sugars_g, CAST(p_size * 6 AS VARCHAR) AS protein_g,
CAST(p_size * 7 AS VARCHAR) AS cholesterol_mg, CAST(p_size * 3 AS VARCHAR) AS sodium_mg, CAST(p_size * 11 AS VARCHAR) AS potassium_mg FROM part WHERE p_size <> 1""")
def _(spark, sf):
    return pg.extract_product(product_pages(spark, sf), "page_id")


@query("web03_pages_without_product", "SELECT count(*) AS pages, 0 AS product_pages FROM pages")
def _(spark, sf):
    found = pg.extract_product(read_table(spark, sf, "pages"), "page_id").agg(F.count("*").alias("n")).scalar()
    return read_table(spark, sf, "pages").agg(F.count("*").alias("pages")).select("pages", found.alias("product_pages"))


WIN = "w AS (SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, event_type, sum(value) AS watched FROM ev GROUP BY 1, 2)"


@query("str01_batch_alert", f"{EV}, {WIN} SELECT window_start, event_type, CAST(watched AS DOUBLE) AS watched FROM w WHERE watched > 3500")
def _(spark, sf):
    ev = retail.event_days(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = alerts.windowed_alert(ev, ["event_type"], F.col("value"), "greater", 3500, "1 day", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", F.col("watched").cast("double").alias("watched"))


@query("str01_live_alert", f"{EV}, {WIN} SELECT window_start, event_type, CAST(watched AS DOUBLE) AS watched FROM w WHERE watched > 3500 AND CAST(window_start AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)")
def _(spark, sf):
    schema = read_table(spark, sf, "events").schema
    stream = stream_table(spark, sf, "events", schema)
    ev = stream.withColumn("value", F.col("value").cast("decimal(12,2)")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = alerts.windowed_alert(ev, ["event_type"], F.col("value"), "greater", 3500, "1 day", "1 hour")
    rows = alerts.run_available(spark, out)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", F.col("watched").cast("double").alias("watched"))
