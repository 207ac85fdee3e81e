"""SQL fragments that state the retail model over the given tables."""

from __future__ import annotations

LINES = """
headers AS (
  SELECT o_orderkey AS txn_id, o_custkey AS customer_id, c_nationkey AS store_id,
         CAST(o_orderdate AS DATE) AS sale_date, o_orderpriority AS priority,
         CASE o_orderstatus WHEN 'F' THEN 'Regular Sale' WHEN 'P' THEN 'Regular Return'
              ELSE 'Post Void TX' END AS txn_type
  FROM orders JOIN customer ON o_custkey = c_custkey),
products AS (
  SELECT p_partkey AS plu, p_name AS product_name, p_type AS category, p_brand AS sub_category,
         p_size AS pack_size, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_cost FROM part),
stores AS (
  SELECT n_nationkey AS store_id, n_name || ' - Main' AS store_name, n_name AS province, r_name AS region,
         CASE n_nationkey % 4 WHEN 0 THEN 'Standalone' WHEN 1 THEN 'Strip Plaza'
              WHEN 2 THEN 'Shopping Mall' ELSE 'Urban Storefront' END AS store_format,
         1000 + (n_nationkey * 370) % 900 AS square_feet, 'OWN-' || (n_nationkey % 9) AS owner_id
  FROM nation JOIN region ON n_regionkey = r_regionkey),
raw_lines AS (
  SELECT l_orderkey AS txn_id, l_partkey AS plu, l_suppkey AS supplier_id, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS regular_value,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS sales,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(l_tax AS DECIMAL(4,2)) AS tax_rate,
         CASE WHEN l_discount >= 0.08 THEN 'T' WHEN l_discount >= 0.05 THEN 'M'
              WHEN l_discount > 0 THEN 'O' ELSE '' END AS promo_type,
         l_returnflag AS return_flag, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem),
lines AS (
  SELECT r.*, h.customer_id, h.store_id, h.sale_date, h.priority, h.txn_type,
         p.product_name, p.category, p.sub_category, p.pack_size, p.unit_cost,
         p.unit_cost * r.quantity AS cost, s.store_name, s.province, s.region,
         year(h.sale_date) * 100 + month(h.sale_date) AS yyyymm
  FROM raw_lines r JOIN headers h USING (txn_id) JOIN products p USING (plu) JOIN stores s USING (store_id)),
sales_lines AS (SELECT * FROM lines WHERE txn_type = 'Regular Sale')
"""

TXN = """
txn AS (
  SELECT b.*, h.customer_id, h.store_id, h.sale_date, h.txn_type, h.priority,
         b.basket_value - b.basket_cost AS basket_margin,
         date_diff('day', DATE '1970-01-01', h.sale_date) + 2440588 AS jdn,
         year(h.sale_date) * 100 + month(h.sale_date) AS yyyymm,
         CASE WHEN h.priority IN ('1-URGENT', '2-HIGH') THEN 'Delivery' ELSE 'Store' END AS channel
  FROM (SELECT txn_id, count(*) AS line_items, CAST(sum(quantity) AS BIGINT) AS basket_items,
               sum(sales) AS basket_value, sum(cost) AS basket_cost, sum(discount) AS discount_total,
               sum(CASE WHEN promo_type <> '' THEN sales ELSE 0 END) AS promo_value,
               max(CASE WHEN promo_type <> '' THEN 'Y' ELSE 'N' END) AS promo_flag,
               count(DISTINCT plu) AS distinct_plus, count(DISTINCT category) AS distinct_categories
        FROM lines GROUP BY txn_id) b JOIN headers h USING (txn_id))
"""

MONTHS = """
months AS (
  SELECT year(m) * 100 + month(m) AS yyyymm, CAST(m AS DATE) AS month_start, last_day(m) AS month_end,
         row_number() OVER (ORDER BY m) AS month_seq
  FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
                      INTERVAL 1 MONTH)) AS m FROM orders) x)
"""

EVENTS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value, props,
         CAST(ts AS DATE) AS day, hour(ts) AS hour, user_id % 25 AS store_id FROM events)
"""

L = "WITH " + LINES
LT = "WITH " + LINES + "," + TXN
LTM = LT + "," + MONTHS
EV = "WITH " + EVENTS


def m(x: str, scale: int = 2) -> str:
    """A decimal sum as a rounded double."""
    return f"CAST(round({x}, {scale}) AS DOUBLE)"


def n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def fx(x: str, scale: int = 2) -> str:
    """A double with fixed decimals, half away from zero."""
    p = f"1{'0' * scale}.0::DOUBLE"
    return f"(sign({x}) * floor(abs({x}) * {p} + 0.5::DOUBLE) / {p} + 0.0::DOUBLE)"


def pct(a: str, b: str, scale: int = 2) -> str:
    return fx(f"(100.0::DOUBLE * CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))", scale)


def div(a: str, b: str, scale: int = 2) -> str:
    return fx(f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))", scale)
