"""Registered queries for finance marts (MRT-22..35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import fixed, money, yyyymm
from shopledger.plans import finance as fi
from shopledger.plans.customers import loyalty_ledger
from shopledger.queries.common import EV, EVENTS, L, LT, LTM, div, fx, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_customers import CM
from shopledger.queries.q_joins import RATES_SQL, rates
from shopledger.queries.registry import query
from shopledger.sources import inputs, retail

ONE = "*"


def store_rates(spark, sf):
    s = F.col("store_id")
    return retail.stores(spark, sf).select(
        "store_id", "region", "store_format", "square_feet", (s % 3 + 14).cast("double").alias("labour_burden_pct"), (s % 5 + 20).cast("double").alias("occupancy_rate"),
        (F.lit(0.36) + (s % 9).cast("double") / F.lit(100.0)).alias("utilities_base"), (F.lit(1.5) + (s % 16).cast("double") / F.lit(10.0)).alias("other_opex_pct"),
        F.lit(5.0).alias("royalty_rate_pct"), F.lit(2.0).alias("marketing_fee_pct"),
    )


def pnl(spark, sf):
    t = retail.transactions(spark, sf)
    sale, zero = F.col("txn_type") == retail.SALE, F.lit(0).cast("decimal(28,4)")
    pick = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(F.lit(0)))
    sales = t.groupBy("store_id", "yyyymm").agg(
        pick(sale, "basket_value").alias("net_sales"), pick(F.col("txn_type") == retail.RETURN, "basket_value").alias("returns_value"), pick(sale, "basket_cost").alias("cogs"),
        F.count_if(sale).alias("transactions"), pick(sale, "basket_items").alias("units"), (pick(sale, "discount_total") / 10).cast("decimal(28,4)").alias("subsidy"),
        (pick(sale, "basket_items") * 180).alias("labour_cost"),
    )
    shrink = inputs.shrink_log(spark, sf).groupBy("store_id", "yyyymm").agg(F.sum("shrink_value").alias("shrinkage_cost"))
    deliv = t.where(sale & (F.col("channel") == "Delivery")).groupBy("store_id", "yyyymm").agg(F.sum("basket_value").alias("delivery_value"), F.count(ONE).alias("delivery_orders"))
    return fi.store_pnl(sales, shrink, deliv, store_rates(spark, sf))


SHRINK = "shrink AS (SELECT store_id, plu, category, sub_category, yyyymm, CASE promo_type WHEN 'T' THEN 'Damaged' WHEN 'M' THEN 'Theft' WHEN 'O' THEN 'Expired' ELSE 'Admin error' END AS reason, quantity % 5 + 1 AS qty_lost, unit_cost * (quantity % 5 + 1) AS shrink_value FROM lines WHERE return_flag = 'R')"
PNL = f"""{SHRINK}, ps AS (SELECT store_id, yyyymm, CAST(sum(CASE WHEN txn_type = 'Regular Sale' THEN basket_value ELSE 0 END) AS DOUBLE) AS net_sales, CAST(sum(CASE WHEN txn_type = 'Regular Return' THEN basket_value ELSE 0 END) AS DOUBLE) AS returns_value,
 CAST(sum(CASE WHEN txn_type = 'Regular Sale' THEN basket_cost ELSE 0 END) AS DOUBLE) AS cogs, count(*) FILTER (WHERE txn_type = 'Regular Sale') AS transactions, CAST(sum(CASE WHEN txn_type = 'Regular Sale' THEN basket_items ELSE 0 END) AS BIGINT) AS units,
 CAST(CAST(sum(CASE WHEN txn_type = 'Regular Sale' THEN discount_total ELSE 0 END) * 0.1 AS DECIMAL(28,4)) AS DOUBLE) AS promo_subsidy_income, CAST(sum(CASE WHEN txn_type = 'Regular Sale' THEN basket_items ELSE 0 END) * 180 AS DOUBLE) AS labour_cost FROM txn GROUP BY 1, 2),
 ph AS (SELECT store_id, yyyymm, CAST(sum(shrink_value) AS DOUBLE) AS shrinkage_cost FROM shrink GROUP BY 1, 2),
 pd AS (SELECT store_id, yyyymm, CAST(sum(basket_value) AS DOUBLE) AS dv, CAST(count(*) AS DOUBLE) AS dc FROM txn WHERE txn_type = 'Regular Sale' AND channel = 'Delivery' GROUP BY 1, 2),
 temps AS (SELECT * FROM (VALUES (1, -6.0::DOUBLE), (2, -5.0), (3, 0.0), (4, 7.0), (5, 13.0), (6, 18.0), (7, 22.0), (8, 21.0), (9, 16.0), (10, 9.0), (11, 3.0), (12, -3.0)) v(mo, temp)),
 pc AS (SELECT ps.*, st.region, st.store_format, st.square_feet, coalesce(shrinkage_cost, 0.0::DOUBLE) AS shrinkage_cost, labour_cost * CAST(ps.store_id % 3 + 14 AS DOUBLE) / 100.0::DOUBLE AS labour_burden,
  CAST(square_feet AS DOUBLE) * CAST(ps.store_id % 5 + 20 AS DOUBLE) / 12.0::DOUBLE AS occupancy_cost,
  CAST(square_feet AS DOUBLE) * (0.36::DOUBLE + CAST(ps.store_id % 9 AS DOUBLE) / 100.0::DOUBLE) * (1.0::DOUBLE + 0.025::DOUBLE * greatest(0.0::DOUBLE, 12.0::DOUBLE - temp) + 0.02::DOUBLE * greatest(0.0::DOUBLE, temp - 20.0::DOUBLE)) AS utilities_cost,
  greatest(0.0::DOUBLE, coalesce(dv, 0.0::DOUBLE) * 0.2::DOUBLE - coalesce(dc, 0.0::DOUBLE) * 5.0::DOUBLE) AS delivery_partner_cost, net_sales * 0.012::DOUBLE AS card_processing_fees,
  net_sales * (1.5::DOUBLE + CAST(ps.store_id % 16 AS DOUBLE) / 10.0::DOUBLE) / 100.0::DOUBLE AS other_opex, net_sales * 5.0::DOUBLE / 100.0::DOUBLE AS royalty_fee, net_sales * 2.0::DOUBLE / 100.0::DOUBLE AS marketing_fee
  FROM ps LEFT JOIN ph USING (store_id, yyyymm) LEFT JOIN pd USING (store_id, yyyymm) JOIN stores st USING (store_id) JOIN temps ON mo = yyyymm % 100),
 pt AS (SELECT *, net_sales - cogs AS gross_margin, labour_cost + labour_burden + occupancy_cost + utilities_cost + shrinkage_cost + delivery_partner_cost + card_processing_fees + other_opex AS total_store_opex, royalty_fee + marketing_fee AS franchise_fees FROM pc),
 pe AS (SELECT *, gross_margin + promo_subsidy_income - total_store_opex AS four_wall_ebitda FROM pt), pnl AS (SELECT *, four_wall_ebitda - franchise_fees AS store_contribution FROM pe)"""

PNL_OUT = ["net_sales", "returns_value", "cogs", "gross_margin", "promo_subsidy_income", "labour_cost", "labour_burden", "occupancy_cost", "utilities_cost", "shrinkage_cost", "delivery_partner_cost", "card_processing_fees", "other_opex", "total_store_opex", "royalty_fee", "marketing_fee", "four_wall_ebitda", "store_contribution"]


@query("mrt22_store_profit", f"""{LT}, {PNL} SELECT store_id, region, store_format, yyyymm, transactions, units, {", ".join(f"{fx(c)} AS {c}" for c in PNL_OUT)},
{spct('four_wall_ebitda', 'net_sales')} AS four_wall_margin_pct, {div('net_sales', 'square_feet')} AS sales_per_sqft FROM pnl""")
def _(spark, sf):
    from shopledger.functions import pct, safe_div

    p = pnl(spark, sf)
    return p.select(
        "store_id", "region", "store_format", "yyyymm", "transactions", "units", *[fixed(F.col(c), 2).alias(c) for c in PNL_OUT],
        pct(F.col("four_wall_ebitda"), F.col("net_sales")).alias("four_wall_margin_pct"), safe_div(F.col("net_sales"), F.col("square_feet"), 2).alias("sales_per_sqft"),
    )


BUD_COLS = ["net_sales", "promo_subsidy_income", "cogs", "labour_cost", "labour_burden", "occupancy_cost", "utilities_cost", "shrinkage_cost", "delivery_partner_cost", "card_processing_fees", "other_opex", "royalty_fee", "marketing_fee", "store_contribution"]


def budget(spark, sf):
    """Plan: the same month a year before, grown by a fixed factor."""
    p = pnl(spark, sf)
    g = F.lit(1.05)
    return p.select(
        "store_id", (F.col("yyyymm") + 100).alias("yyyymm"), F.lit("Original").alias("budget_version"), *[(F.col(c) * g).alias(f"budget_{c}") for c in BUD_COLS],
        ((F.col("total_store_opex") + F.col("franchise_fees")) * g).alias("budget_total_opex"),
    )


BUDGET = f"budget AS (SELECT store_id, yyyymm + 100 AS yyyymm, 'Original' AS budget_version, {', '.join(f'{c} * 1.05::DOUBLE AS budget_{c}' for c in BUD_COLS)}, (total_store_opex + franchise_fees) * 1.05::DOUBLE AS budget_total_opex FROM pnl)"


@query("mrt23_budget_against_actual", f"""{LT}, {PNL}, {BUDGET}, j AS (SELECT b.*, p.region, p.net_sales, p.total_store_opex + p.franchise_fees AS ox, p.store_contribution AS sc FROM budget b JOIN pnl p USING (store_id, yyyymm))
SELECT store_id, region, yyyymm, budget_version, {fx("net_sales", 2)} AS actual_net_sales, {fx("budget_net_sales", 2)} AS budget_net_sales, {fx("net_sales - budget_net_sales", 2)} AS sales_variance, {spct('net_sales - budget_net_sales', 'budget_net_sales')} AS sales_variance_pct,
{fx("ox", 2)} AS actual_total_opex, {fx("budget_total_opex", 2)} AS budget_total_opex, {fx("ox - budget_total_opex", 2)} AS opex_variance, {fx("sc", 2)} AS actual_store_contribution, {fx("sc - budget_store_contribution", 2)} AS contribution_variance,
{spct('sc - budget_store_contribution', 'abs(budget_store_contribution)')} AS contribution_variance_pct, CASE WHEN net_sales >= budget_net_sales THEN 'Y' ELSE 'N' END AS sales_on_plan, CASE WHEN ox <= budget_total_opex THEN 'Y' ELSE 'N' END AS opex_on_plan FROM j""")
def _(spark, sf):
    return fi.budget_vs_actual(budget(spark, sf), pnl(spark, sf))


SM = "sm AS (SELECT store_id, yyyymm, CAST(sum(sales) AS DOUBLE) AS s FROM sales_lines GROUP BY 1, 2)"


@query("mrt24_target_attainment", f"""{L}, {SM} SELECT t.store_id, t.yyyymm + 100 AS yyyymm, {fx("t.s * 1.04::DOUBLE", 2)} AS target_sales, {fx("coalesce(a.s, 0.0::DOUBLE)", 2)} AS actual_sales, {spct('coalesce(a.s, 0.0::DOUBLE)', 't.s * 1.04::DOUBLE')} AS attainment_pct
FROM sm t LEFT JOIN sm a ON a.store_id = t.store_id AND a.yyyymm = t.yyyymm + 100""")
def _(spark, sf):
    sm = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "yyyymm").agg(F.sum("sales").cast("double").alias("s"))
    targets = sm.select("store_id", (F.col("yyyymm") + 100).alias("yyyymm"), (F.col("s") * F.lit(1.04)).alias("target_sales"))
    return fi.attainment(targets, sm.withColumnRenamed("s", "actual_sales"))


ACCOUNTS = [("4000", "Net Sales", "Revenue", "net_sales", 1), ("4100", "Promotion Subsidy Income", "Revenue", "promo_subsidy_income", 1), ("5000", "Cost of Goods Sold", "COGS", "cogs", -1), ("6100", "Occupancy", "Occupancy", "occupancy_cost", -1), ("6110", "Utilities", "Occupancy", "utilities_cost", -1), ("6200", "Shrinkage", "Store Opex", "shrinkage_cost", -1), ("6210", "Delivery Partner Cost", "Store Opex", "delivery_partner_cost", -1), ("6220", "Card Processing Fees", "Store Opex", "card_processing_fees", -1), ("6230", "Other Operating Expense", "Store Opex", "other_opex", -1), ("7000", "Royalty Fee", "Franchise Fees", "royalty_fee", -1), ("7010", "Marketing Fee", "Franchise Fees", "marketing_fee", -1)]
GL = " UNION ALL ".join(f"SELECT store_id, region, yyyymm, '{a}' AS account_code, '{b}' AS account_name, '{g}' AS account_group, {c} * {s}.0::DOUBLE AS amount, budget_{c} * {s}.0::DOUBLE AS budget FROM gj" for a, b, g, c, s in ACCOUNTS)
GL += " UNION ALL SELECT store_id, region, yyyymm, '4010', 'Sales Returns', 'Revenue', returns_value, NULL FROM gj UNION ALL SELECT store_id, region, yyyymm, '6000', 'Labour (loaded)', 'Labour', -(labour_cost + labour_burden), -(budget_labour_cost + budget_labour_burden) FROM gj"


@query("mrt25_general_ledger", f"""{LT}, {PNL}, {BUDGET}, gj AS (SELECT * FROM pnl LEFT JOIN budget USING (store_id, yyyymm)), gl AS ({GL})
SELECT store_id, region, yyyymm, account_code, account_name, account_group, {fx("amount", 2)} + 0.0::DOUBLE AS amount, {fx("budget", 2)} + 0.0::DOUBLE AS budget, {fx("amount - budget", 2)} + 0.0::DOUBLE AS variance, CASE WHEN amount - budget >= 0 THEN 'Y' WHEN budget IS NULL THEN NULL ELSE 'N' END AS favourable FROM gl""")
def _(spark, sf):
    gl = fi.gl_monthly(pnl(spark, sf), budget(spark, sf))
    return gl.select(*[(F.col(c) + F.lit(0.0)).alias(c) if c in ("amount", "budget", "variance") else F.col(c) for c in gl.columns])


def point_flows(spark, sf):
    led = loyalty_ledger(retail.transactions(spark, sf))
    earned = F.sum(F.when(F.col("entry_type") == "EARN", F.col("points")).otherwise(0))
    used = F.sum(F.when(F.col("entry_type") == "ADJUST", -F.col("points")).otherwise(0))
    return led.groupBy("yyyymm").agg(earned.alias("points_in"), used.alias("points_out"))


FLOWS = "flows AS (SELECT yyyymm, sum(CASE WHEN entry_type = 'EARN' THEN points ELSE 0 END) AS points_in, sum(CASE WHEN entry_type = 'ADJUST' THEN -points ELSE 0 END) AS points_out FROM ledger GROUP BY 1), bal AS (SELECT *, sum(points_in - points_out) OVER (ORDER BY yyyymm) AS closing_balance FROM flows)"


@query("mrt26_balance_rollforward", f"""{LTM}, {CM}, {FLOWS} SELECT yyyymm, {n('points_in')} AS points_in, {n('points_out')} AS points_out, {n('closing_balance - (points_in - points_out)')} AS opening_balance, {n('closing_balance')} AS closing_balance FROM bal""")
def _(spark, sf):
    # months only: at most one row per calendar month
    return fi.rollforward(point_flows(spark, sf).withColumn("all", F.lit(0)), ["all"], "yyyymm", "points_in", "points_out").drop("all")


SHIFTS = "shifts AS (SELECT store_id, day, user_id AS employee_id, CASE WHEN hour < 8 THEN 'Morning' WHEN hour < 16 THEN 'Day' ELSE 'Evening' END AS shift_name, CAST(event_id % 8 + 1 AS DECIMAL(6,1)) AS scheduled_hours, CAST(user_id % 10 + 15 AS DECIMAL(6,2)) AS hourly_rate, CAST((event_id % 8 + 1) * 0.1 AS DECIMAL(8,2)) AS vacation_accrued, CAST(CASE WHEN event_id % 13 = 0 THEN event_id % 8 + 1 ELSE 0 END AS DECIMAL(8,1)) AS vacation_used FROM ev)"


@query("mrt27_allocated_sales", f"""{EV}, {SHIFTS}, d AS (SELECT store_id, day, sum(value) AS s FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2), g AS (SELECT store_id, day, shift_name, sum(scheduled_hours) AS h FROM shifts GROUP BY 1, 2, 3)
SELECT store_id, CAST(day AS VARCHAR) AS day, shift_name, CAST(h AS DOUBLE) AS hours, {fx("CAST(s AS DOUBLE) * CAST(h AS DOUBLE) / CAST(sum(h) OVER (PARTITION BY store_id, day) AS DOUBLE)", 4)} AS allocated_sales FROM g LEFT JOIN d USING (store_id, day)""")
def _(spark, sf):
    g = inputs.shifts(spark, sf).groupBy("store_id", "day", "shift_name").agg(F.sum("scheduled_hours").alias("h"))
    d = retail.event_days(spark, sf).where("event_type = 'purchase'").groupBy("store_id", "day").agg(F.sum("value").alias("s"))
    out = fi.allocate(g, d, "s", "h", ["store_id", "day"], "a")
    return out.select("store_id", F.col("day").cast("string").alias("day"), "shift_name", F.col("h").cast("double").alias("hours"), fixed(F.col("a"), 4).alias("allocated_sales"))


def tender(spark, sf):
    day = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id", "sale_date", "yyyymm").agg(F.sum("sales").alias("day_sales"), F.sum(F.when(F.col("promo_type") == "O", F.col("discount"))).alias("gift_used"))
    weight = (F.col("day_sales") * (F.col("store_id") % 51 + 50).cast("decimal(4,0)")).cast("decimal(28,4)")
    return fi.tender_daily(day, weight, day.agg(F.sum("gift_used").alias("total")))


MIX = {"Cash": ("Cash", 22, 0), "Debit": ("Card", 28, 0), "Credit Visa": ("Card", 24, 1.5), "Credit Mastercard": ("Card", 16, 1.6), "Credit Amex": ("Card", 4, 2.4), "Mobile Wallet": ("Card", 6, 1.5)}
TENDER = f"""td AS (SELECT store_id, sale_date, yyyymm, sum(sales) AS day_sales, sum(CASE WHEN promo_type = 'O' THEN discount END) AS gu FROM sales_lines GROUP BY 1, 2, 3),
tw AS (SELECT *, day_sales * CAST(store_id % 51 + 50 AS DECIMAL(4,0)) AS w FROM td), tk AS (SELECT CAST(sum(gu) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS k FROM tw),
tb AS (SELECT *, CAST(w AS DOUBLE) * k AS gift, greatest(0.0::DOUBLE, CAST(day_sales AS DOUBLE) - CAST(w AS DOUBLE) * k) AS rem FROM tw, tk),
tl AS (SELECT store_id, sale_date, yyyymm, 'Gift Card' AS tender_type, 'Stored Value' AS tender_group, gift AS a, 0.0::DOUBLE AS fee FROM tb UNION ALL {" UNION ALL ".join(f"SELECT store_id, sale_date, yyyymm, '{t}', '{g}', rem * {w}.0::DOUBLE / 100.0::DOUBLE, {f}::DOUBLE FROM tb" for t, (g, w, f) in MIX.items())}),
tender AS (SELECT store_id, sale_date, yyyymm, tender_type, tender_group, {fx("a", 2)} AS amount, {fx("a * fee / 100.0::DOUBLE", 2)} AS processing_fee FROM tl WHERE a > 0.005),
dt AS (SELECT yyyymm, tender_group, tender_type, sum(CAST(amount AS DECIMAL(18,2))) AS amount, sum(CAST(processing_fee AS DECIMAL(18,2))) AS processing_fee FROM tender GROUP BY 1, 2, 3)"""


@query("mrt28_scaled_tender_split", f"{L}, {TENDER} SELECT store_id, CAST(sale_date AS VARCHAR) AS sale_date, yyyymm, tender_type, tender_group, amount, processing_fee FROM tender")
def _(spark, sf):
    return tender(spark, sf).withColumn("sale_date", F.col("sale_date").cast("string"))


@query("mrt29_tender_months", f"{L}, {TENDER} SELECT yyyymm, tender_group, tender_type, CAST(amount AS DOUBLE) AS amount, CAST(processing_fee AS DOUBLE) AS processing_fee FROM dt")
def _(spark, sf):
    return fi.dash_tender(tender(spark, sf))


@query("mrt29_cashless_share", f"{L}, {TENDER} SELECT yyyymm, {spct('''sum(CASE WHEN tender_group <> 'Cash' THEN amount ELSE 0 END)''', 'sum(amount)')} AS cashless_pct FROM dt GROUP BY 1")
def _(spark, sf):
    return fi.cashless_share(fi.dash_tender(tender(spark, sf)))


INV = f"""inv AS (SELECT 'INV-' || txn_id AS invoice_number, sid AS supplier_id, region, sale_date AS invoice_date, 'Net ' || tm AS payment_terms, sale_date + CAST(tm AS INTEGER) AS due_date, pc AS paid_calc, CAST(round(amt, 2) AS DOUBLE) AS amount
 FROM (SELECT txn_id, sum(sales) AS amt, max(ship_date) AS pc, min(supplier_id) AS sid FROM raw_lines GROUP BY 1) a JOIN (SELECT *, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 30 WHEN priority = '3-MEDIUM' THEN 45 ELSE 60 END AS tm FROM headers) h USING (txn_id) JOIN stores USING (store_id)),
x AS (SELECT *, paid_calc <= DATE '2000-12-31' AS paid, date_diff('day', due_date, DATE '2000-12-31') AS late, date_diff('day', paid_calc, due_date) >= 10 AS early FROM inv WHERE invoice_date <= DATE '2000-12-31'),
aged AS (SELECT invoice_number, supplier_id, region, year(invoice_date) * 100 + month(invoice_date) AS invoice_yyyymm, payment_terms, CAST(due_date AS VARCHAR) AS due_date, amount, {fx("CASE WHEN paid AND early THEN amount * 0.02::DOUBLE ELSE 0.0::DOUBLE END", 2)} AS discount_taken,
 CASE WHEN paid THEN 0.0::DOUBLE ELSE amount END AS balance, CASE WHEN paid THEN 'Paid' WHEN late <= 0 THEN 'Open' ELSE 'Overdue' END AS status, CASE WHEN paid THEN date_diff('day', invoice_date, paid_calc) END AS days_to_pay, CASE WHEN NOT paid AND late > 0 THEN late ELSE 0 END AS days_overdue,
 CASE WHEN paid THEN 'Paid' WHEN late <= 0 THEN 'Current' WHEN late <= 30 THEN '1-30 days' WHEN late <= 60 THEN '31-60 days' ELSE '60+ days' END AS aging_bucket, CASE WHEN NOT paid THEN 'Late' WHEN early THEN 'Early' WHEN paid_calc <= due_date THEN 'On time' ELSE 'Late' END AS payer_profile FROM x)"""


def aged(spark, sf):
    return fi.aging(inputs.invoices(spark, sf), inputs.AS_OF_DATE)


@query("mrt30_invoice_aging", f"{L}, {INV} SELECT * FROM aged")
def _(spark, sf):
    return aged(spark, sf)


AR = f"""ff AS (SELECT 'FF-' || store_id || '-' || yyyymm AS invoice_number, store_id, region, yyyymm, month_end AS invoice_date, month_end + 15 AS due_date, {fx('(royalty_fee + marketing_fee)')} AS total_invoiced,
 (SELECT min(h.sale_date) FROM headers h WHERE h.store_id = pnl.store_id AND h.priority = '1-URGENT' AND h.sale_date > month_end) AS paid_calc FROM pnl JOIN months USING (yyyymm) WHERE {fx('(royalty_fee + marketing_fee)')} > 0),
fx0 AS (SELECT *, coalesce(paid_calc <= DATE '2000-12-31', FALSE) AS paid, date_diff('day', due_date, DATE '2000-12-31') AS late FROM ff WHERE invoice_date <= DATE '2000-12-31'),
ar AS (SELECT invoice_number, store_id, region, yyyymm, CAST(CAST(due_date AS DATE) AS VARCHAR) AS due_date, CASE WHEN paid THEN CAST(paid_calc AS VARCHAR) END AS paid_date, total_invoiced, CASE WHEN paid THEN total_invoiced ELSE 0.0::DOUBLE END AS amount_paid, CASE WHEN paid THEN 0.0::DOUBLE ELSE total_invoiced END AS balance,
 CASE WHEN paid THEN 'Paid' WHEN late <= 0 THEN 'Open' ELSE 'Overdue' END AS status, CASE WHEN paid AND paid_calc > due_date THEN date_diff('day', due_date, paid_calc) ELSE 0 END AS days_paid_late, CASE WHEN NOT paid AND late > 0 THEN late ELSE 0 END AS days_overdue,
 CASE WHEN paid THEN 'Paid' WHEN late <= 0 THEN 'Current' WHEN late <= 30 THEN '1-30 days' WHEN late <= 60 THEN '31-60 days' ELSE '60+ days' END AS aging_bucket FROM fx0)"""


def receivables(spark, sf):
    return fi.fee_aging(fi.fee_invoices(pnl(spark, sf), inputs.fee_payments(spark, sf), retail.months(spark, sf)), inputs.AS_OF_DATE)


@query("mrt30_fee_receivables", f"{LTM}, {PNL}, {AR} SELECT * FROM ar")
def _(spark, sf):
    return receivables(spark, sf)


@query("mrt30_open_receivables", f"""{LTM}, {PNL}, {AR} SELECT aging_bucket, CASE aging_bucket WHEN 'Current' THEN 1 WHEN '1-30 days' THEN 2 WHEN '31-60 days' THEN 3 ELSE 4 END AS ord, count(*) AS invoices, {m('sum(CAST(balance AS DECIMAL(18,2)))')} AS balance
FROM ar WHERE status <> 'Paid' AND yyyymm <= 200012 GROUP BY 1, 2""")
def _(spark, sf):
    return fi.open_by_bucket(receivables(spark, sf), 200012)


@query("mrt31_days_payable", f"{L}, {INV} SELECT payment_terms, {div('sum(days_to_pay)', 'count(*)', 1)} AS dpo_days FROM aged WHERE status = 'Paid' GROUP BY 1")
def _(spark, sf):
    return fi.dpo(aged(spark, sf))


@query("mrt31_payment_run", f"""{L}, {INV} SELECT supplier_id, payment_terms, count(*) AS invoices, {m('sum(CAST(balance AS DECIMAL(18,2)))')} AS due_amount, {fx("CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) * 0.02::DOUBLE", 2)} AS discount_available, min(due_date) AS earliest_due FROM aged
WHERE status <> 'Paid' AND due_date > '2000-12-31' AND due_date <= '2001-01-14' AND payment_terms IN (SELECT payment_terms FROM aged WHERE discount_taken > 0) GROUP BY 1, 2""")
def _(spark, sf):
    return fi.payment_run(aged(spark, sf), inputs.AS_OF_DATE)


def tax(spark, sf):
    return fi.tax_monthly(retail.sales_lines(spark, sf), rates(spark), F.col("category").isin("STANDARD", "ECONOMY", "SMALL"))


TAX = f"""{RATES_SQL}, tl0 AS (SELECT store_id, region, yyyymm, sum(CASE WHEN category IN ('STANDARD', 'ECONOMY', 'SMALL') THEN sales ELSE 0 END) AS t, sum(CASE WHEN category IN ('STANDARD', 'ECONOMY', 'SMALL') THEN 0 ELSE sales END) AS z FROM sales_lines GROUP BY 1, 2, 3),
tr AS (SELECT *, (SELECT r.rate FROM rates r WHERE r.region = tl0.region AND r.effective_from <= make_date(yyyymm // 100, yyyymm % 100, 1) ORDER BY r.effective_from DESC LIMIT 1) AS rate FROM tl0),
tax AS (SELECT store_id, region, yyyymm, {m('t')} AS taxable_sales, {m('z')} AS zero_rated_sales, {spct('t', 't + z')} AS taxable_share_pct, rate, {fx(m('t') + " * rate / 100.0::DOUBLE", 2)} AS total_tax FROM tr)"""


@query("mrt34_sales_tax", f"{L}, {TAX} SELECT * FROM tax")
def _(spark, sf):
    return tax(spark, sf)


@query("mrt32_treasury_kpi", f"""{LTM}, {CM}, {FLOWS}, {TENDER}, {INV}, {TAX}, {PNL}, {AR}
SELECT (SELECT {m('sum(CAST(balance AS DECIMAL(18,2)))')} FROM ar WHERE status <> 'Paid' AND yyyymm <= 200006) AS ar_balance, (SELECT {m('sum(CAST(balance AS DECIMAL(18,2)))')} FROM ar WHERE aging_bucket = '60+ days' AND yyyymm <= 200006) AS ar_aged_60,
(SELECT {m('sum(CAST(balance AS DECIMAL(18,2)))')} FROM aged WHERE status <> 'Paid' AND invoice_yyyymm <= 200006) AS ap_balance, (SELECT {m('sum(CAST(balance AS DECIMAL(18,2)))')} FROM aged WHERE aging_bucket = '60+ days' AND invoice_yyyymm <= 200006) AS ap_aged_60,
(SELECT {spct("count(*) FILTER (WHERE payer_profile IN ('Early', 'On time'))", 'count(*)', 1)} FROM aged WHERE status = 'Paid' AND invoice_yyyymm <= 200006) AS ap_on_time_pct,
(SELECT {spct("sum(CASE WHEN tender_group <> 'Cash' THEN amount ELSE 0 END)", 'sum(amount)')} FROM dt WHERE yyyymm = 200006) AS cashless_pct, (SELECT {m('sum(CAST(total_tax AS DECIMAL(18,2)))')} FROM tax WHERE yyyymm BETWEEN 200001 AND 200006) AS tax_ytd,
(SELECT CAST(sum(closing_balance) AS DOUBLE) FROM bal WHERE yyyymm = 200006) AS liability_total""")
def _(spark, sf):
    bal = fi.rollforward(point_flows(spark, sf).withColumn("all", F.lit(0)), ["all"], "yyyymm", "points_in", "points_out")
    return fi.treasury_kpi(aged(spark, sf), receivables(spark, sf), fi.dash_tender(tender(spark, sf)), tax(spark, sf), bal, 200006)


@query("mrt33_price_history", f"""{L}, g AS (SELECT plu, yyyymm, CAST(max(unit_cost) AS DOUBLE) AS cp, CAST(sum(regular_value) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS rp, CAST(sum(sales) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS sp, {n('sum(quantity)')} AS units, {m('sum(sales)')} AS sales, count(DISTINCT store_id) AS stores_selling FROM sales_lines GROUP BY 1, 2)
SELECT plu, yyyymm, {fx("cp", 4)} AS cost_price, {fx("rp", 4)} AS regular_price, {fx("sp", 4)} AS selling_price, units, sales, stores_selling, {fx("rp - cp", 4)} AS price_cost_spread, {spct('sp - cp', 'sp')} AS margin_pct_realised,
{spct('cp - lag(cp) OVER w', 'lag(cp) OVER w')} AS cost_price_change_pct, {spct('rp - lag(rp) OVER w', 'lag(rp) OVER w')} AS regular_price_change_pct, {spct('sp - lag(sp) OVER w', 'lag(sp) OVER w')} AS selling_price_change_pct FROM g WINDOW w AS (PARTITION BY plu ORDER BY yyyymm)""")
def _(spark, sf):
    return fi.pricebook(retail.sales_lines(spark, sf, store=False))


ASSET = f"""sa AS (SELECT store_id, any_value(s.region) AS region, min(sale_date) AS open_date, any_value(square_feet) * 55.0::DOUBLE AS lc, any_value(square_feet) * 30.0::DOUBLE AS qc, 5 + store_id % 6 AS ly FROM sales_lines l JOIN stores s USING (store_id) GROUP BY 1),
sb AS (SELECT *, date_diff('day', open_date, DATE '2001-08-01') AS days_open FROM sa),
assets AS (SELECT store_id, region, days_open, {fx("lc / 120.0::DOUBLE", 2)} AS leasehold_monthly, {fx("qc / 84.0::DOUBLE", 2)} AS equipment_monthly, {fx("greatest(0.0::DOUBLE, lc * (1.0::DOUBLE - CAST(days_open AS DOUBLE) / 30.44::DOUBLE / 120.0::DOUBLE)) + greatest(0.0::DOUBLE, qc * (1.0::DOUBLE - CAST(days_open AS DOUBLE) / 30.44::DOUBLE / 84.0::DOUBLE))", 2)} AS net_book_value,
 CAST(open_date + CAST(ly * 365 AS INTEGER) AS VARCHAR) AS lease_expiry FROM sb)"""


def assets(spark, sf):
    opened = retail.sales_lines(spark, sf, product=False, store=False).groupBy("store_id").agg(F.min("sale_date").alias("open_date"))
    s = retail.stores(spark, sf).join(opened, "store_id")
    s = s.select("store_id", "region", "open_date", (F.col("square_feet") * 55).alias("leasehold_cost"), (F.col("square_feet") * 30).alias("equipment_cost"), (F.col("store_id") % 6 + 5).alias("lease_years"))
    return fi.assets(s, "2001-08-01")


@query("mrt35_store_assets", f"{L}, {ASSET} SELECT * FROM assets")
def _(spark, sf):
    return assets(spark, sf)


@query("mrt35_lease_expiry", f"{L}, {ASSET} SELECT year(CAST(lease_expiry AS DATE)) AS expiry_year, count(*) AS stores FROM assets GROUP BY 1")
def _(spark, sf):
    return fi.lease_expiry(assets(spark, sf))
