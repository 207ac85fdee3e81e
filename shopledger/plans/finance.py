"""Finance marts (MRT-22..35)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import fixed, money, nonzero, norm_blank, pct, safe_div, yyyymm
from shopledger.operators.joins import asof_join, with_scalars
from shopledger.operators.reshape import to_ledger
from shopledger.operators.windows import pct_change, running_sum

ONE = "*"
# Mean temperature by month, the chart of accounts, tender mix.
MONTH_TEMP = [-6.0, -5.0, 0.0, 7.0, 13.0, 18.0, 22.0, 21.0, 16.0, 9.0, 3.0, -3.0]
TENDERS = [
    ("cash", "Cash", "Cash", 22.0, 0.0, 0.0), ("debit", "Debit", "Card", 28.0, 0.0, 0.06), ("visa", "Credit Visa", "Card", 24.0, 1.5, 0.0),
    ("mc", "Credit Mastercard", "Card", 16.0, 1.6, 0.0), ("amex", "Credit Amex", "Card", 4.0, 2.4, 0.0), ("mobile", "Mobile Wallet", "Card", 6.0, 1.5, 0.0),
]


def store_pnl(sales: DataFrame, shrink: DataFrame, delivery: DataFrame, rates: DataFrame) -> DataFrame:
    """MRT-22: monthly profit statement of each store.

    ``sales`` has net_sales, returns_value, cogs, transactions, units,
    subsidy and labour_cost per store and month; ``shrink`` and ``delivery``
    are per store-month; ``rates`` has one row of rates per store.  Costs that
    depend on size, weather or sales are expressions over those columns.
    """
    base = sales.join(shrink, ["store_id", "yyyymm"], "left").join(delivery, ["store_id", "yyyymm"], "left").join(rates, "store_id")
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    temp = F.element_at(F.array(*[F.lit(t) for t in MONTH_TEMP]), (F.col("yyyymm") % 100).cast("int"))
    ns, labour = d("net_sales"), d("labour_cost")
    c = base.select(
        "store_id", "region", "store_format", "yyyymm", ns.alias("net_sales"), d("returns_value").alias("returns_value"), d("cogs").alias("cogs"),
        "transactions", "units", d("subsidy").alias("promo_subsidy_income"), labour.alias("labour_cost"),
        (labour * F.col("labour_burden_pct") / F.lit(100.0)).alias("labour_burden"),
        (F.col("square_feet") * F.col("occupancy_rate") / F.lit(12.0)).alias("occupancy_cost"),
        (F.col("square_feet") * F.col("utilities_base") * (F.lit(1.0) + F.lit(0.025) * F.greatest(F.lit(0.0), F.lit(12.0) - temp) + F.lit(0.02) * F.greatest(F.lit(0.0), temp - F.lit(20.0)))).alias("utilities_cost"),
        d("shrinkage_cost").alias("shrinkage_cost"),
        F.greatest(F.lit(0.0), d("delivery_value") * F.lit(0.2) - d("delivery_orders") * F.lit(5.0)).alias("delivery_partner_cost"),
        (ns * F.lit(0.012)).alias("card_processing_fees"), (ns * F.col("other_opex_pct") / F.lit(100.0)).alias("other_opex"),
        (ns * F.col("royalty_rate_pct") / F.lit(100.0)).alias("royalty_fee"), (ns * F.col("marketing_fee_pct") / F.lit(100.0)).alias("marketing_fee"),
        "square_feet",
    )
    x = {k: F.col(k) for k in c.columns}
    opex = x["labour_cost"] + x["labour_burden"] + x["occupancy_cost"] + x["utilities_cost"] + x["shrinkage_cost"] + x["delivery_partner_cost"] + x["card_processing_fees"] + x["other_opex"]
    t = c.withColumn("gross_margin", x["net_sales"] - x["cogs"]).withColumn("total_store_opex", opex).withColumn("franchise_fees", x["royalty_fee"] + x["marketing_fee"])
    t = t.withColumn("four_wall_ebitda", F.col("gross_margin") + x["promo_subsidy_income"] - F.col("total_store_opex"))
    return t.withColumn("store_contribution", F.col("four_wall_ebitda") - F.col("franchise_fees"))


def budget_vs_actual(budget: DataFrame, pnl: DataFrame) -> DataFrame:
    """MRT-23: plan beside actual, variances and on-plan flags."""
    j = budget.join(pnl, ["store_id", "yyyymm"])
    ns, bn = F.col("net_sales"), F.col("budget_net_sales")
    ox, bo = F.col("total_store_opex") + F.col("franchise_fees"), F.col("budget_total_opex")
    sc, bs = F.col("store_contribution"), F.col("budget_store_contribution")
    r = lambda c: fixed(c, 2)
    return j.select(
        "store_id", "region", "yyyymm", "budget_version", r(ns).alias("actual_net_sales"), r(bn).alias("budget_net_sales"), r(ns - bn).alias("sales_variance"), pct(ns - bn, bn).alias("sales_variance_pct"),
        r(ox).alias("actual_total_opex"), r(bo).alias("budget_total_opex"), r(ox - bo).alias("opex_variance"), r(sc).alias("actual_store_contribution"), r(sc - bs).alias("contribution_variance"),
        pct(sc - bs, F.abs(bs)).alias("contribution_variance_pct"),
        F.when(ns >= bn, "Y").otherwise("N").alias("sales_on_plan"), F.when(ox <= bo, "Y").otherwise("N").alias("opex_on_plan"),
    )


def attainment(targets: DataFrame, actuals: DataFrame) -> DataFrame:
    """MRT-24: actual over target per store-month."""
    j = targets.join(actuals, ["store_id", "yyyymm"], "left")
    a = F.coalesce(F.col("actual_sales"), F.lit(0)).cast("double")
    return j.select("store_id", "yyyymm", fixed(F.col("target_sales"), 2).alias("target_sales"), fixed(a, 2).alias("actual_sales"), pct(a, F.col("target_sales")).alias("attainment_pct"))


def gl_monthly(pnl: DataFrame, budget: DataFrame) -> DataFrame:
    """MRT-25: account-long ledger; a positive variance is favourable."""
    j = pnl.join(budget, ["store_id", "yyyymm"], "left")
    b = lambda c: F.col(f"budget_{c}")
    one = lambda c, s=1: {"amount": F.col(c) * F.lit(float(s)), "budget": b(c) * F.lit(float(s))}
    loaded = {"amount": -(F.col("labour_cost") + F.col("labour_burden")), "budget": -(b("labour_cost") + b("labour_burden"))}
    accounts = [
        ("4000", "Net Sales", "Revenue", one("net_sales")), ("4010", "Sales Returns", "Revenue", {"amount": F.col("returns_value"), "budget": F.lit(None)}),
        ("4100", "Promotion Subsidy Income", "Revenue", one("promo_subsidy_income")), ("5000", "Cost of Goods Sold", "COGS", one("cogs", -1)),
        ("6000", "Labour (loaded)", "Labour", loaded), ("6100", "Occupancy", "Occupancy", one("occupancy_cost", -1)), ("6110", "Utilities", "Occupancy", one("utilities_cost", -1)),
        ("6200", "Shrinkage", "Store Opex", one("shrinkage_cost", -1)), ("6210", "Delivery Partner Cost", "Store Opex", one("delivery_partner_cost", -1)),
        ("6220", "Card Processing Fees", "Store Opex", one("card_processing_fees", -1)), ("6230", "Other Operating Expense", "Store Opex", one("other_opex", -1)),
        ("7000", "Royalty Fee", "Franchise Fees", one("royalty_fee", -1)), ("7010", "Marketing Fee", "Franchise Fees", one("marketing_fee", -1)),
    ]
    g = to_ledger(j, ["store_id", "region", "yyyymm"], accounts)
    v = F.col("amount") - F.col("budget")
    return g.select(
        "store_id", "region", "yyyymm", "account_code", "account_name", "account_group", fixed(F.col("amount"), 2).alias("amount"), fixed(F.col("budget"), 2).alias("budget"),
        fixed(v, 2).alias("variance"), F.when(v >= 0, "Y").when(F.col("budget").isNotNull(), "N").alias("favourable"),
    )


def rollforward(flows: DataFrame, keys: list[str], t: str, plus: str, minus: str) -> DataFrame:
    """MRT-26: opening + in - out = closing, from running sums per key."""
    net = flows.withColumn("_net", F.col(plus) - F.col(minus))
    out = running_sum(net, keys, t, "_net", "closing_balance")
    return out.withColumn("opening_balance", F.col("closing_balance") - F.col("_net")).drop("_net")


def allocate(df: DataFrame, totals: DataFrame, total: str, weight: str, keys: list[str], out: str) -> DataFrame:
    """MRT-27: a group total split over its rows by weight."""
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    j = df.join(sums, keys).join(totals, keys, "left")
    share = F.col(total).cast("double") * F.col(weight).cast("double") / nonzero(F.col("_w").cast("double"))
    return j.withColumn(out, share).drop("_w")


def tender_daily(day: DataFrame, gift_weight: Column, gift_total: DataFrame) -> DataFrame:
    """MRT-28: gift weights scaled to a control total, the remainder of each
    day split over tenders by a normalised mix, one row per tender."""
    w = day.withColumn("_w", gift_weight)
    wsum = w.agg(F.sum("_w").cast("double").alias("s")).scalar()
    total = gift_total.select(F.col("total").cast("double").alias("t")).scalar()
    b = w.withColumn("gift", F.col("_w").cast("double") * (total / wsum))
    b = b.withColumn("remainder", F.greatest(F.lit(0.0), F.col("day_sales").cast("double") - F.col("gift")))
    names = ("tender_type", "tender_group", "share", "fee")
    kinds = [("Gift Card", "Stored Value", None, 0.0), *[(t[1], t[2], t[3], t[4]) for t in TENDERS]]
    rows = F.array(*[F.struct(*[F.lit(v).cast("double" if k in ("share", "fee") else "string").alias(k) for k, v in zip(names, kind)]) for kind in kinds])
    mix = sum(t[3] for t in TENDERS)
    long = b.select("store_id", "sale_date", "yyyymm", "gift", "remainder", F.inline(rows))
    amount = F.when(F.col("share").isNull(), F.col("gift")).otherwise(F.col("remainder") * F.col("share") / F.lit(mix))
    out = long.withColumn("raw", amount).where("raw > 0.005")
    return out.select(
        "store_id", "sale_date", "yyyymm", "tender_type", "tender_group", fixed(F.col("raw"), 2).alias("amount"),
        fixed(F.col("raw") * F.col("fee") / F.lit(100.0), 2).alias("processing_fee"),
    )


def dash_tender(tender: DataFrame) -> DataFrame:
    """MRT-29: month x tender with fee; rows are summed as decimals."""
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return tender.groupBy("yyyymm", "tender_group", "tender_type").agg(money(dec("amount")).alias("amount"), money(dec("processing_fee")).alias("processing_fee"))


def cashless_share(dash: DataFrame) -> DataFrame:
    """MRT-29: cashless share by month."""
    a = F.col("amount").cast("decimal(18,2)")
    return dash.groupBy("yyyymm").agg(pct(F.sum(F.when(F.col("tender_group") != "Cash", a).otherwise(F.lit(0))), F.sum(a)).alias("cashless_pct"))


def aging(invoices: DataFrame, as_of: str) -> DataFrame:
    """MRT-30: status, days and aging bucket of every invoice at one date."""
    day = F.lit(as_of).cast("date")
    paid = F.col("paid_calc") <= day
    late = F.datediff(day, F.col("due_date"))
    due = F.col("due_date")
    early = F.datediff(due, F.col("paid_calc")) >= 10
    inv = invoices.where(F.col("invoice_date") <= day)
    amount = F.round("amount", 2).cast("double")
    disc = F.when(paid & early, amount * F.lit(0.02)).otherwise(F.lit(0.0))
    return inv.select(
        "invoice_number", "supplier_id", "region", yyyymm(F.col("invoice_date")).alias("invoice_yyyymm"), "payment_terms", due.cast("string").alias("due_date"), amount.alias("amount"),
        fixed(disc, 2).alias("discount_taken"), F.when(paid, F.lit(0.0)).otherwise(amount).alias("balance"),
        F.when(paid, "Paid").when(due >= day, "Open").otherwise("Overdue").alias("status"),
        F.when(paid, F.datediff("paid_calc", "invoice_date")).alias("days_to_pay"), F.when(~paid & (due < day), late).otherwise(0).alias("days_overdue"),
        F.when(paid, "Paid").when(due >= day, "Current").when(late <= 30, "1-30 days").when(late <= 60, "31-60 days").otherwise("60+ days").alias("aging_bucket"),
        F.when(~paid, "Late").when(early, "Early").when(F.col("paid_calc") <= due, "On time").otherwise("Late").alias("payer_profile"),
    )


def fee_invoices(pnl: DataFrame, payments: DataFrame, months: DataFrame, grace_days: int = 15) -> DataFrame:
    """MRT-30: one receivable for each store and month with a franchise fee, invoiced at the month's end.

    It is paid on the store's first payment day after the invoice. Payment days
    are brought to the first of each month, so the look ahead sees months, not days.
    """
    by_month = payments.groupBy("store_id", yyyymm(F.col("pay_date")).alias("yyyymm")).agg(F.min("pay_date").alias("_first"))
    fees = pnl.groupBy("store_id", "region", "yyyymm").agg(F.sum("royalty_fee").alias("royalty_fee"), F.sum("marketing_fee").alias("marketing_fee"))
    later = Window.partitionBy("store_id").orderBy("yyyymm").rowsBetween(1, Window.unboundedFollowing)
    both = fees.join(by_month, ["store_id", "yyyymm"], "full").withColumn("paid_calc", F.min("_first").over(later))
    total = fixed(F.col("royalty_fee") + F.col("marketing_fee"), 2)
    due = both.join(months.select("yyyymm", "month_end"), "yyyymm").withColumn("total_invoiced", total).where("total_invoiced > 0")
    return due.select(
        F.concat_ws("-", F.lit("FF"), F.col("store_id").cast("string"), F.col("yyyymm").cast("string")).alias("invoice_number"), "store_id", "region", "yyyymm",
        F.col("month_end").alias("invoice_date"), F.date_add("month_end", grace_days).alias("due_date"), "paid_calc", "total_invoiced",
    )


def fee_aging(fees: DataFrame, as_of: str) -> DataFrame:
    """MRT-30: status, balance, days and aging bucket of every receivable at one date."""
    day = F.lit(as_of).cast("date")
    paid = F.coalesce(F.col("paid_calc") <= day, F.lit(False))
    due, total = F.col("due_date"), F.col("total_invoiced")
    late = F.datediff(day, due)
    return fees.where(F.col("invoice_date") <= day).select(
        "invoice_number", "store_id", "region", "yyyymm", due.cast("string").alias("due_date"), F.when(paid, F.col("paid_calc")).cast("string").alias("paid_date"), "total_invoiced",
        F.when(paid, total).otherwise(F.lit(0.0)).alias("amount_paid"), F.when(paid, F.lit(0.0)).otherwise(total).alias("balance"),
        F.when(paid, "Paid").when(due >= day, "Open").otherwise("Overdue").alias("status"),
        F.when(paid & (F.col("paid_calc") > due), F.datediff("paid_calc", due)).otherwise(0).alias("days_paid_late"), F.when(~paid & (due < day), late).otherwise(0).alias("days_overdue"),
        F.when(paid, "Paid").when(due >= day, "Current").when(late <= 30, "1-30 days").when(late <= 60, "31-60 days").otherwise("60+ days").alias("aging_bucket"),
    )


def open_by_bucket(receivables: DataFrame, ym: int) -> DataFrame:
    """MRT-30: open receivables by aging bucket, in the order of their age."""
    order = F.when(F.col("aging_bucket") == "Current", 1).when(F.col("aging_bucket") == "1-30 days", 2).when(F.col("aging_bucket") == "31-60 days", 3).otherwise(4)
    open_ = receivables.where((F.col("status") != "Paid") & (F.col("yyyymm") <= ym))
    return open_.groupBy("aging_bucket", order.alias("ord")).agg(F.count(ONE).alias("invoices"), money(F.sum(F.col("balance").cast("decimal(18,2)"))).alias("balance"))


def dpo(aged: DataFrame) -> DataFrame:
    """MRT-31: days payable outstanding by terms."""
    return aged.where("status = 'Paid'").groupBy("payment_terms").agg(safe_div(F.sum("days_to_pay"), F.count(ONE), 1).alias("dpo_days"))


def payment_run(aged: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """MRT-31: what falls due in the next days, with the discount on offer."""
    rate = aged.where("discount_taken > 0").groupBy("payment_terms").agg(F.max(F.lit(0.02)).alias("rate"))
    due = F.to_date("due_date")
    lo = F.lit(as_of).cast("date")
    open_ = aged.where((F.col("status") != "Paid") & (due > lo) & (due <= F.date_add(lo, days)))
    total = F.sum(F.col("balance").cast("decimal(18,2)"))
    return open_.join(rate, "payment_terms").groupBy("supplier_id", "payment_terms").agg(
        F.count(ONE).alias("invoices"), money(total).alias("due_amount"), fixed(total.cast("double") * F.max("rate"), 2).alias("discount_available"), F.min("due_date").alias("earliest_due"),
    )


def treasury_kpi(aged: DataFrame, receivables: DataFrame, dash: DataFrame, tax: DataFrame, liability: DataFrame, ym: int) -> DataFrame:
    """MRT-32: one row from several one-row aggregates, as scalar subqueries."""
    owing = lambda c: money(F.sum(F.when(c, F.col("balance").cast("decimal(18,2)"))))
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    to_date = aged.where(F.col("invoice_yyyymm") <= ym)
    one = to_date.agg(
        owing(F.col("status") != "Paid").alias("ap_balance"), owing(F.col("aging_bucket") == "60+ days").alias("ap_aged_60"),
        pct(F.count_if((F.col("status") == "Paid") & F.col("payer_profile").isin("Early", "On time")), F.count_if(F.col("status") == "Paid"), 1).alias("ap_on_time_pct"),
    )
    cash = cashless_share(dash).where(F.col("yyyymm") == ym).select(F.max("cashless_pct").alias("cashless_pct"))
    taxes = tax.where((F.col("yyyymm") <= ym) & (F.col("yyyymm") > ym // 100 * 100)).agg(money(dec("total_tax")).alias("tax_ytd"))
    owed = liability.where(F.col("yyyymm") == ym).agg(money(F.sum("closing_balance")).alias("liability_total"))
    fees = receivables.where(F.col("yyyymm") <= ym).agg(owing(F.col("status") != "Paid").alias("ar_balance"), owing(F.col("aging_bucket") == "60+ days").alias("ar_aged_60"))
    for part in (fees, cash, taxes, owed):
        one = with_scalars(one, part)
    return one


def pricebook(lines: DataFrame) -> DataFrame:
    """MRT-33: price history per product and month with changes to the month before."""
    q, reg = F.sum("quantity"), F.sum("regular_value")
    g = lines.groupBy("plu", "yyyymm").agg(
        F.max("unit_cost").cast("double").alias("cost_price"), safe_div(reg, q).alias("regular_price"), safe_div(F.sum("sales"), q).alias("selling_price"),
        q.alias("units"), money(F.sum("sales")).alias("sales"), F.countDistinct("store_id").alias("stores_selling"),
    )
    c = pct_change(g, ["plu"], "yyyymm", ["cost_price", "regular_price", "selling_price"])
    return c.select(
        "plu", "yyyymm", *[fixed(F.col(x), 4).alias(x) for x in ("cost_price", "regular_price", "selling_price")], "units", "sales", "stores_selling",
        fixed(F.col("regular_price") - F.col("cost_price"), 4).alias("price_cost_spread"),
        pct(F.col("selling_price") - F.col("cost_price"), F.col("selling_price")).alias("margin_pct_realised"),
        "cost_price_change_pct", "regular_price_change_pct", "selling_price_change_pct",
    )


def tax_monthly(lines: DataFrame, rates: DataFrame, taxable: Column) -> DataFrame:
    """MRT-34: taxable split, effective-dated rate and tax due per store-month."""
    s = F.col("sales")
    zero = F.lit(0).cast("decimal(18,4)")
    g = lines.groupBy("store_id", "region", "yyyymm", F.trunc("sale_date", "month").alias("month_start")).agg(
        F.sum(F.when(taxable, s).otherwise(zero)).alias("t"), F.sum(F.when(taxable, zero).otherwise(s)).alias("z")
    )
    r = asof_join(g, rates, "region", "month_start", "effective_from", "left")
    return r.select(
        "store_id", "region", "yyyymm", money(F.col("t")).alias("taxable_sales"), money(F.col("z")).alias("zero_rated_sales"),
        pct(F.col("t"), F.col("t") + F.col("z")).alias("taxable_share_pct"), "rate", fixed(F.round("t", 2).cast("double") * F.col("rate") / F.lit(100.0), 2).alias("total_tax"),
    )


def assets(stores: DataFrame, as_of: str) -> DataFrame:
    """MRT-35: straight-line depreciation, net book value and lease expiry."""
    open_days = F.datediff(F.lit(as_of).cast("date"), F.col("open_date"))
    lease, equip = F.col("leasehold_cost").cast("double"), F.col("equipment_cost").cast("double")
    months_open = open_days.cast("double") / F.lit(30.44)
    left = lambda cost, life: F.greatest(F.lit(0.0), cost * (F.lit(1.0) - months_open / F.lit(life)))
    return stores.select(
        "store_id", "region", open_days.alias("days_open"), fixed(lease / F.lit(120.0), 2).alias("leasehold_monthly"), fixed(equip / F.lit(84.0), 2).alias("equipment_monthly"),
        fixed(left(lease, 120.0) + left(equip, 84.0), 2).alias("net_book_value"), F.date_add("open_date", (F.col("lease_years") * 365).cast("int")).cast("string").alias("lease_expiry"),
    )


def lease_expiry(a: DataFrame) -> DataFrame:
    """MRT-35: stores whose lease ends in each year."""
    return a.groupBy(F.year(F.to_date("lease_expiry")).alias("expiry_year")).agg(F.count(ONE).alias("stores"))
