"""The two model sets: point-of-sale lines, and the star-schema sample.

The names and expressions are fixed values of the semantic layer.
"""

from __future__ import annotations

from shopledger.plans.semantic import GRAINS, Model
from shopledger.sources import inputs, retail

REGULAR = "transaction_type = 'Regular Sale'"
LOYAL = "customer_number IS NOT NULL AND customer_number != '0'"
BY_STORE = ("store_region", "store_province", "store_name", "transaction_year")


# Columns that come from the product and the store table.
FROM_PRODUCT = {"product_description": "product_name AS product_description", "cost": "cost", "pricebook_cost": "unit_cost AS pricebook_cost"}
FROM_STORE = {"store_name": "store_name", "store_province": "province AS store_province", "store_region": "region AS store_region", "customer_fsa": "left(province, 3) AS customer_fsa"}


def _pos_rows(spark, folder, words=None, conditions=()):
    """All columns, or those of the tables that ``words`` name; the default
    sales filter among the conditions reaches the scan of the orders."""
    product = words is None or bool(words & set(FROM_PRODUCT))
    store = words is None or bool(words & set(FROM_STORE))
    df = retail.lines(spark, folder, product, store, (retail.SALE,) if REGULAR in conditions else ())
    dec = "decimal(18,4)"
    return df.selectExpr(
        "sale_date AS transaction_date", "CAST(txn_id AS string) AS transaction_unique_id", "store_id AS store_number", "CAST(customer_id AS string) AS customer_number", "CAST(plu AS string) AS plu",
        "promo_type AS promotion_type", "txn_type AS transaction_type", "quantity", "sales AS selling_price", "regular_value AS original_selling_price", "regular_value AS pricebook_regular_price",
        f"CAST(discount * 0.1 AS {dec}) AS subsidy", f"CAST(discount * 0.05 AS {dec}) AS marketing_subsidy", f"CAST(discount * 0.2 AS {dec}) AS expected_subsidy",
        f"CAST(0 AS {dec}) AS transaction_discount", "discount AS item_discount", f"CAST(0 AS {dec}) AS override_discount", "sales AS royalty_sales",
        "CASE WHEN promo_type <> '' THEN concat(promo_type, '-', year(sale_date)) ELSE '' END AS event_id",
        "CASE WHEN promo_type <> '' THEN concat(promo_type, '-', date_format(sale_date, 'yyyy-MM')) ELSE '' END AS extended_event_id", "line_number AS transaction_sequence", "txn_id AS transaction_number",
        "email_flag AS customer_email_flag", "date_format(sold_at, 'HH:mm:ss') AS transaction_time", f"CASE WHEN promo_type <> '' THEN sales ELSE CAST(0 AS {dec}) END AS pricebook_sale_price",
        *(FROM_PRODUCT.values() if product else ()), *(FROM_STORE.values() if store else ()),
    )


def pos_model() -> Model:
    """SEM-01..04: dimensions, measures and metrics of the point-of-sale lines."""
    m = Model("pos_transactions", _pos_rows, time="transaction_date", narrow=_pos_rows)
    for name, kind in (
        ("transaction_unique_id", "string"), ("store_number", "number"), ("store_province", "enum"), ("customer_number", "string"), ("product_description", "string"), ("event_id", "string"),
        ("pricebook_regular_price", "number"), ("transaction_type", "enum"), ("store_name", "string"), ("store_region", "enum"), ("customer_fsa", "string"), ("plu", "string"), ("promotion_type", "enum"),
        ("transaction_sequence", "number"), ("customer_email_flag", "number"), ("transaction_time", "string"), ("transaction_number", "number"), ("extended_event_id", "string"),
        ("pricebook_sale_price", "number"), ("pricebook_cost", "number"),
    ):
        m.dimension(name, kind=kind)
    m.dimension("transaction_date", kind="date", grains=GRAINS)
    m.dimension("day_of_week", "weekday(transaction_date) + 1", "number")
    m.dimension("hour_of_day", "CAST(substr(transaction_time, 1, 2) AS int)", "number")
    m.dimension("transaction_month", "month(transaction_date)", "number")
    m.dimension("transaction_year", "year(transaction_date)", "number")
    m.dimension("is_loyalty_customer", f"CASE WHEN {LOYAL} THEN true ELSE false END", "boolean")
    m.dimension("has_promotion", "CASE WHEN promotion_type IS NOT NULL AND promotion_type != '' THEN true ELSE false END", "boolean")
    m.dimension("is_return", "CASE WHEN transaction_type = 'Regular Return' THEN true ELSE false END", "boolean")

    def distinct_of(kind: str) -> str:
        return f"count(DISTINCT CASE WHEN transaction_type = '{kind}' THEN transaction_unique_id END)"

    tx = "count(DISTINCT transaction_unique_id)"
    # how the measures with distinct counts are made, each count at its own grain
    every = {"tx": ("transaction_unique_id", "true")}
    of_kind = {k: ("transaction_unique_id", f"transaction_type = '{kind}'") for k, kind in (("sale", "Regular Sale"), ("back", "Regular Return"), ("void", "Post Void TX"))}
    split = {
        "total_transactions": {"formula": "tx", "distinct": every}, "avg_basket_size": {"formula": "CAST(revenue AS double) / tx", "plain": {"revenue": "sum(selling_price)"}, "distinct": every},
        "total_unique_customers": {"formula": "buyers", "distinct": {"buyers": ("customer_number", "true")}},
        "void_transaction_count": {"formula": "void", "distinct": {"void": of_kind["void"]}}, "return_transaction_count": {"formula": "back", "distinct": {"back": of_kind["back"]}},
        "avg_items_per_transaction": {"formula": "n / nullif(CAST(tx AS double), 0.0D)", "plain": {"n": "count(*)"}, "distinct": every},
        "return_rate": {"formula": "back * 100.0D / nullif(sale, 0)", "distinct": {k: of_kind[k] for k in ("back", "sale")}}, "void_rate": {"formula": "void * 100.0D / nullif(sale, 0)", "distinct": {k: of_kind[k] for k in ("void", "sale")}},
    }
    for name, expr, unit in (
        ("price_reduction_amount", "sum(pricebook_regular_price) - sum(selling_price)", "CAD"), ("total_transactions", tx, "transactions"), ("total_quantity", "sum(quantity)", "units"),
        ("total_original_revenue", "sum(original_selling_price)", "CAD"), ("gross_profit", "sum(selling_price) - sum(cost)", "CAD"), ("total_subsidy", "sum(subsidy)", "CAD"),
        ("total_marketing_subsidy", "sum(marketing_subsidy)", "CAD"), ("total_override_discount", "sum(override_discount)", "CAD"),
        ("avg_basket_size", f"CAST(sum(selling_price) AS double) / {tx}", "CAD"), ("total_line_items", "count(*)", "line items"), ("total_revenue", "sum(selling_price)", "CAD"), ("total_cost", "sum(cost)", "CAD"),
        ("total_royalty_sales", "sum(royalty_sales)", "CAD"), ("total_expected_subsidy", "sum(expected_subsidy)", "CAD"), ("total_transaction_discount", "sum(transaction_discount)", "CAD"),
        ("total_item_discount", "sum(item_discount)", "CAD"), ("avg_selling_price", "CAST(sum(selling_price) AS double) / count(selling_price)", "CAD"), ("total_unique_customers", "count(DISTINCT customer_number)", "customers"),
        ("gross_margin_pct", "CAST(sum(selling_price) - sum(cost) AS double) / nullif(CAST(sum(selling_price) AS double), 0.0D) * 100", "%"),
        ("total_discount", "sum(transaction_discount) + sum(item_discount) + sum(override_discount)", "CAD"), ("void_transaction_count", distinct_of("Post Void TX"), "transactions"),
        ("loyalty_customer_revenue", f"sum(CASE WHEN {LOYAL} THEN selling_price ELSE 0 END)", "CAD"), ("return_transaction_count", distinct_of("Regular Return"), "transactions"),
        ("total_pricebook_regular_revenue", "sum(pricebook_regular_price)", "CAD"), ("avg_items_per_transaction", f"count(*) / nullif(CAST({tx} AS double), 0.0D)", "items"),
        ("return_rate", f"{distinct_of('Regular Return')} * 100.0D / nullif({distinct_of('Regular Sale')}, 0)", "%"), ("void_rate", f"{distinct_of('Post Void TX')} * 100.0D / nullif({distinct_of('Regular Sale')}, 0)", "%"),
    ):
        m.measure(name, expr, unit, **split.get(name, {}))
    by_month = (*BY_STORE, "transaction_month")
    by_site = ("store_name", "store_number", "store_province", "store_region", "transaction_year")
    by_item = ("plu", "product_description", "store_region", "transaction_year")
    slow = ("month", "quarter", "year")
    for name, measure, by, filters, grains in (
        ("pos_avg_basket_size", "avg_basket_size", BY_STORE, (REGULAR,), GRAINS), ("pos_gross_margin_pct", "gross_margin_pct", BY_STORE, (REGULAR,), GRAINS[1:]), ("pos_gross_profit", "gross_profit", BY_STORE, (REGULAR,), GRAINS),
        ("pos_loyalty_customer_revenue", "loyalty_customer_revenue", ("customer_number", "customer_fsa", "store_region", "transaction_year"), (REGULAR, LOYAL), slow),
        ("pos_loyalty_vs_anonymous", "total_revenue", ("is_loyalty_customer", "store_region", "transaction_year"), (REGULAR,), slow),
        ("pos_promotion_revenue", "total_revenue", ("promotion_type", "has_promotion", "event_id", "store_region", "transaction_year"), (REGULAR,), slow),
        ("pos_return_rate", "return_rate", BY_STORE, (), slow), ("pos_void_rate", "void_rate", BY_STORE, (), slow),
        ("pos_revenue_by_product", "total_revenue", by_item, (REGULAR,), slow), ("pos_units_by_product", "total_quantity", by_item, (REGULAR,), slow),
        ("pos_revenue_by_store", "total_revenue", by_site, (REGULAR,), slow), ("pos_transactions_by_store", "total_transactions", by_site, (REGULAR,), GRAINS[1:]),
        ("pos_total_discount", "total_discount", ("store_region", "store_province", "promotion_type", "transaction_year"), (REGULAR,), slow),
        ("pos_total_revenue", "total_revenue", by_month, (REGULAR,), GRAINS), ("pos_total_transactions", "total_transactions", by_month, (REGULAR,), GRAINS),
    ):
        m.metric(name, measure, by, filters, grains, m.measures[measure].unit)
    return m


def _sales_fact(spark, folder):
    return retail.sales_lines(spark, folder).selectExpr(
        "plu AS product_id", "customer_id", "sale_date AS the_date", "promo_type AS promotion_id", "store_id", "category AS product_family", "region AS sales_region",
        "sales AS store_sales", "cost AS store_cost", "quantity AS unit_sales", "txn_id",
    )


def star_models() -> dict[str, Model]:
    """SEM-11: sales, inventory, staff and store models of the star sample."""
    from shopledger.plans.stores import purchase_orders

    sales = Model("sales_fact", _sales_fact, time="the_date")
    for d in ("product_id", "customer_id", "promotion_id", "store_id", "product_family", "sales_region"):
        sales.dimension(d)
    sales.measure("total_store_sales", "sum(store_sales)").measure("total_store_cost", "sum(store_cost)").measure("total_unit_sales", "sum(unit_sales)")
    sales.measure("transaction_count", "count(DISTINCT txn_id)").measure("gross_profit", "sum(store_sales) - sum(store_cost)")
    sales.measure("gross_margin_pct", "CAST(sum(store_sales) - sum(store_cost) AS double) * 100 / nullif(CAST(sum(store_sales) AS double), 0.0D)")
    for x in list(sales.measures):
        sales.metric(f"retail_{x}", x, ("product_family", "sales_region", "store_id", "promotion_id"))
    stock = Model("inventory_fact", lambda s, f: purchase_orders(inputs.purchase_lines(s, f)))
    stock.dimension("store_id").dimension("supplier_id")
    stock.measure("total_units_ordered", "sum(ordered_units)").measure("total_units_shipped", "sum(received_units)")
    stock.measure("fulfillment_rate", "sum(received_units) * 100.0D / nullif(sum(ordered_units), 0)").measure("avg_supply_time", "sum(actual_lead_days) / CAST(count(*) AS double)")
    for x in list(stock.measures):
        stock.metric(f"warehouse_{x}", x, ("store_id", "supplier_id"))
    staff = Model("employee", inputs.shifts)
    staff.dimension("store_id").dimension("shift_name")
    staff.measure("total_employees", "count(DISTINCT employee_id)").measure("total_salary_paid", "sum(CAST(scheduled_hours * hourly_rate AS decimal(12,2)))")
    staff.measure("total_hours", "sum(scheduled_hours)")
    staff.calc("is_long_shift", "scheduled_hours > 7")
    staff.metric("hr_active_headcount", "total_employees", ("store_id", "shift_name")).metric("hr_salary", "total_salary_paid", ("store_id", "shift_name"))
    store = Model("store", retail.stores)
    store.dimension("region").dimension("store_format")
    store.measure("total_stores", "count(*)").measure("total_sqft", "sum(square_feet)")
    store.metric("retail_stores", "total_stores", ("region", "store_format")).metric("retail_sqft", "total_sqft", ("region", "store_format"))
    expense = Model("expense_fact", inputs.shrink_log)
    expense.dimension("store_id").dimension("reason")
    expense.measure("total_amount", "sum(shrink_value)").measure("expense_count", "count(*)")
    expense.prefilter("reason <> 'Admin error'")
    expense.metric("retail_total_store_expenses", "total_amount", ("store_id", "reason"))
    return {x.name: x for x in (sales, stock, staff, store, expense)}


def finance_models(sources) -> dict[str, Model]:
    """SEM-02, SEM-03: measures of the finance marts.  ``sources`` maps a model
    name to a builder of its rows: store_pnl, budget, gl, ap_invoices, tender, pricebook."""
    def dec(x: str) -> str:
        return f"sum(CAST({x} AS decimal(20,4)))"

    def ratio(a: str, b: str) -> str:
        return f"CAST({a} AS double) * 100 / nullif(CAST({b} AS double), 0.0D)"

    pnl = Model("store_pnl", sources["store_pnl"]).dimension("region").dimension("store_format").dimension("year", "floor(yyyymm / 100)", "number")
    for c in ("net_sales", "cogs", "gross_margin", "labour_cost", "occupancy_cost", "shrinkage_cost", "total_store_opex", "franchise_fees", "four_wall_ebitda", "store_contribution"):
        pnl.measure(f"total_{c}", dec(c), "CAD")
    pnl.measure("gross_margin_pct", ratio(dec("gross_margin"), dec("net_sales")), "%").measure("four_wall_margin_pct", ratio(dec("four_wall_ebitda"), dec("net_sales")), "%")
    pnl.measure("labour_pct_of_sales", ratio(dec("labour_cost + labour_burden"), dec("net_sales")), "%")
    gl = Model("gl", sources["gl"]).dimension("region").dimension("account_group").dimension("account_code")
    gl.measure("gl_amount", dec("amount"), "CAD").measure("gl_budget", dec("budget"), "CAD").measure("gl_variance", dec("variance"), "CAD")
    ap = Model("ap_invoices", sources["ap_invoices"]).dimension("region").dimension("payment_terms").dimension("aging_bucket")
    ap.measure("invoice_count", "count(*)").measure("invoiced_amount", dec("amount"), "CAD").measure("open_balance", dec("balance"), "CAD")
    ap.measure("days_payable", "sum(days_to_pay) / CAST(count(days_to_pay) AS double)", "days").measure("overdue_pct", ratio(dec("CASE WHEN status = 'Overdue' THEN balance ELSE 0 END"), dec("balance")), "%")
    tender = Model("tender", sources["tender"]).dimension("tender_group").dimension("tender_type").dimension("yyyymm", kind="number")
    tender.measure("tender_amount", dec("amount"), "CAD").measure("processing_fees", dec("processing_fee"), "CAD").measure("cashless_pct", ratio(dec("CASE WHEN tender_group <> 'Cash' THEN amount ELSE 0 END"), dec("amount")), "%")
    tender.measure("fee_rate_pct", ratio(dec("processing_fee"), dec("amount")), "%")
    book = Model("pricebook", sources["pricebook"]).dimension("yyyymm", kind="number").dimension("year", "floor(yyyymm / 100)", "number")
    weighted = lambda c: f"CAST({dec(c + ' * units')} AS double) / nullif(CAST(sum(units) AS double), 0.0D)"
    book.measure("plu_months", "count(*)").measure("total_units", "sum(units)").measure("avg_selling_price", weighted("selling_price"), "CAD").measure("avg_regular_price", weighted("regular_price"), "CAD")
    change = "CASE WHEN abs(regular_price_change_pct) < 50 THEN"
    book.measure("avg_price_change_pct", f"CAST({dec(change + ' regular_price_change_pct * units END')} AS double) / nullif(CAST(sum({change} units END) AS double), 0.0D)", "%")
    out = {}
    for model in (pnl, gl, ap, tender, book):
        for x in list(model.measures):
            model.metric(x, x, tuple(model.dimensions))
        out[model.name] = model
    return out
