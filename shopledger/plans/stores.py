"""Store, network, supply, labour and census marts (MRT-18, 36..39, 41..43, 46, 50)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import ceil_to, fixed, money, nonzero, pct, safe_div
from shopledger.operators.aggregates import argmax_of
from shopledger.operators.joins import below_group_mean, beside, theta_count
from shopledger.operators.reshape import union_all

ONE = "*"


def store_facts(lines: DataFrame, stores: DataFrame, days: int) -> DataFrame:
    """MRT-18: lifetime store figures, per square foot and per week."""
    per = lines.groupBy("store_id", "txn_id", "customer_id").agg(F.sum("sales").alias("s"), F.sum("cost").alias("c"), F.min("sale_date").alias("a"), F.max("sale_date").alias("b"))
    g = per.groupBy("store_id").agg(
        F.sum("s").alias("total_sales"), F.sum("c").alias("total_cost"), F.count(ONE).alias("total_transactions"), F.countDistinct("customer_id").alias("distinct_customers"),
        F.min("a").alias("open_date"), F.max("b").alias("last_sale_date"),
    )
    s = F.col("total_sales")
    return g.join(stores, "store_id").select(
        "store_id", "region", "store_format", "owner_id", "square_feet", "total_transactions", "distinct_customers", F.col("open_date").cast("string").alias("open_date"), F.col("last_sale_date").cast("string").alias("last_sale_date"),
        money(s).alias("total_sales"), pct(s - F.col("total_cost"), s).alias("margin_pct"), fixed(s.cast("double") * F.lit(7.0) / F.lit(float(days)), 2).alias("avg_weekly_sales"), safe_div(s, F.col("square_feet"), 2).alias("sales_per_sqft"),
    )


def owner_rollup(facts: DataFrame) -> DataFrame:
    """MRT-18: stores owned and sales by franchise owner."""
    return facts.groupBy("owner_id").agg(F.count(ONE).alias("stores_owned"), F.min("open_date").alias("first_store_open"), money(F.sum(F.col("total_sales").cast("decimal(18,2)"))).alias("total_sales"))


def inventory_metrics(stock: DataFrame) -> DataFrame:
    """MRT-36: velocity, days of supply, turns, GMROI, reorder point and status
    of each store-product position (units_90d, units, first and last day,
    on_hand, unit_cost, lead_days, case_size)."""
    life = F.greatest(F.lit(30), F.datediff("last_day", "first_day") + 1)
    v = F.when(F.col("units_90d") > 0, F.col("units_90d").cast("double") / F.lit(90.0)).otherwise(F.col("units").cast("double") / life.cast("double"))
    base = stock.withColumn("v", v)
    v, oh = F.col("v"), F.col("on_hand")
    base = base.withColumn("safety_stock", (v * F.lit(3.0) + F.lit(1.0)).cast("int")).withColumn("reorder_point", F.col("safety_stock") + (v * F.col("lead_days") + F.lit(0.5)).cast("int"))
    need = (v * F.lit(14.0) + F.lit(1.0)).cast("int")
    reorder = F.floor((need + F.col("case_size") - 1) / F.col("case_size")) * F.col("case_size")
    cost, retail = F.col("unit_cost").cast("double"), F.col("sales").cast("double") / F.col("units").cast("double")
    status = F.when(oh == 0, "Out of Stock").when(oh <= F.col("safety_stock"), "Critical").when(oh <= F.col("reorder_point"), "Reorder").when((v > 0) & (oh > v * 60), "Overstock").otherwise("In Stock")
    return base.select(
        "store_id", "plu", "category", "supplier_id", oh, "safety_stock", "reorder_point", reorder.cast("int").alias("reorder_qty"), "lead_days",
        fixed(v, 3).alias("avg_daily_units"), F.when(v > 0, fixed(oh / v, 1)).alias("days_of_supply"), F.when((oh > 0) & (v > 0), fixed(F.lit(365.0) * v / oh, 1)).alias("annual_turns"),
        F.when((oh > 0) & (cost > 0), fixed(F.lit(365.0) * v * (retail - cost) / (oh * cost), 2)).alias("gmroi"), status.alias("stock_status"),
    )


def reorder_list(inv: DataFrame, store: str = "All") -> DataFrame:
    """MRT-37: positions at or under their reorder point."""
    need = inv.where(F.col("on_hand") <= F.col("reorder_point"))
    if store != "All":
        need = need.where(F.col("store_id").cast("string") == store)
    return need.select("store_id", "plu", "category", "on_hand", "reorder_point", "reorder_qty", "days_of_supply", "stock_status")


def stock_share(inv: DataFrame) -> DataFrame:
    """MRT-37: share of each stock status within its category."""
    g = inv.groupBy("category", "stock_status").agg(F.count(ONE).alias("n"))
    t = g.groupBy("category").agg(F.sum("n").alias("t"))
    return g.join(t, "category").select("category", "stock_status", pct(F.col("n"), F.col("t")).alias("share_pct"))


def gmroi_by_category(inv: DataFrame) -> DataFrame:
    """MRT-37: mean GMROI of each category."""
    return inv.groupBy("category").agg(safe_div(F.sum(F.col("gmroi").cast("decimal(18,2)")), F.count("gmroi"), 4).alias("gmroi"))


def supply_kpi(inv: DataFrame, po: DataFrame, shrink: DataFrame, cogs: DataFrame) -> DataFrame:
    """MRT-37: out-of-stock, overstock, days of supply, on-time and shrink."""
    late = po.agg(pct(F.count_if(F.col("on_time") == "Y"), F.count(ONE)).alias("x")).scalar()
    lost = shrink.agg(F.sum("shrink_value").alias("x")).scalar()
    cost = cogs.agg(F.sum("cost").alias("x")).scalar()
    return inv.agg(
        pct(F.count_if(F.col("stock_status") == "Out of Stock"), F.count(ONE)).alias("oos_pct"), pct(F.count_if(F.col("stock_status") == "Overstock"), F.count(ONE)).alias("overstock_pct"),
        safe_div(F.sum(F.col("days_of_supply").cast("decimal(18,1)")), F.count("days_of_supply"), 4).alias("avg_days_of_supply"),
    ).select("*", late.alias("on_time_pct"), pct(lost, cost, 4).alias("shrink_pct_cogs"))


def purchase_orders(lines: DataFrame) -> DataFrame:
    """MRT-38: one order per store, supplier and month; ordered units rounded up to tens.

    An order is complete with its last shipment; the supplier's mean days to ship
    are what it may expect. Units that came back were not received.
    """
    lead = F.greatest(F.lit(0), F.col("ship_days"))
    g = lines.where("supplier_id IS NOT NULL").groupBy("store_id", "supplier_id", "yyyymm").agg(
        F.sum("quantity").alias("units"), F.sum("cost").alias("cost_line"), F.countDistinct("plu").alias("line_count"), F.min("sale_date").alias("order_date"),
        F.max(lead).cast("bigint").alias("actual_lead_days"), F.sum(F.when(F.col("return_flag") != "R", F.col("quantity")).otherwise(F.lit(0))).alias("received_units"),
        F.sum(lead).alias("_days"), F.count(lead).alias("_shipped"),
    )
    # a supplier has no more orders than stores and months
    supplier = Window.partitionBy("supplier_id")
    usual = F.sum("_days").over(supplier) / nonzero(F.sum("_shipped").over(supplier))
    g = g.withColumn("expected_lead_days", F.floor(usual + 0.5).cast("bigint"))
    ordered = ceil_to(F.col("units"), 10)
    return g.select(
        F.concat_ws("-", F.lit("PO"), F.col("store_id").cast("string"), F.col("yyyymm").cast("string"), F.col("supplier_id").cast("string")).alias("po_number"),
        "store_id", "supplier_id", "yyyymm", F.col("order_date").cast("string").alias("order_date"), "expected_lead_days", "actual_lead_days",
        F.when(F.col("actual_lead_days") <= F.col("expected_lead_days"), "Y").otherwise("N").alias("on_time"), "line_count", ordered.alias("ordered_units"),
        F.floor(F.col("received_units") * F.lit(100) / ordered).cast("bigint").alias("fill_rate_pct"), "received_units",
        fixed(F.col("cost_line").cast("double") * ordered.cast("double") / F.col("units").cast("double"), 2).alias("po_value_cost"),
    )


def scorecard(po: DataFrame, focus: DataFrame, quarter: str = "All") -> DataFrame:
    """MRT-38: supplier scorecard: lifetime and one quarter."""
    q = F.concat(F.floor(F.col("yyyymm") / 100).cast("string"), F.lit("Q"), (F.floor((F.col("yyyymm") % 100 - 1) / 3) + 1).cast("string"))
    in_q = F.lit(True) if quarter == "All" else q == quarter
    on = F.col("on_time") == "Y"
    g = po.groupBy("supplier_id").agg(
        F.count(ONE).alias("purchase_orders"), money(F.sum(F.col("po_value_cost").cast("decimal(18,2)"))).alias("total_spend"), safe_div(F.sum("fill_rate_pct"), F.count(ONE), 1).alias("avg_fill_rate_pct"),
        pct(F.count_if(on), F.count(ONE), 1).alias("on_time_pct"), F.countDistinct("store_id").alias("stores_served"), F.max("expected_lead_days").alias("lead_time_days"),
        F.count_if(in_q).alias("quarter_po_count"), pct(F.count_if(in_q & on), F.count_if(in_q)).alias("quarter_on_time_pct"),
    )
    return g.join(focus, "supplier_id", "left")


def shrink_monthly(log: DataFrame) -> DataFrame:
    """MRT-39: shrink by month and reason."""
    return log.groupBy("yyyymm", "reason").agg(F.sum("qty_lost").alias("units"), money(F.sum("shrink_value")).alias("shrink_value"), F.count(ONE).alias("events"))


def labour_cost(shifts: DataFrame) -> DataFrame:
    """MRT-41: cost of each shift."""
    return shifts.withColumn("labour_cost", (F.col("scheduled_hours") * F.col("hourly_rate")).cast("decimal(12,2)"))


def labour_pct(shifts: DataFrame, sales: DataFrame) -> DataFrame:
    """MRT-41: labour as a percentage of sales per store, cost per hour."""
    g = shifts.groupBy("store_id").agg(F.sum("labour_cost").alias("lc"), F.sum("scheduled_hours").alias("h"))
    return g.join(sales, "store_id", "left").select(
        "store_id", money(F.col("lc")).alias("labour_cost"), pct(F.col("lc"), F.col("sales")).alias("labour_pct_sales"), safe_div(F.col("lc"), F.col("h"), 4).alias("cost_per_hour"),
    )


def heatmap(shifts: DataFrame, names: list[str]) -> DataFrame:
    """MRT-41: hours by weekday, one column per shift."""
    return shifts.groupBy(F.weekday("day").alias("dow_num")).pivot("shift_name", names).agg(F.sum("scheduled_hours").cast("double"))


def weekly_flash(traffic: DataFrame, targets: DataFrame, week_ending: str) -> DataFrame:
    """MRT-42: the week, the week before and the plan pro-rated by days of overlap.

    ``targets`` has month_start and target_sales per month.
    """
    end = F.lit(week_ending).cast("date")
    week = F.col("day").between(F.date_sub(end, 6), end)
    prior = F.col("day").between(F.date_sub(end, 13), F.date_sub(end, 7))
    s, t = F.col("sales"), F.col("transactions")
    mo_end = F.last_day("month_start")
    overlap = F.datediff(F.least(end, mo_end), F.greatest(F.date_sub(end, 6), F.col("month_start"))) + 1
    plan = targets.where(overlap > 0).agg(F.sum((F.col("target_sales").cast("double") * overlap.cast("double") / F.dayofmonth(mo_end).cast("double")).cast("decimal(18,4)")).alias("p")).scalar()
    return traffic.agg(
        money(F.sum(F.when(week, s))).alias("week_sales"), F.sum(F.when(week, t)).alias("week_transactions"), money(F.sum(F.when(prior, s))).alias("prior_week_sales"), F.sum(F.when(prior, t)).alias("prior_week_transactions"),
    ).select("*", money(plan).alias("plan_sales"))


def sales_per_sqft_by_format(facts: DataFrame) -> DataFrame:
    """MRT-43: mean sales per square foot of each format."""
    x = F.col("sales_per_sqft").cast("decimal(18,2)")
    return facts.groupBy("store_format").agg(safe_div(F.sum(x), F.count(ONE), 4).alias("sales_per_sqft"))


def exposed(facts: DataFrame, competitors: DataFrame, km: float, at_least: int) -> DataFrame:
    """MRT-43: stores under their format's mean with several rivals near by."""
    near = theta_count(facts, competitors, "store_id", F.col("distance_km") <= km, "competitors_near")
    weak = below_group_mean(near, "store_format", "sales_per_sqft")
    return weak.where(F.col("competitors_near") >= at_least).select("store_id", "region", "store_format", "sales_per_sqft", "competitors_near")


def income_scatter(facts: DataFrame, income: DataFrame) -> DataFrame:
    """MRT-43: store sales per square foot against the mean balance around it."""
    return facts.join(income, "store_id", "left").select("store_id", "store_format", "sales_per_sqft", "median_income")


def density(blocks: DataFrame, groups: DataFrame, cuts: list[tuple[float, str]], default: str) -> DataFrame:
    """MRT-46: block population summed to its block group by code prefix,
    density per square km, class and the class totals beside the row."""
    from shopledger.operators.filters import band

    pop = blocks.groupBy(F.substring("geoid", 1, 12).alias("group_id")).agg(F.sum("pop").alias("population"))
    g = groups.join(pop, "group_id", "left").withColumn("population", F.coalesce("population", F.lit(0)))
    d = g.withColumn("density", F.col("population").cast("double") / (F.col("aland").cast("double") / F.lit(1000000.0)))
    d = d.withColumn("density_class", band(F.col("density"), cuts, default))
    per = d.groupBy("density_class").agg(F.count(ONE).alias("class_groups"), F.sum("population").alias("class_population"))
    return beside(d, per, "density_class").select("group_id", "population", fixed(F.col("density"), 4).alias("density"), "density_class", "class_groups", "class_population")


def county_stats(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """MRT-46: land area, population and density per county code."""
    land = groups.groupBy(F.substring("group_id", 1, 5).alias("county")).agg(F.sum("aland").alias("aland"), F.count(ONE).alias("groups"))
    pop = blocks.groupBy(F.substring("geoid", 1, 5).alias("county")).agg(F.sum("pop").alias("population"))
    return land.join(pop, "county", "left").select("county", "aland", "groups", "population", safe_div(F.col("population"), F.col("aland"), 4, 1000000.0).alias("density"))


def housing_units(blocks: DataFrame, counties: DataFrame, n: int = 15) -> DataFrame:
    """MRT-46: counties with the most housing units."""
    per = blocks.groupBy(F.substring("geoid", 1, 5).alias("county")).agg(F.sum("housing").alias("housing_units"))
    return per.join(counties, "county").select("county", "county_name", "housing_units").orderBy(F.col("housing_units").desc(), "county").limit(n)


def address_ranges(ranges: DataFrame) -> DataFrame:
    """MRT-46: address ranges, street segments, sides and postal suffixes of each postal code.

    Segments are brought to one row each first, so a code that holds most rows is combined early.
    """
    side, suffix = F.col("side"), F.col("plus4")
    per = ranges.where("zip IS NOT NULL").groupBy("zip", "segment_id").agg(F.count(ONE).alias("n"), F.count_if(side == "L").alias("l"), F.count_if(side == "R").alias("r"), F.count_if(suffix.isNotNull() & (suffix != "")).alias("p"))
    return per.groupBy("zip").agg(F.sum("n").alias("addr_ranges"), F.count("segment_id").alias("street_segments"), F.sum("l").alias("left_side"), F.sum("r").alias("right_side"), F.sum("p").alias("with_plus4"))


def name_counts(df: DataFrame, name: str, n: int) -> DataFrame:
    """MRT-46: most frequent street names."""
    return df.groupBy(F.col(name).alias("name")).agg(F.count(ONE).alias("segments")).orderBy(F.col("segments").desc(), "name").limit(n)


def supply_metrics() -> dict[str, tuple[Column, Column]]:
    """MRT-50: named ratios over purchase orders: numerator and denominator."""
    perfect = (F.col("on_time") == "Y") & (F.col("fill_rate_pct") >= 95)
    return {
        "fulfilment_rate": (F.sum("received_units"), F.sum("ordered_units")),
        "perfect_order_rate": (F.count_if(perfect), F.count(ONE)),
        "average_supply_time": (F.sum("actual_lead_days"), F.count(ONE)),
    }


def staff_metrics() -> dict[str, tuple[Column, Column]]:
    """MRT-50: named ratios over shifts."""
    over = F.when(F.col("scheduled_hours") > 7, F.col("scheduled_hours") - 7).otherwise(F.lit(0))
    return {
        "overtime_ratio": (F.sum(over), F.sum("scheduled_hours")),
        "headcount": (F.countDistinct("employee_id"), F.lit(1)),
        "shifts_per_head": (F.count(ONE), F.countDistinct("employee_id")),
        "vacation_use": (F.sum("vacation_used"), F.sum("vacation_accrued")),
    }


def expense_metrics() -> dict[str, tuple[Column, Column]]:
    """MRT-50: named ratios over a profit statement beside its budget."""
    return {
        "actual_to_budget_expense": (F.sum(F.col("actual_total_opex").cast("decimal(18,2)")), F.sum(F.col("budget_total_opex").cast("decimal(18,2)"))),
        "opex_to_sales": (F.sum(F.col("actual_total_opex").cast("decimal(18,2)")), F.sum(F.col("actual_net_sales").cast("decimal(18,2)"))),
        "sales_on_plan_rate": (F.count_if(F.col("sales_on_plan") == "Y"), F.count(ONE)),
    }


def tenure_turnover(shifts: DataFrame, as_of: str, idle_days: int) -> DataFrame:
    """MRT-50: headcount, mean tenure in days and the share of staff without a
    shift in the last ``idle_days`` days, per store."""
    per = shifts.groupBy("store_id", "employee_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    left = F.datediff(F.lit(as_of).cast("date"), F.col("b")) > idle_days
    return per.groupBy("store_id").agg(
        F.count(ONE).alias("headcount"), safe_div(F.sum(F.datediff("b", "a")), F.count(ONE), 6).alias("avg_tenure_days"), safe_div(F.count_if(left), F.count(ONE), 6).alias("turnover_rate"),
    )


def ops_metric(df: DataFrame, names: dict[str, tuple[Column, Column]], by: str) -> DataFrame:
    """MRT-50: operating metrics by name, each a ratio of sums."""
    return df.groupBy(by).agg(*[safe_div(a, b, 6).alias(k) for k, (a, b) in names.items()])
