"""Registered queries for trained models (ML-13, 19, 23..27, 29; UDF-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import fixed
from shopledger.operators.ordered import exact_quantiles
from shopledger.plans import demand as dm
from shopledger.plans import learning as le
from shopledger.plans import scoring as sc
from shopledger.queries.common import L, LT, LTM, div, fx, m, n
from shopledger.queries.q_analytics import _regm, flagged
from shopledger.queries.q_customers import ACT, CLV, CM, activation_set, churn_set, clv_set
from shopledger.queries.q_sales import HOLIDAYS
from shopledger.queries.q_stores import PO, SDAY, plu_week, po, store_day
from shopledger.queries.q_windows import store_days
from shopledger.queries.registry import query
from shopledger.session import cut_lineage
from shopledger.sources import retail
from shopledger.sources.tables import read_table

TRAIN_UNTIL = 2451726  # 2000-06-30


def churn_with_segment(spark, sf):
    """The churn set with the market segment of the customer."""
    segment = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return churn_set(spark, sf).join(segment, "customer_id", "left")


@query("ml13_churn_classifier")
def _(spark, sf):
    return le.train_churn(churn_with_segment(spark, sf), TRAIN_UNTIL, ["segment"])[2]


@query("ml13_calibration_by_segment")
def _(spark, sf):
    return le.calibration_by(le.train_churn(churn_with_segment(spark, sf), TRAIN_UNTIL, ["segment"])[1], ["segment"])


@query("ml19_permutation_importance")
def _(spark, sf):
    """All features of the forward margin model, scored on a later as-of month than it was fitted on."""
    rows = clv_set(spark, sf).select("customer_id", "as_of_seq", F.col("future_margin").cast("double").alias("label"), *le.CLV_NUMS)
    table = cut_lineage(le.prepared(rows, le.CLV_NUMS, []))
    train, later = (table.where(F.col("as_of_seq") == k).select("customer_id", "label", *le.CLV_NUMS) for k in (54, 66))
    model = le.fitted(train, le.CLV_NUMS, [], "label", False, F.col("customer_id"))
    return sc.perm_importance(model, later, le.CLV_NUMS, "customer_id", "label").withColumn("error_rise", F.round("error_rise", 4))


@query("ml19_classifier_importance")
def _(spark, sf):
    """The same for the activation model, on the last quarter of first purchases."""
    table = cut_lineage(le.prepared(activation_set(spark, sf).where("activated_90 IS NOT NULL").withColumn("label", F.col("activated_90").cast("double")), le.ACT_NUMS, le.ACT_CATS))
    split = exact_quantiles(table, "first_jdn", {"q": 0.75}).first()["q"]
    model = le.fitted(table.where(F.col("first_jdn") < split), le.ACT_NUMS, le.ACT_CATS, "label", True, F.col("customer_id"))
    feats = [*le.ACT_NUMS, *le.ACT_CATS]
    later = table.where(F.col("first_jdn") >= split).select("customer_id", "label", *feats)
    return sc.perm_importance(model, later, feats, "customer_id", "label", classify=True).withColumn("error_rise", F.round("error_rise", 4))


@query("ml23_activation_model")
def _(spark, sf):
    return le.train_activation(activation_set(spark, sf))[0]


@query("ml23_second_buy_nudges")
def _(spark, sf):
    return le.train_activation(activation_set(spark, sf))[1].withColumn("churn_probability", F.round("churn_probability", 4))


@query("ml23_training_split", f"""{LT}, {ACT}, k AS (SELECT first_jdn, activated_90 AS y FROM act WHERE activated_90 IS NOT NULL), q AS (SELECT quantile_cont(CAST(first_jdn AS DOUBLE), 0.75) AS split_jdn FROM k)
SELECT CASE WHEN first_jdn < split_jdn THEN 'train' ELSE 'later' END AS side, max(split_jdn) AS split_jdn, count(*) AS n, {div('sum(y)', 'count(*)', 6)} AS rate FROM k, q GROUP BY 1""")
def _(spark, sf):
    return le.activation_split(activation_set(spark, sf))


@query("ml24_baseline_deciles", f"""{LTM}, {CM}, {CLV}, d AS (SELECT greatest(0.0::DOUBLE, margin_l6) AS p, future_margin AS y, ntile(10) OVER (ORDER BY greatest(0.0::DOUBLE, margin_l6), customer_id) AS decile FROM clv WHERE as_of_seq = 66)
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, {m('sum(CAST(p AS DECIMAL(18,2)))')} AS total_pred, {m('sum(CAST(y AS DECIMAL(18,2)))')} AS total_actual FROM d GROUP BY 1""")
def _(spark, sf):
    """Last half-year's margin as the forecast of the next, on the validation month of the model."""
    return le.decile_totals(clv_set(spark, sf).where("as_of_seq = 66"), "margin_l6", "future_margin", "customer_id")


@query("ml24_lifetime_value_model")
def _(spark, sf):
    return le.clv(clv_set(spark, sf), 54, 66)[0]


@query("ml24_lifetime_value_deciles")
def _(spark, sf):
    return le.clv(clv_set(spark, sf), 54, 66)[1]


DAY_NUMS = ["lag_14", "lag_21", "lag_28", "lag_364", "roll7", "roll28", "rollstd28", "samedow_mean4", "trend_ratio", "dow", "mo"]


REGIME_CUT = 1200


def store_day_table(spark, sf, ahead=0):
    """Features of every store and day, and of ``ahead`` days after the last; the last day's number."""
    base = F.lit("1995-01-01").cast("date")
    days = store_days(spark, sf)
    spine = dm.daily_spine(days, "store_id", "sale_date", ["units"]).select("store_id", "sale_date", "observed", F.col("units").cast("double").alias("u"))
    end = spine.agg(F.max("sale_date").alias("d")).first()["d"]
    if ahead:
        later = spine.select("store_id").distinct().select("store_id", F.explode(F.sequence(F.date_add(F.lit(end), 1), F.date_add(F.lit(end), ahead))).alias("sale_date"), F.lit(False).alias("observed"), F.lit(None).cast("double").alias("u"))
        spine = spine.unionByName(later)
    spine = spine.select("store_id", "observed", F.weekday("sale_date").alias("dow"), F.month("sale_date").alias("mo"), F.datediff("sale_date", base).alias("t"), "u")
    last = spine.where("u IS NOT NULL").agg(F.max("t").alias("t")).first()["t"]
    return dm.store_day_lags(spine).withColumn("target", F.col("u")), last


@query("ml25_store_day_forecast")
def _(spark, sf):
    f, last = store_day_table(spark, sf)
    return le.store_day_forecast(f, DAY_NUMS, [], last, 60, REGIME_CUT, {"lag14": "lag_14", "same_weekday": "samedow_mean4", "roll28": "roll28"})


@query("ml25_store_day_forward")
def _(spark, sf):
    f, last = store_day_table(spark, sf, ahead=14)
    return le.store_day_forward(f, DAY_NUMS, [], last, 14, REGIME_CUT).withColumn("predicted_units", F.round("predicted_units", 3))


@query("ml26_forward_frame", f"""{L}, {SDAY}, h AS (SELECT store_id, sale_date AS calendar_date, promos_active FROM sd0 JOIN cal ON calendar_date = sale_date), e AS (SELECT max(CAST(o_orderdate AS DATE)) AS e FROM orders), a AS (SELECT store_id, max(calendar_date) AS lst FROM h GROUP BY 1),
f AS (SELECT a.store_id, CAST(unnest(generate_series(e.e + 1, e.e + 14, INTERVAL 1 DAY)) AS DATE) AS d FROM a, e WHERE date_diff('day', lst, e.e) <= 30), p AS (SELECT month(calendar_date) AS mo, isodow(calendar_date) - 1 AS dow, avg(promos_active) AS p FROM (SELECT DISTINCT calendar_date, promos_active FROM h) GROUP BY 1, 2)
SELECT f.store_id, CAST(f.d AS VARCHAR) AS calendar_date, month(f.d) AS mo, isodow(f.d) - 1 AS dow_num, s.region, s.store_format, s.square_feet, {fx('p.p', 6)} AS promos_expected, CASE WHEN strftime(f.d, '%m-%d') IN ('01-01', '07-01', '12-25', '12-26') THEN 'Y' ELSE 'N' END AS is_holiday,
CASE strftime(f.d, '%m-%d') WHEN '01-01' THEN 'New Years Day' WHEN '07-01' THEN 'Canada Day' WHEN '12-25' THEN 'Christmas Day' WHEN '12-26' THEN 'Boxing Day' ELSE 'None' END AS holiday_name, FALSE AS observed FROM f JOIN stores s USING (store_id) LEFT JOIN p ON p.mo = month(f.d) AND p.dow = isodow(f.d) - 1""")
def _(spark, sf):
    out = dm.forward_frame(store_day(spark, sf), retail.span(spark, sf)[1], 14, ["region", "store_format", "square_feet"], dict(HOLIDAYS), 30)
    return out.withColumn("calendar_date", F.col("calendar_date").cast("string"))


PLU_NUMS = ["lag_2", "lag_4", "lag_8", "lag_13", "roll4", "roll13", "roll13_std", "zero_rate13", "trend_ratio"]


def plu_scored(spark, sf):
    """Features are made once for each series of weeks that pairs share, unless the dense panel has fewer rows than the series have weeks."""
    runs = cut_lineage(dm.week_series(plu_week(spark, sf, dm.plu_week_runs)))
    steps = cut_lineage(dm.series_steps(runs))
    weeks = runs.agg(F.sum(F.col("until") - F.col("week_seq") + 1).alias("n")).first()["n"] or 0
    if weeks < (steps.agg(F.sum(F.col("age") + F.col("steps") + 1).alias("n")).first()["n"] or 0):
        return le.plu_forecast(dm.plu_week_lags(plu_week(spark, sf).select("store_id", "plu", "week_seq", "units")), PLU_NUMS, 300)
    return le.plu_forecast(dm.plu_week_lags(dm.series_panel(steps), keys=["series"]), PLU_NUMS, 300, runs=runs)


@query("ml27_product_week_forecast")
def _(spark, sf):
    return plu_scored(spark, sf).select("store_id", "plu", "week_seq", "seen_store", "units", F.round("predicted_units", 4).alias("predicted_units"), "velocity_band", F.round("order_quantity", 4).alias("order_quantity"))


@query("ml27_forecast_metrics")
def _(spark, sf):
    s = cut_lineage(plu_scored(spark, sf))
    out = None
    for seen in ("Y", "N"):
        part = s.where(F.col("seen_store") == seen)
        level = sc.service_level(part, "units", {"median": "predicted_units", "order": "order_quantity"}).select(F.col("order_rule").alias("scorer"), "n", F.lit("service_level").alias("measure"), F.col("service_level").alias("value"))
        wape = sc.baselines(part, "units", {"model": "predicted_units", "lag2": "lag_2", "ma4": "roll4"}).select(F.col("baseline").alias("scorer"), "n", F.lit("wape").alias("measure"), F.col("wape").alias("value"))
        both = level.unionByName(wape).withColumn("seen_store", F.lit(seen))
        out = both if out is None else out.unionByName(both)
    return out


@query("ml29_lead_time_baselines", f"""{L}, {PO}, t AS (SELECT avg(actual_lead_days) AS a FROM po WHERE yyyymm <= 200006), l AS (SELECT 'order_expectation' AS baseline, CAST(actual_lead_days AS DOUBLE) AS y, CAST(expected_lead_days AS DOUBLE) AS p FROM po WHERE yyyymm > 200006
 UNION ALL SELECT 'train_mean', CAST(actual_lead_days AS DOUBLE), a FROM po, t WHERE yyyymm > 200006) SELECT baseline, {_regm('y', 'p')} FROM l GROUP BY 1""")
def _(spark, sf):
    orders = cut_lineage(po(spark, sf).select("yyyymm", "actual_lead_days", "expected_lead_days"))
    mean = orders.where("yyyymm <= 200006").agg(F.avg("actual_lead_days").alias("m")).scalar()
    return sc.baselines(orders.where("yyyymm > 200006").withColumn("train_mean", mean), "actual_lead_days", {"order_expectation": "expected_lead_days", "train_mean": "train_mean"})


@query("ml29_supplier_models")
def _(spark, sf):
    return le.supplier_reliability(po(spark, sf), 200006)[0]


@query("ml29_supplier_buffers")
def _(spark, sf):
    return le.supplier_reliability(po(spark, sf), 200006)[1]


@query("udf02_isolation_forest_flags")
def _(spark, sf):
    return flagged(spark, sf).groupBy("flag_source").agg(F.count("*").alias("cells"), F.round(F.avg("iforest_score"), 6).alias("mean_score"))
