"""Price elasticity (ML-05..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import nonzero
from shopledger.operators.windows import consecutive_diff, demean

PRICE_MOVE = 0.05


def elasticity_panel(prices: DataFrame, item: str = "item") -> DataFrame:
    """ML-05: log first differences of price and units over neighbouring
    months, less the month's mean.  ``prices``: item, month_seq, units, price."""
    logs = prices.where("units > 0 AND price > 0").select(item, "month_seq", F.log("units").alias("q"), F.log("price").alias("p"))
    diffs = consecutive_diff(logs, [item], "month_seq", ["q", "p"])
    return demean(diffs.select(item, "month_seq", F.col("d_q").alias("dq"), F.col("d_p").alias("dp")), "month_seq", ["dq", "dp"])


def ols0(df: DataFrame, key: str, x: str, y: str, min_rows: int = 6) -> DataFrame:
    """ML-06: least squares through the origin per key, in closed form from
    three sums, so the rows never leave the executors."""
    a, b = F.col(x), F.col(y)
    g = df.groupBy(key).agg(
        F.count("*").alias("n_diffs"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"), F.count_if(F.abs(a) > 0.005).alias("moves")
    )
    ok = (F.col("n_diffs") >= min_rows) & (F.col("sxx") > 1e-12)
    beta = F.col("sxy") / F.col("sxx")
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    return g.select(
        key, "n_diffs", "moves", F.when(ok, beta).alias("beta"),
        F.when(ok & (F.col("n_diffs") > 1), F.sqrt(rss / (F.col("n_diffs") - 1) / F.col("sxx"))).alias("se"),
        F.when(ok & (F.col("syy") > 1e-12), 1 - rss / F.col("syy")).alias("r2"),
    )


def eb_shrink(est: DataFrame, grp: str) -> DataFrame:
    """ML-07: empirical-Bayes shrinkage of each slope to its group.

    The group slope is precision weighted; the variance between members, net of
    sampling noise, is floored at zero.  Under three usable members the group
    slope is their median, which for one or two is their mean.
    """
    usable = F.col("beta").isNotNull() & (F.col("se") > 0)
    w = F.when(usable, 1.0 / (F.col("se") * F.col("se")))
    g = est.groupBy(grp).agg(
        F.count_if(usable).alias("k"), F.sum(w * F.col("beta")).alias("wb"), F.sum(w).alias("w"), F.avg(F.when(usable, F.col("beta"))).alias("mb"),
        F.var_samp(F.when(usable, F.col("beta"))).alias("vb"), F.avg(F.when(usable, F.col("se") * F.col("se"))).alias("noise"),
    )
    cat = F.when(F.col("k") >= 3, F.col("wb") / F.col("w")).otherwise(F.col("mb"))
    tau2 = F.when(F.col("k") >= 3, F.greatest(F.col("vb") - F.col("noise"), F.lit(0.0)))
    j = est.join(g.select(grp, cat.alias("category_elasticity"), tau2.alias("tau2")), grp)
    t, se = F.col("tau2"), F.col("se")
    weight = F.when(se.isNotNull(), F.when(t.isNull() | (t <= 0), 0.0).otherwise(t / (t + se * se)))
    j = j.withColumn("shrink_weight", weight)
    sw, c = F.col("shrink_weight"), F.col("category_elasticity")
    known = F.col("beta").isNotNull() & sw.isNotNull()
    return j.withColumn("elasticity_shrunk", F.when(known, sw * F.col("beta") + (1 - sw) * c).otherwise(c)).drop("tau2")


def validate_elasticity(test: DataFrame, est: DataFrame, key: str) -> DataFrame:
    """ML-08: out-of-time correlation, R2 against no response and calibration
    slope, from one aggregate."""
    v = test.join(est.select(key, "elasticity_shrunk"), key).where("elasticity_shrunk IS NOT NULL")
    pred, dq = F.col("elasticity_shrunk") * F.col("dp"), F.col("dq")
    return v.agg(
        F.count("*").alias("n"), F.corr(pred, dq).alias("corr_pred_actual"), (1 - F.sum((dq - pred) * (dq - pred)) / nonzero(F.sum(dq * dq))).alias("r2_vs_null"),
        (F.sum(pred * dq) / nonzero(F.sum(pred * pred))).alias("calibration_slope"),
    )


def pricing_signal(df: DataFrame, calibration: float = 1.0) -> DataFrame:
    """ML-09: demand band, optimal price c*e/(1+e), margin effect of +5 pct and
    the signal text.  ``df``: elasticity_shrunk, beta, avg_price, avg_cost, avg_units."""
    e = F.col("elasticity_shrunk")
    ec = e * F.lit(float(calibration))
    band = F.when(e < -1.5, "highly elastic").when(e < -1.0, "elastic").when(e < -0.3, "inelastic").when(e >= -0.3, "very inelastic").otherwise("unknown")
    signal = (
        F.when(F.col("beta").isNull(), "not identified - insufficient price variation").when(e >= -0.3, "very inelastic - price rise candidate, test first")
        .when(e >= -1.0, "inelastic - modest price rise may pay, test first").when(e >= -1.5, "near unit elastic - hold price")
        .when(e < -1.5, "elastic - protect price, promote to drive volume").otherwise("unknown")
    )
    units, price, cost = F.col("avg_units"), F.col("avg_price"), F.col("avg_cost")
    more = units * (1 + ec * F.lit(PRICE_MOVE))
    return df.select(
        "*", ec.alias("elasticity_calibrated"), band.alias("demand_band"), F.when(ec < -1.0, cost * ec / (1.0 + ec)).alias("optimal_price"), (units * ec * F.lit(PRICE_MOVE)).alias("units_delta_up5"),
        ((more * (price * (1 + F.lit(PRICE_MOVE)) - cost) - units * (price - cost)) * 12).alias("margin_delta_up5"), signal.alias("pricing_signal"),
    )
