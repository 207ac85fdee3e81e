"""Models trained on executors with MLlib (ML-13, 19, 23..25, 27, 29).

Every job writes its feature table once, fits boosted trees on it, scores the
held-out rows and compares with named baselines on the same rows. Trees are
added until the error on a share of the training keys, kept out of the fit by
their hash, stops falling. A missing number stays missing for baselines; the
model sees it as an indicator beside a filled value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import fixed, md5_bucket, money, nonzero, safe_div
from shopledger.operators.joins import with_scalars
from shopledger.operators.ordered import exact_ntile, exact_quantiles
from shopledger.plans import repeat_buying as rb
from shopledger.plans import scoring as sc
from shopledger.plans.demand import LOOK_BACK
from shopledger.session import cut_lineage, shared_folder

SERVICE_Q = 0.85
#: Boosting ends after this many trees, or when another tree lowers the error of the kept-out keys by less than this share.
MOST_TREES, LEAST_GAIN = 300, 2e-3
KEPT_OUT_PERCENT = 20


def prepared(df: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> DataFrame:
    """Numbers as doubles, missing ones left as they are; texts with a value for missing ones."""
    rest = [c for c in df.columns if c not in set(nums) | set(cats)]
    return df.select(*rest, *[F.col(c).cast("double").alias(c) for c in nums], *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in cats])


def boosted(nums: Sequence[str], cats: Sequence[str], label: str, classify: bool, missing: Sequence[str] = (), kept_out: str | None = None, trees: int = MOST_TREES, depth: int = 4, seed: int = 42, weight: str | None = None) -> Pipeline:
    """Indicators of missing numbers, category codes, one feature vector, boosted trees."""
    columns = [f"coalesce(`{c}`, 0D) AS `{c}_in`" for c in nums] + [f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}_missing`" for c in missing]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cats]
    stages.append(VectorAssembler(inputCols=[*[f"{c}_in" for c in nums], *[f"{c}_missing" for c in missing], *[f"{c}_ix" for c in cats]], outputCol="features"))
    kind = GBTClassifier if classify else GBTRegressor
    gbt = kind(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, maxBins=64, validationTol=LEAST_GAIN)
    if kept_out:
        gbt.setValidationIndicatorCol(kept_out)
    if weight:
        gbt.setWeightCol(weight)
    return Pipeline(stages=[*stages, gbt])


def held_from_fit(key: Column) -> Column:
    """Whether a key belongs to the KEPT_OUT_PERCENT whose error ends the boosting."""
    return md5_bucket(key, "stop", 100) < KEPT_OUT_PERCENT


def fitted(train: DataFrame, nums: Sequence[str], cats: Sequence[str], label: str, classify: bool, key: Column | None, trees: int = MOST_TREES, held: Column | None = None, weight: str | None = None) -> PipelineModel:
    """Boosted trees on ``train``, stopped early by the rows of KEPT_OUT_PERCENT of the keys.

    ``weight`` names how many equal rows a row stands for; such rows bring ``held``
    in place of the key.
    """
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # boosting cuts its own lineage there
        context.setCheckpointDir(shared_folder(train.sparkSession))
    rows = train.withColumn("_kept_out", held_from_fit(key) if held is None else held)
    known = rows.agg(F.count_if("_kept_out").alias("_k"), F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in nums]).first()
    stop = "_kept_out" if 0 < known["_k"] < known["_n"] else None
    return boosted(nums, cats, label, classify, [c for c in nums if known[c]], stop, trees, weight=weight).fit(rows)


def tree_count(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def named(df: DataFrame, scorer: str) -> DataFrame:
    return df.select(F.lit(scorer).alias("scorer"), "*")


CHURN_NUMS = [
    "purchase_days_asof", "sales_asof", "tenure_days", "days_since_last", "ipt_median_asof", "ipt_max_asof", "overdue_ratio", "purchase_days_l90", "purchase_days_l180", "purchase_days_prior90", "sales_l180",
    "txns_l180", "returns_l180", "margin_l180", "promo_share_l180", "ecommerce_l180", "weekend_txns_l180",
]


WEEK = 7.0


def churn_histories(df: DataFrame) -> DataFrame:
    """Each customer's history in weeks at the latest cutoff of ``df`` that is not for scoring."""
    known = df.where("is_scoring_row = 'N'")
    latest = known.agg(F.max("as_of").alias("a")).scalar()
    return known.where(F.col("as_of") == latest).select(F.col("bgnbd_frequency").alias("x"), (F.col("bgnbd_recency") / WEEK).alias("t_x"), (F.col("bgnbd_t") / WEEK).alias("t"))


def train_churn(df: DataFrame, train_until: int, cats: Sequence[str] = (), train_share: int = 70, trees: int = MOST_TREES) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """ML-13: churn classifier, validated on later cutoffs and other customers.

    The probability that the customer is still active, from the model of repeat
    buying fitted on the training customers, is one of the inputs; ``cats`` names
    category columns that are inputs too. Returns the model, the scored validation
    rows (with ``cats``) and the metrics of the model and of two baselines: the
    overdue ratio and the repeat-buying probability.
    """
    known = df.where("is_scoring_row = 'N' AND churn_adaptive IS NOT NULL").withColumn("bucket", md5_bucket(F.col("customer_id"), "cv", 100))
    # only what the models read is made and written
    known = known.select("as_of", "customer_id", "is_scoring_row", "bucket", F.col("churn_adaptive").cast("double").alias("label"), "bgnbd_frequency", "bgnbd_recency", "bgnbd_t", *CHURN_NUMS, *cats)
    table = cut_lineage(prepared(known, CHURN_NUMS, cats))
    training = (F.col("as_of") <= train_until) & (F.col("bucket") < train_share)
    fit = rb.bgnbd_fit(churn_histories(table.where(training)))
    table = table.withColumn("p_alive", sc.p_alive(F.col("bgnbd_frequency"), F.col("bgnbd_recency") / WEEK, F.col("bgnbd_t") / WEEK, fit.params))
    valid = table.where((F.col("as_of") > train_until) & (F.col("bucket") >= train_share))
    model = fitted(table.where(training), [*CHURN_NUMS, "p_alive"], cats, "label", True, F.col("customer_id"), trees)
    row_id = F.col("as_of").cast("bigint") * 10_000_000_000 + F.col("customer_id")
    scored = cut_lineage(probability(model, valid).select(row_id.alias("row_id"), "as_of", "customer_id", *cats, "label", "p", (1.0 - F.col("p_alive")).alias("p_gone"), "overdue_ratio"))
    parts = [named(sc.clf_metrics(scored, "label", c, "row_id"), name) for name, c in (("gbt", "p"), ("bgnbd", "p_gone"), ("overdue_ratio", "overdue_ratio"))]
    return model, scored, beside_baselines(reduce(DataFrame.unionByName, parts), "gbt", "auc_roc", more=True)


def beside_baselines(metrics: DataFrame, model: str, measure: str, more: bool, scorer: str = "scorer") -> DataFrame:
    """Marks each baseline row with whether the model is better by ``measure``; null on the model's own row."""
    metrics = cut_lineage(metrics)
    own = metrics.where(F.col(scorer) == model).select(measure).scalar()
    better = own > F.col(measure) if more else own < F.col(measure)
    return metrics.withColumn("model_is_better", F.when(F.col(scorer) != model, better))


def calibration_by(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """ML-16: rows, mean predicted and actual rate of each group."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), fixed(F.avg("p"), 4).alias("pred"), fixed(F.avg("label"), 4).alias("actual"))


ACT_NUMS = ["first_basket_value", "first_basket_items", "first_basket_margin", "first_discount", "first_categories"]
ACT_CATS = ["first_promo_flag", "first_channel"]


def train_activation(df: DataFrame, trees: int = MOST_TREES) -> tuple[DataFrame, DataFrame]:
    """ML-23: will a first-time buyer come back; trained on the earlier three
    quarters of first purchases.  Returns metrics, with the training rate as
    baseline, and the nudge list."""
    table = cut_lineage(prepared(df.withColumn("label", F.col("activated_90").cast("double")), ACT_NUMS, ACT_CATS))
    known = table.where("label IS NOT NULL")
    split = exact_quantiles(known, "first_jdn", {"q": 0.75}).first()["q"]
    train = known.where(F.col("first_jdn") < split)
    model = fitted(train, ACT_NUMS, ACT_CATS, "label", True, F.col("customer_id"), trees)
    rate = train.agg(F.avg("label").alias("r")).scalar()
    scored = cut_lineage(probability(model, known.where(F.col("first_jdn") >= split)).select("customer_id", "label", "p").withColumn("rate", rate))
    parts = [named(sc.clf_metrics(scored, "label", c, "customer_id"), name) for name, c in (("activation_gbt", "p"), ("training_rate", "rate"))]
    metrics = beside_baselines(parts[0].unionByName(parts[1]), "activation_gbt", "brier", more=False)
    one = probability(model, table.where("is_one_time = 'Y'")).select("customer_id", (1.0 - F.col("p")).alias("churn_probability"), F.col("first_basket_margin").alias("margin"), "days_since_first")
    nudge = sc.risk_actions(one).withColumn("recommended_action", F.when(F.col("days_since_first") <= 90, "Second-buy nudge").otherwise("None"))
    return metrics, nudge


def activation_split(df: DataFrame) -> DataFrame:
    """ML-23: the day that parts training from later first purchases, and the rows and rate of each side."""
    known = cut_lineage(df.where("activated_90 IS NOT NULL").select("first_jdn", F.col("activated_90").cast("bigint").alias("y")))
    split = exact_quantiles(known, "first_jdn", {"q": 0.75}).select("q").scalar()
    rows = known.withColumn("split_jdn", split).withColumn("side", F.when(F.col("first_jdn") < F.col("split_jdn"), "train").otherwise("later"))
    return rows.groupBy("side").agg(F.max("split_jdn").alias("split_jdn"), F.count("*").alias("n"), safe_div(F.sum("y"), F.count("*"), 6).alias("rate"))


def decile_totals(df: DataFrame, pred: str, label: str, key: str) -> DataFrame:
    """ML-24: rows, predicted and actual total of each decile of a forecast, 10 the highest; forecasts under 0 count as 0."""
    p = F.greatest(F.lit(0.0), F.col(pred).cast("double"))
    ranked = exact_ntile(df.select(key, p.alias("p"), F.col(label).alias("y")), ["p", key], {"decile": 10})
    total = lambda c: money(F.sum(F.col(c).cast("decimal(18,2)")))
    return ranked.groupBy("decile").agg(F.count("*").alias("n"), total("p").alias("total_pred"), total("y").alias("total_actual"))


CLV_NUMS = [
    "months_observed", "months_since_first", "sales_life", "margin_life", "txns_life", "sales_l3", "sales_l6", "sales_l12", "margin_l3", "margin_l6", "margin_l12", "txns_l6", "txns_l12", "purchase_days_l6",
    "returns_l6", "promo_sales_l6", "discount_l6", "active_months_l6", "days_since_last",
]


def clv(df: DataFrame, train_as_of: int, valid_as_of: int, trees: int = MOST_TREES) -> tuple[DataFrame, DataFrame]:
    """ML-24: forward margin regressor against last half-year's margin: metrics,
    portfolio calibration and top-decile capture; and the decile table."""
    table = cut_lineage(prepared(df, CLV_NUMS, []).withColumn("label", F.col("future_margin").cast("double")))
    model = fitted(table.where(F.col("as_of_seq") == train_as_of), CLV_NUMS, [], "label", False, F.col("customer_id"), trees)
    scored = cut_lineage(model.transform(table.where(F.col("as_of_seq") == valid_as_of)).select("customer_id", "label", F.greatest(F.lit(0.0), "prediction").alias("model"), F.greatest(F.lit(0.0), "margin_l6").alias("margin_l6")))
    deciles, rows = None, None
    for name in ("model", "margin_l6"):
        d = exact_ntile(scored, [name, "customer_id"], {"decile": 10}, cut=False)
        t = scored.agg(F.sum("label").alias("t")).scalar()
        g = d.groupBy("decile").agg(F.count("*").alias("n"), F.avg(name).alias("pred"), F.avg("label").alias("actual"), F.sum("label").alias("total_actual"))
        g = named(g, name).withColumn("share_of_total", F.col("total_actual") / nonzero(t))
        deciles = g if deciles is None else deciles.unionByName(g)
        one = with_scalars(sc.reg_metrics(scored, "label", name), scored.agg((F.sum(name) / nonzero(F.sum("label"))).alias("portfolio_calibration")))
        one = with_scalars(one, g.where("decile = 10").agg(F.max("share_of_total").alias("top_decile_capture")))
        rows = named(one, name) if rows is None else rows.unionByName(named(one, name))
    return beside_baselines(rows, "model", "mae", more=False), deciles


def regime_models(observed: DataFrame, nums: Sequence[str], cats: Sequence[str], regime_cut: int, trees: int) -> dict[str, PipelineModel]:
    """One model of all observed days and one of the days after the cut."""
    key = F.concat_ws("|", F.col("store_id").cast("string"), F.floor(F.col("t") / 28).cast("string"))
    regimes = {"all_history": observed, "after_cut": observed.where(F.col("t") >= regime_cut)}
    return {name: fitted(rows, nums, cats, "label", False, key, trees) for name, rows in regimes.items()}


def store_day_forecast(features: DataFrame, nums: Sequence[str], cats: Sequence[str], last_day: int, horizon: int, regime_cut: int, baselines: dict[str, str], trees: int = MOST_TREES) -> DataFrame:
    """ML-25: two training regimes (all history, only after a cut) scored on the
    last ``horizon`` days; the better WAPE is marked, baselines beside it."""
    table = cut_lineage(prepared(features, nums, cats).withColumn("label", F.col("target").cast("double")))
    history = table.where((F.col("t") <= last_day - horizon) & F.col("observed"))
    valid = table.where((F.col("t") > last_day - horizon) & F.col("observed"))
    models = regime_models(history, nums, cats, regime_cut, trees)
    out = reduce(DataFrame.unionByName, [named(sc.reg_metrics(m.transform(valid), "label", "prediction"), name) for name, m in models.items()])
    out = cut_lineage(out)
    base = sc.baselines(valid, "label", baselines).withColumnRenamed("baseline", "scorer")
    best = out.agg(F.min(F.struct("wape", "scorer")).alias("b")).select("b.scorer").scalar()
    least = out.agg(F.min("wape").alias("w")).scalar()
    rows = out.unionByName(base.select(*out.columns)).withColumn("picked", F.col("scorer") == best)
    return rows.withColumn("model_is_better", F.when(~F.col("scorer").isin(*models), least < F.col("wape")))


def store_day_forward(features: DataFrame, nums: Sequence[str], cats: Sequence[str], last_day: int, horizon: int, regime_cut: int, trees: int = MOST_TREES) -> DataFrame:
    """ML-25: expected units of every store on the days after ``last_day``.

    The features of those days must be known on ``last_day``, so lags are no
    shorter than the horizon. The regime that does better on the last
    ``horizon`` known days is fitted again on all of them.
    """
    table = cut_lineage(prepared(features, nums, cats).withColumn("label", F.col("target").cast("double")))
    known = table.where((F.col("t") <= last_day) & F.col("observed"))
    recent = known.where(F.col("t") > last_day - horizon)
    trial = regime_models(known.where(F.col("t") <= last_day - horizon), nums, cats, regime_cut, trees)
    wape = {name: sc.reg_metrics(m.transform(recent), "label", "prediction").first()["wape"] for name, m in trial.items()}
    best = min(wape, key=lambda name: (wape[name] is None, wape[name], name))
    model = regime_models(known, nums, cats, regime_cut, trees)[best]
    ahead = table.where((F.col("t") > last_day) & (F.col("t") <= last_day + horizon))
    return model.transform(ahead).select("store_id", "t", F.greatest(F.lit(0.0), "prediction").alias("predicted_units"), F.lit(best).alias("regime"))


def plu_forecast(features: DataFrame, nums: Sequence[str], train_until: int, trees: int = MOST_TREES, base: int = 5, unseen: int = 1, runs: DataFrame | None = None) -> DataFrame:
    """ML-27: product-week forecast and order quantity for every store.

    The stores of one residue class stay out of the fit, so later weeks show
    the error for stores the model has seen and for stores it has not.

    The order adds the 0.85 residual quantile of the row's velocity band, taken
    from the training rows, and never goes under the forecast.

    Most weeks of a dense panel look alike, so training rows with equal features,
    label and side are one row that weighs as many; none is left out.

    ``features`` are those of every week, or, with ``runs``, of the weeks of each
    series of ``demand.week_series``: a week of a run has the features of its
    number in the run's series.
    """
    table = cut_lineage(prepared(features, nums, []).withColumn("label", F.col("units").cast("double")))
    seen = F.pmod(F.col("store_id"), F.lit(base)) != unseen
    held = held_from_fit(F.concat_ws("|", F.col("store_id").cast("string"), F.col("plu").cast("string")))
    if runs is None:
        train = table.where((F.col("week_seq") <= train_until) & seen).withColumn("_held", held).withColumn("_n", F.lit(1).cast("bigint"))
    else:
        # runs of one series that end alike are counted first; the last step stands for all later weeks
        last = F.least(F.col("until"), F.lit(train_until)) - F.col("week_seq")
        step = F.least(last, F.lit(LOOK_BACK + 1))
        alike = runs.where((F.col("week_seq") <= train_until) & seen).groupBy("series", held.alias("_held"), step.alias("_last")).agg(F.count("*").alias("_n"), F.sum(last - step).alias("_more"))
        weeks = alike.select("series", "_held", "_n", "_more", F.explode(F.sequence(F.lit(0), "_last")).alias("week_seq"))
        number = F.col("_n") + F.when(F.col("week_seq") == LOOK_BACK + 1, F.col("_more")).otherwise(0)
        train = weeks.groupBy("series", "week_seq", "_held").agg(F.sum(number).alias("_n")).join(table, ["series", "week_seq"])
    counted = cut_lineage(train.groupBy(*nums, "label", "_held").agg(F.sum("_n").alias("_rows")))
    model = fitted(counted, nums, [], "label", False, None, trees, held=F.col("_held"), weight="_rows")
    band = F.when(F.col("roll13") >= 1.0, "fast").when(F.col("roll13") >= 0.3, "medium").when(F.col("roll13").isNotNull(), "slow").otherwise("new")
    p = F.greatest(F.lit(0.0), F.col("prediction"))
    fit = model.transform(counted).select(band.alias("velocity_band"), (F.col("label") - p).alias("resid"), "_rows")
    up = exact_quantiles(fit, "resid", {"extra": SERVICE_Q}, ["velocity_band"], weight="_rows")
    keys = ["store_id", "plu"] if runs is None else ["series"]
    later = table.where(F.col("week_seq") > train_until) if runs is None else table.where(F.col("week_seq") >= 0)
    scored = model.transform(later).select(*keys, "week_seq", F.col("label").alias("units"), p.alias("predicted_units"), band.alias("velocity_band"), "lag_2", "roll4")
    scored = scored.join(up, "velocity_band", "left").withColumn("order_quantity", F.greatest(F.col("predicted_units"), F.col("predicted_units") + F.coalesce("extra", F.lit(0.0)))).drop("extra")
    values = ["units", "predicted_units", "velocity_band", "lag_2", "roll4", "order_quantity"]
    if runs is not None:
        steps = scored.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("week_seq", *values))).alias("_steps"))
        ahead = runs.where(F.col("until") > train_until).select("store_id", "plu", "week_seq", "until", "series").join(steps, "series")
        weeks = F.explode(F.sequence(F.greatest(F.col("week_seq"), F.lit(train_until + 1)), "until"))
        own = F.get("_steps", F.least(F.col("_week") - F.col("week_seq"), F.lit(LOOK_BACK + 1)).cast("int"))
        ahead = ahead.withColumn("_week", weeks).select("store_id", "plu", F.col("_week").alias("week_seq"), own.alias("_own"))
        scored = ahead.select("store_id", "plu", "week_seq", *[F.col("_own")[c].alias(c) for c in values])
    return scored.select("store_id", F.when(seen, "Y").otherwise("N").alias("seen_store"), "plu", "week_seq", *values)


PO_NUMS = ["expected_lead_days", "ordered_units", "line_count", "po_value_cost", "mo"]
PO_CATS = ["store_id"]


def supplier_reliability(po: DataFrame, train_until: int, trees: int = MOST_TREES) -> tuple[DataFrame, DataFrame]:
    """ML-29: lead-time and on-time models against the order's own expectation
    and the mean of the training rows; buffer days and risk band per order."""
    base = po.withColumn("mo", F.col("yyyymm") % 100).withColumn("lead", F.col("actual_lead_days").cast("double")).withColumn("ontime", F.when(F.col("on_time") == "Y", 1.0).otherwise(0.0))
    table = cut_lineage(prepared(base, PO_NUMS, PO_CATS))
    train, test = table.where(F.col("yyyymm") <= train_until), table.where(F.col("yyyymm") > train_until)
    lead = fitted(train, PO_NUMS, PO_CATS, "lead", False, F.col("po_number"), trees)
    clf = fitted(train, PO_NUMS, PO_CATS, "ontime", True, F.col("po_number"), trees)
    mean = train.agg(F.avg("lead").alias("m")).scalar()
    scored = lead.transform(test).select(*table.columns, F.greatest(F.lit(0.0), "prediction").alias("predicted_lead"))
    scored = cut_lineage(probability(clf, scored, "p_on_time").select("po_number", "supplier_id", "lead", "ontime", "expected_lead_days", "predicted_lead", "p_on_time").withColumn("train_mean", mean))
    rows = sc.baselines(scored, "lead", {"model": "predicted_lead", "order_expectation": "expected_lead_days", "train_mean": "train_mean"})
    auc = sc.clf_metrics(scored, "ontime", "p_on_time", "po_number").select("auc_roc").scalar()
    metrics = beside_baselines(rows, "model", "mae", more=False, scorer="baseline").withColumn("on_time_auc", F.when(F.col("baseline") == "model", auc))
    q = exact_quantiles(scored.withColumn("resid", F.col("lead") - F.col("predicted_lead")), "resid", {"q": 0.9}).scalar()
    miss = scored.agg(F.avg(1.0 - F.col("p_on_time")).alias("m")).scalar()
    buffer = F.least(F.lit(14.0), F.greatest(F.lit(0.0), q * (1.0 - F.col("p_on_time")) / F.greatest(F.lit(1e-6), miss)))
    band = F.when(F.col("p_on_time") <= 0.5, "high risk").when(F.col("p_on_time") <= 0.8, "watch").otherwise("reliable")
    return metrics, scored.select("po_number", "supplier_id", fixed(F.col("predicted_lead"), 3).alias("predicted_lead"), fixed(F.col("p_on_time"), 4).alias("p_on_time"), fixed(buffer, 2).alias("recommended_buffer_days"), band.alias("risk_band"))
