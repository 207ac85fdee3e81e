"""Registered queries for closed-form analytics (ML-01..12, 14..18, 20..22, 28, 30; MRT-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopledger.functions import fixed, money, pct, safe_div
from shopledger.operators import windows as wn
from shopledger.operators.aggregates import mode_of
from shopledger.plans import anomaly as an
from shopledger.plans import baskets as bk
from shopledger.plans import demand as dm
from shopledger.plans import marketing as mk
from shopledger.plans import pricing as pr
from shopledger.plans import repeat_buying as rb
from shopledger.plans import scoring as sc
from shopledger.plans.customers import ipt_stats
from shopledger.queries.common import EV, EVENTS, L, LT, LTM, div, fx, m, n
from shopledger.queries.common import pct as spct
from shopledger.queries.q_customers import CHURN, IPT, RFM, churn_set, kpi, last_day
from shopledger.queries.q_finance import SHRINK
from shopledger.queries.q_windows import DENSE, dense_days
from shopledger.queries.registry import query
from shopledger.sources import inputs, retail
from shopledger.sources.tables import read_table

CUT = "1999-07-01"
ITEMS = "items AS (SELECT DISTINCT txn_id AS basket, plu, sale_date FROM sales_lines WHERE quantity > 0), train AS (SELECT basket, plu FROM items WHERE sale_date < DATE '1999-07-01'), cnt AS (SELECT plu, count(*) AS baskets FROM train GROUP BY 1), sz AS (SELECT basket FROM train GROUP BY 1 HAVING count(*) >= 2)"


def items(spark, sf):
    return retail.sales_lines(spark, sf, product=False, store=False).where("quantity > 0").select(F.col("txn_id").alias("basket"), "plu", "sale_date")


PAIRS = f"{ITEMS}, pairs AS (SELECT a.plu AS item_a, b.plu AS item_b, count(*) AS pair_baskets FROM train a JOIN train b ON a.basket = b.basket AND a.plu < b.plu JOIN sz ON sz.basket = a.basket GROUP BY 1, 2)"


@query("ml01_pair_counts", f"{L}, {PAIRS} SELECT * FROM pairs")
def _(spark, sf):
    return bk.pair_counts(items(spark, sf), CUT)


SCORES = f"""{PAIRS}, one AS (SELECT item_a, item_b, pair_baskets, CAST({fx('(CAST(pair_baskets AS DOUBLE) / sqrt(CAST(a.baskets AS DOUBLE) * CAST(b.baskets AS DOUBLE)))', 9)} AS DECIMAL(12,9)) AS cosine,
 CASE WHEN pair_baskets >= 2 THEN {fx('(CAST(pair_baskets AS DOUBLE) * CAST(t.t AS DOUBLE) / (CAST(a.baskets AS DOUBLE) * CAST(b.baskets AS DOUBLE)))', 6)} ELSE 0.0::DOUBLE END AS lift, {fx('(100.0::DOUBLE * CAST(pair_baskets AS DOUBLE) / CAST(t.t AS DOUBLE))', 6)} AS support_pct
 FROM pairs JOIN cnt a ON a.plu = item_a JOIN cnt b ON b.plu = item_b CROSS JOIN (SELECT sum(baskets) AS t FROM cnt) t),
scores AS (SELECT item_a AS plu, item_b AS rec_plu, pair_baskets, cosine, lift, support_pct FROM one UNION ALL SELECT item_b, item_a, pair_baskets, cosine, lift, support_pct FROM one)"""


def scores(spark, sf):
    it = items(spark, sf)
    return bk.pair_scores(bk.pair_counts(it, CUT), bk.item_counts(it, CUT), min_support=2)


@query("ml02_pair_scores", f"{L}, {SCORES} SELECT plu, rec_plu, pair_baskets, CAST(cosine AS DOUBLE) AS cosine, lift, support_pct FROM scores")
def _(spark, sf):
    return scores(spark, sf).withColumn("cosine", F.col("cosine").cast("double"))


@query("ml03_companions", f"""{L}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY plu ORDER BY cosine DESC, rec_plu) AS rank FROM scores WHERE cosine > 0)
SELECT r.plu, r.rec_plu, pair_baskets, CAST(cosine AS DOUBLE) AS cosine, lift, support_pct, rank, p.product_name AS rec_product_name, p.category AS rec_category, CASE WHEN o.category = p.category THEN 'Y' ELSE 'N' END AS same_category
FROM r JOIN products p ON p.plu = rec_plu JOIN products o ON o.plu = r.plu WHERE rank <= 5""")
def _(spark, sf):
    out = bk.recommend(scores(spark, sf), retail.products(spark, sf), 5)
    return out.withColumn("cosine", F.col("cosine").cast("double")).withColumn("rank", F.col("rank").cast("bigint"))


@query("ml04_leave_one_out", f"""{L}, {SCORES}, test AS (SELECT basket, plu FROM items WHERE sale_date >= DATE '1999-07-01'), tg AS (SELECT basket, count(*) AS n, arg_min(plu, (md5(basket || '|' || plu || '|hide'), plu)) AS target FROM test GROUP BY 1 HAVING count(*) >= 2),
vis AS (SELECT t.basket, t.plu FROM test t JOIN tg ON tg.basket = t.basket AND t.plu <> tg.target), ni AS (SELECT count(*) AS n FROM cnt),
cand AS (SELECT v.basket, s.rec_plu, sum(s.cosine) AS score FROM vis v JOIN scores s ON s.plu = v.plu WHERE NOT EXISTS (SELECT 1 FROM vis x WHERE x.basket = v.basket AND x.plu = s.rec_plu) GROUP BY 1, 2),
own AS (SELECT c.basket, c.score FROM cand c JOIN tg ON tg.basket = c.basket AND tg.target = c.rec_plu),
rk AS (SELECT c.basket, count(*) FILTER (WHERE c.score > o.score OR (c.score = o.score AND c.rec_plu < tg.target)) + 1 AS rank FROM cand c JOIN own o USING (basket) JOIN tg USING (basket) GROUP BY 1),
pp AS (SELECT plu, row_number() OVER (ORDER BY baskets DESC, plu) AS pop_rank FROM cnt),
ranks AS (SELECT 'cosine' AS scorer, coalesce(rank, ni.n - tg.n + 1) AS r FROM tg LEFT JOIN rk USING (basket), ni
 UNION ALL SELECT 'popularity', coalesce(p.pop_rank - (SELECT count(*) FROM vis v JOIN pp q ON q.plu = v.plu WHERE v.basket = tg.basket AND q.pop_rank < p.pop_rank), ni.n - tg.n + 1) FROM tg LEFT JOIN pp p ON p.plu = tg.target, ni)
SELECT scorer, count(*) AS n, {div('count(*) FILTER (WHERE r <= 1)', 'count(*)', 6)} AS hit_1, {div('count(*) FILTER (WHERE r <= 5)', 'count(*)', 6)} AS hit_5, {div('count(*) FILTER (WHERE r <= 10)', 'count(*)', 6)} AS hit_10,
{div(f"sum(CAST({fx('(1.0::DOUBLE / CAST(r AS DOUBLE))', 9)} AS DECIMAL(12,9)))", 'count(*)', 6)} AS mrr FROM ranks GROUP BY 1""")
def _(spark, sf):
    it = items(spark, sf)
    return bk.evaluate_reco(it, scores(spark, sf), bk.item_counts(it, CUT), CUT)


PRICES = """prices AS (SELECT category, category || '/' || sub_category AS item, (yyyymm // 100) * 12 + yyyymm % 100 AS month_seq, sum(quantity) AS units, CAST(sum(sales) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS price, CAST(sum(cost) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS cost FROM sales_lines GROUP BY 1, 2, 3),
lg AS (SELECT item, month_seq, ln(units) AS q, ln(price) AS p FROM prices WHERE units > 0 AND price > 0), df0 AS (SELECT item, month_seq, q - lag(q) OVER w AS dq, p - lag(p) OVER w AS dp, month_seq - lag(month_seq) OVER w AS gap FROM lg WINDOW w AS (PARTITION BY item ORDER BY month_seq)),
panel AS (SELECT item, month_seq, dq - avg(dq) OVER (PARTITION BY month_seq) AS dq, dp - avg(dp) OVER (PARTITION BY month_seq) AS dp FROM df0 WHERE gap = 1)"""


def prices(spark, sf):
    df = retail.sales_lines(spark, sf, store=False)
    seq = F.floor(F.col("yyyymm") / 100) * 12 + F.col("yyyymm") % 100
    return df.groupBy("category", F.concat_ws("/", "category", "sub_category").alias("item"), seq.cast("int").alias("month_seq")).agg(
        F.sum("quantity").alias("units"), safe_div(F.sum("sales"), F.sum("quantity")).alias("price"), safe_div(F.sum("cost"), F.sum("quantity")).alias("cost")
    )


def panel(spark, sf):
    return pr.elasticity_panel(prices(spark, sf))


@query("ml05_elasticity_panel", f"{L}, {PRICES} SELECT item, month_seq, {fx('dq', 6)} AS dq, {fx('dp', 6)} AS dp FROM panel")
def _(spark, sf):
    return panel(spark, sf).select("item", "month_seq", fixed(F.col("dq"), 6).alias("dq"), fixed(F.col("dp"), 6).alias("dp"))


OLS = """og AS (SELECT item, count(*) AS n_diffs, count(*) FILTER (WHERE abs(dp) > 0.005) AS moves, sum(dp * dp) AS sxx, sum(dp * dq) AS sxy, sum(dq * dq) AS syy FROM panel WHERE month_seq < 24000 GROUP BY 1),
ols AS (SELECT item, n_diffs, moves, CASE WHEN n_diffs >= 6 AND sxx > 1e-12 THEN sxy / sxx END AS beta, CASE WHEN n_diffs >= 6 AND sxx > 1e-12 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n_diffs - 1) / sxx) END AS se, CASE WHEN n_diffs >= 6 AND sxx > 1e-12 AND syy > 1e-12 THEN 1 - greatest(0, syy - sxy * sxy / sxx) / syy END AS r2 FROM og)"""


def est(spark, sf):
    return pr.ols0(panel(spark, sf).where("month_seq < 24000"), "item", "dp", "dq")


@query("ml06_slope_through_origin", f"{L}, {PRICES}, {OLS} SELECT item, n_diffs, moves, {fx('beta', 5)} AS beta, {fx('se', 5)} AS se, {fx('r2', 5)} AS r2 FROM ols")
def _(spark, sf):
    return est(spark, sf).select("item", "n_diffs", "moves", *[fixed(F.col(c), 5).alias(c) for c in ("beta", "se", "r2")])


EB = """eb0 AS (SELECT *, split_part(item, '/', 1) AS category, beta IS NOT NULL AND se > 0 AS ok FROM ols), ebg AS (SELECT category, count(*) FILTER (WHERE ok) AS k, sum(CASE WHEN ok THEN beta / (se * se) END) / sum(CASE WHEN ok THEN 1.0::DOUBLE / (se * se) END) AS wb, avg(CASE WHEN ok THEN beta END) AS mb, var_samp(CASE WHEN ok THEN beta END) AS vb, avg(CASE WHEN ok THEN se * se END) AS noise FROM eb0 GROUP BY 1),
ebt AS (SELECT category, CASE WHEN k >= 3 THEN wb ELSE mb END AS ce, CASE WHEN k >= 3 THEN greatest(vb - noise, 0) END AS t2 FROM ebg),
ebw AS (SELECT e.*, ce, CASE WHEN se IS NOT NULL THEN CASE WHEN t2 IS NULL OR t2 <= 0 THEN 0 ELSE t2 / (t2 + se * se) END END AS sw FROM eb0 e JOIN ebt USING (category)),
eb AS (SELECT item, category, n_diffs, beta, se, ce AS category_elasticity, sw AS shrink_weight, CASE WHEN beta IS NOT NULL AND sw IS NOT NULL THEN sw * beta + (1 - sw) * ce ELSE ce END AS elasticity_shrunk FROM ebw)"""


def shrunk(spark, sf):
    return pr.eb_shrink(est(spark, sf).withColumn("category", F.substring_index("item", "/", 1)), "category")


@query("ml07_shrunk_slopes", f"{L}, {PRICES}, {OLS}, {EB} SELECT item, category, {fx('category_elasticity', 5)} AS category_elasticity, {fx('shrink_weight', 5)} AS shrink_weight, {fx('elasticity_shrunk', 5)} AS elasticity_shrunk FROM eb")
def _(spark, sf):
    return shrunk(spark, sf).select("item", "category", *[fixed(F.col(c), 5).alias(c) for c in ("category_elasticity", "shrink_weight", "elasticity_shrunk")])


@query("ml08_out_of_time_validation", f"""{L}, {PRICES}, {OLS}, {EB}, v AS (SELECT elasticity_shrunk * dp AS pred, dq FROM panel JOIN eb USING (item) WHERE month_seq >= 24000 AND elasticity_shrunk IS NOT NULL)
SELECT count(*) AS n, {fx('corr(pred, dq)', 5)} AS corr_pred_actual, {fx('(1 - sum((dq - pred) * (dq - pred)) / sum(dq * dq))', 5)} AS r2_vs_null, {fx('(sum(pred * dq) / sum(pred * pred))', 5)} AS calibration_slope FROM v""")
def _(spark, sf):
    out = pr.validate_elasticity(panel(spark, sf).where("month_seq >= 24000"), shrunk(spark, sf), "item")
    return out.select("n", *[fixed(F.col(c), 5).alias(c) for c in ("corr_pred_actual", "r2_vs_null", "calibration_slope")])


@query("ml09_pricing_signal", f"""{L}, {PRICES}, {OLS}, {EB}, a AS (SELECT item, sum(units * price) / sum(units) AS price, sum(units * cost) / sum(units) AS cost, CAST(sum(units) AS DOUBLE) / count(*) AS units FROM prices GROUP BY 1), j AS (SELECT *, elasticity_shrunk AS e, elasticity_shrunk * 0.8::DOUBLE AS ec FROM eb JOIN a USING (item))
SELECT item, {fx('ec', 5)} AS elasticity_calibrated, CASE WHEN e < -1.5 THEN 'highly elastic' WHEN e < -1.0 THEN 'elastic' WHEN e < -0.3 THEN 'inelastic' WHEN e >= -0.3 THEN 'very inelastic' ELSE 'unknown' END AS demand_band, CASE WHEN ec < -1.0 THEN {fx('(cost * ec / (1.0 + ec))', 2)} END AS optimal_price,
{fx('((units * (1 + ec * 0.05::DOUBLE) * (price * 1.05::DOUBLE - cost) - units * (price - cost)) * 12)', 1)} AS margin_delta_up5, CASE WHEN beta IS NULL THEN 'not identified - insufficient price variation' WHEN e >= -0.3 THEN 'very inelastic - price rise candidate, test first' WHEN e >= -1.0 THEN 'inelastic - modest price rise may pay, test first'
 WHEN e >= -1.5 THEN 'near unit elastic - hold price' WHEN e < -1.5 THEN 'elastic - protect price, promote to drive volume' ELSE 'unknown' END AS pricing_signal FROM j""")
def _(spark, sf):
    u = F.col("units")
    avg = prices(spark, sf).groupBy("item").agg((F.sum(u * F.col("price")) / F.sum(u)).alias("avg_price"), (F.sum(u * F.col("cost")) / F.sum(u)).alias("avg_cost"), (F.sum(u).cast("double") / F.count("*")).alias("avg_units"))
    out = pr.pricing_signal(shrunk(spark, sf).join(avg, "item"), 0.8)
    return out.select("item", fixed(F.col("elasticity_calibrated"), 5).alias("elasticity_calibrated"), "demand_band", fixed(F.col("optimal_price"), 2).alias("optimal_price"), fixed(F.col("margin_delta_up5"), 1).alias("margin_delta_up5"), "pricing_signal")


CELLS = f"""{SHRINK}, sg AS (SELECT store_id, category, yyyymm, CAST(sum(qty_lost) AS BIGINT) AS shrink_units, sum(shrink_value) AS sv, count(*) AS shrink_events FROM shrink GROUP BY 1, 2, 3), sl AS (SELECT store_id, category, yyyymm, sum(sales) AS sales FROM sales_lines GROUP BY 1, 2, 3),
st AS (SELECT store_id, category, yyyymm, reason, sum(shrink_value) AS rv, row_number() OVER (PARTITION BY store_id, category, yyyymm ORDER BY sum(shrink_value) DESC, reason) AS rk FROM shrink GROUP BY 1, 2, 3, 4),
cells AS (SELECT sg.store_id, sg.category, sg.yyyymm, shrink_units, CAST(sv AS DOUBLE) AS shrink_value, shrink_events, CAST(sales AS DOUBLE) AS sales_value, reason AS top_reason, CAST(rv AS DOUBLE) / CAST(sv AS DOUBLE) AS top_reason_share, CAST(sv AS DOUBLE) / CAST(sales AS DOUBLE) AS shrink_rate
 FROM sg JOIN sl USING (store_id, category, yyyymm) JOIN st ON st.store_id = sg.store_id AND st.category = sg.category AND st.yyyymm = sg.yyyymm AND rk = 1 WHERE sales >= 250),
m1 AS (SELECT category, yyyymm, median(shrink_rate) AS med, stddev_pop(shrink_rate) AS sd FROM cells GROUP BY 1, 2), m2 AS (SELECT category, yyyymm, median(abs(shrink_rate - med)) * 1.4826 AS mad FROM cells JOIN m1 USING (category, yyyymm) GROUP BY 1, 2),
zc AS (SELECT cells.*, med, CASE WHEN mad > 1e-9 THEN (shrink_rate - med) / mad WHEN sd > 1e-9 THEN (shrink_rate - med) / sd ELSE 0 END AS robust_z FROM cells JOIN m1 USING (category, yyyymm) JOIN m2 USING (category, yyyymm))"""


def cells(spark, sf):
    sales = retail.sales_lines(spark, sf, store=False).groupBy("store_id", "category", "yyyymm").agg(F.sum("sales").alias("sales_value"))
    return an.shrink_cells(inputs.shrink_log(spark, sf), sales, 250)


def z_cells(spark, sf):
    return an.robust_z(cells(spark, sf), ["category", "yyyymm"], "shrink_rate")


@query("ml10_robust_z", f"{L}, {CELLS} SELECT store_id, category, yyyymm, shrink_units, shrink_value, shrink_events, top_reason, {fx('top_reason_share', 6)} AS top_reason_share, {fx('shrink_rate', 6)} AS shrink_rate, {fx('med', 6)} AS peer_median, {fx('robust_z', 4)} AS robust_z FROM zc")
def _(spark, sf):
    return z_cells(spark, sf).select("store_id", "category", "yyyymm", "shrink_units", "shrink_value", "shrink_events", "top_reason", *[fixed(F.col(c), s).alias(c) for c, s in (("top_reason_share", 6), ("shrink_rate", 6), ("peer_median", 6), ("robust_z", 4))])


def anomaly_features(spark, sf):
    z = z_cells(spark, sf)
    z = z.withColumn("excess_shrink_value", F.greatest(F.lit(0.0), (F.col("shrink_rate") - F.col("peer_median")) * F.col("sales_value")))
    from pyspark.sql import Window

    prev = F.lag("shrink_rate").over(Window.partitionBy("store_id", "category").orderBy("yyyymm"))
    return z.withColumn("rate_trend", F.col("shrink_rate") - prev)


FEATS = ["shrink_rate", "robust_z", "shrink_events", "shrink_units", "top_reason_share", "rate_trend", "excess_shrink_value"]


def flagged(spark, sf, trees=300):
    keys = ["store_id", "category", "yyyymm"]
    scored = an.iforest(anomaly_features(spark, sf), FEATS, keys, trees)
    return an.flag_cells(scored)


@query("ml11_isolation_forest")
def _(spark, sf):
    return flagged(spark, sf).select("store_id", "category", "yyyymm", F.round("iforest_score", 6).alias("iforest_score"), F.round("robust_z", 4).alias("robust_z"), "flag_source", "flagged")


FLAGZ = "fz AS (SELECT *, CASE WHEN robust_z >= 3.5 THEN 'Y' ELSE 'N' END AS flagged FROM zc), hp AS (SELECT store_id, category, max(CASE WHEN yyyymm <= 199804 AND flagged = 'Y' THEN 1 ELSE 0 END) AS f1, max(CASE WHEN yyyymm > 199804 AND flagged = 'Y' THEN 1 ELSE 0 END) AS f2, max(CASE WHEN yyyymm > 199804 THEN 1 ELSE 0 END) AS i2 FROM fz GROUP BY 1, 2)"


@query("ml12_flag_stability", f"""{L}, {CELLS}, {FLAGZ}, h AS (SELECT {n('sum(f1)')} AS h1_flagged, {n('sum(f2)')} AS h2_flagged, {n('sum(f1 * f2)')} AS repeated, {n('sum(i2)')} AS h2_pairs FROM hp),
o AS (SELECT count(*) AS cells, count(*) FILTER (WHERE flagged = 'Y') AS flagged_cells, {div("sum(CASE WHEN flagged = 'Y' THEN CAST(shrink_rate AS DECIMAL(28,8)) END)", "count(*) FILTER (WHERE flagged = 'Y')", 6)} AS flagged_mean_rate, {div("sum(CASE WHEN flagged = 'N' THEN CAST(shrink_rate AS DECIMAL(28,8)) END)", "count(*) FILTER (WHERE flagged = 'N')", 6)} AS unflagged_mean_rate,
 {div("sum(CASE WHEN flagged = 'Y' THEN CAST(shrink_value AS DECIMAL(28,8)) END)", 'sum(CAST(shrink_value AS DECIMAL(28,8)))', 6)} AS flagged_share_of_value, {div("count(*) FILTER (WHERE flagged = 'Y')", 'count(*)', 6)} AS flagged_share_of_cells FROM fz)
SELECT o.*, h.*, {div('repeated', 'h1_flagged', 6)} AS repeat_rate, {div('h2_flagged', 'h2_pairs', 6)} AS chance_rate FROM o, h""")
def _(spark, sf):
    z = z_cells(spark, sf).withColumn("flagged", F.when(F.col("robust_z") >= an.Z_FLAG, "Y").otherwise("N"))
    return an.flag_stability(z, 199804)


PARAMS = {"r": 0.9, "alpha": 40.0, "a": 0.7, "b": 3.0}


@query("ml14_probability_alive", f"""{LT}, {CHURN} SELECT as_of, customer_id, {fx('(1.0::DOUBLE / (1.0::DOUBLE + CASE WHEN bgnbd_frequency > 0 THEN (0.7::DOUBLE / (3.0::DOUBLE + bgnbd_frequency - 1.0::DOUBLE)) * pow((40.0::DOUBLE + bgnbd_t / 7.0::DOUBLE) / (40.0::DOUBLE + bgnbd_recency / 7.0::DOUBLE), 0.9::DOUBLE + bgnbd_frequency) ELSE 0.0::DOUBLE END))', 6)} AS p_alive FROM churn""")
def _(spark, sf):
    c = churn_set(spark, sf)
    p = sc.p_alive(F.col("bgnbd_frequency"), F.col("bgnbd_recency") / F.lit(7.0), F.col("bgnbd_t") / F.lit(7.0), PARAMS)
    return c.select("as_of", "customer_id", fixed(p, 6).alias("p_alive"))


CANDS = [(1.0, 10.0, 1.0, 3.0), (0.9, 40.0, 0.7, 3.0), (0.5, 20.0, 0.4, 2.0)]


def _nll_sql(i, c):
    r, al, a, b = (f"{v}::DOUBLE" for v in c)
    head = f"lgamma({r} + x) - lgamma({r}) + {r} * ln({al}) + lgamma({a} + {b}) + lgamma({b} + x) - lgamma({b}) - lgamma({a} + {b} + x)"
    e1, e2 = f"-({r} + x) * ln({al} + t)", f"(ln({a}) - ln({b} + x - 1) - ({r} + x) * ln({al} + tx))"
    return f"SELECT {i} AS candidate, {fx(f'(-sum({head} + {e1} + ln(1 + exp({e2} - ({e1})))))', 2)} AS nll FROM hist"


@query("ml14_likelihood", f"""{LT}, {CHURN}, hist AS (SELECT CAST(bgnbd_frequency AS DOUBLE) AS x, bgnbd_recency / 7.0::DOUBLE AS tx, bgnbd_t / 7.0::DOUBLE AS t FROM churn WHERE as_of = 2451726) {" UNION ALL ".join(_nll_sql(i, c) for i, c in enumerate(CANDS))}""")
def _(spark, sf):
    c = churn_set(spark, sf).where("as_of = 2451726").select(F.col("bgnbd_frequency").alias("x"), (F.col("bgnbd_recency") / F.lit(7.0)).alias("t_x"), (F.col("bgnbd_t") / F.lit(7.0)).alias("t"))
    return rb.bgnbd_nll(c, CANDS).select("candidate", fixed(F.col("nll"), 2).alias("nll"))


@query("ml14_fitted_lifetimes")
def _(spark, sf):
    from shopledger.plans.learning import churn_histories

    fit = rb.bgnbd_fit(churn_histories(churn_set(spark, sf)))
    row = (*(round(fit.params[p], 3) for p in rb.PARAMS), round(fit.nll, 1), fit.converged, fit.customers)
    return spark.createDataFrame([row], "r double, alpha double, a double, b double, nll double, converged boolean, customers long")


OD = "od AS (SELECT CAST(as_of AS BIGINT) * 10000000000 + customer_id AS id, churn_adaptive AS y, round(overdue_ratio / (1 + overdue_ratio), 4) AS p FROM churn WHERE churn_adaptive IS NOT NULL)"


def overdue_scores(spark, sf):
    c = churn_set(spark, sf).where("churn_adaptive IS NOT NULL")
    return c.select((F.col("as_of").cast("bigint") * 10_000_000_000 + F.col("customer_id")).alias("id"), F.col("churn_adaptive").alias("y"), F.round(F.col("overdue_ratio") / (1 + F.col("overdue_ratio")), 4).alias("p"))


@query("ml15_classification_metrics", f"""{LT}, {CHURN}, {OD}, g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM od GROUP BY 1), w AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS nb, sum(pos) OVER (ORDER BY p DESC) AS pa, sum(pos + neg) OVER (ORDER BY p DESC) AS na FROM g),
top10 AS (SELECT y FROM od ORDER BY p DESC, id LIMIT (SELECT greatest(1, count(*) // 10) FROM od))
SELECT (SELECT count(*) FROM od) AS n, (SELECT {div('sum(y)', 'count(*)', 6)} FROM od) AS positive_rate, (SELECT {fx('avg((p - y) * (p - y))', 6)} FROM od) AS brier, {fx('(sum(pos * (nb + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)))', 6)} AS auc_roc,
{fx('(sum(CAST(pos AS DOUBLE) * CAST(pa AS DOUBLE) / CAST(na AS DOUBLE)) / CAST(sum(pos) AS DOUBLE))', 6)} AS auc_pr, (SELECT {fx(f"(avg(y) / (SELECT {div('sum(y)', 'count(*)', 6)} FROM od))", 4)} FROM top10) AS top_decile_lift FROM w""")
def _(spark, sf):
    return sc.clf_metrics(overdue_scores(spark, sf), "y", "p", "id")


@query("ml16_calibration_table", f"{LT}, {CHURN}, {OD}, d AS (SELECT *, ntile(10) OVER (ORDER BY p, id) AS bin FROM od) SELECT bin, count(*) AS n, {fx('avg(p)', 6)} AS pred, {fx('avg(CAST(y AS DOUBLE))', 6)} AS actual FROM d GROUP BY 1")
def _(spark, sf):
    return sc.calibration(overdue_scores(spark, sf), "y", "p", "id")


def _regm(y, p):
    e = f"abs({y} - greatest(0, {p}))"
    return f"""count(*) AS n, {fx(f'avg({e})', 6)} AS mae, {fx(f'sqrt(avg({e} * {e}))', 6)} AS rmse, {fx(f'(sum({e}) / sum(abs({y})))', 6)} AS wape, {fx(f'avg(CASE WHEN {y} <> 0 THEN {e} / abs({y}) END)', 6)} AS mape,
{fx(f'(1 - sum({e} * {e}) / (sum({y} * {y}) - sum({y}) * sum({y}) / count(*)))', 6)} AS r2, {fx(f'avg(greatest(0, {p}) - {y})', 6)} AS bias"""


@query("ml17_regression_metrics", f"{DENSE}, f AS (SELECT store_id, u AS y, lag(u, 7) OVER (PARTITION BY store_id ORDER BY t) AS p FROM w) SELECT store_id, {_regm('y', 'p')} FROM f WHERE p IS NOT NULL GROUP BY 1")
def _(spark, sf):
    from pyspark.sql import Window

    f = dense_days(spark, sf).withColumn("p", F.lag("u", 7).over(Window.partitionBy("store_id").orderBy("t")))
    return sc.reg_metrics(f, "u", "p", ["store_id"])


@query("ml18_baseline_table", f"""{DENSE}, f AS (SELECT u AS y, lag(u, 14) OVER p AS a, CASE WHEN count(u) OVER r >= 2 THEN avg(u) OVER r END AS b FROM w WINDOW p AS (PARTITION BY store_id ORDER BY t), r AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND 14 PRECEDING)),
l AS (SELECT 'lag14' AS baseline, y, a AS p FROM f UNION ALL SELECT 'roll7', y, b FROM f) SELECT baseline, {_regm('y', 'p')} FROM l WHERE p IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    f = wn.roll_mean(wn.lags(dense_days(spark, sf), ["store_id"], "t", "u", [14]), ["store_id"], "t", "u", 7, 14, "roll7")
    return sc.baselines(f, "u", {"lag14": "lag_14", "roll7": "roll7"})


@query("ml20_category_codes", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1.0::DOUBLE AS p_type, dense_rank() OVER (ORDER BY p_brand) - 1.0::DOUBLE AS p_brand FROM part")
def _(spark, sf):
    enc, _maps = sc.encode(read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])
    return enc


STATS = {"days_since_last": (200.0, 150.0, 0.08, 1), "purchase_days_l180": (1.0, 0.8, 0.05, -1), "tenure_days": (1000.0, 500.0, 0.02, -1), "overdue_ratio": (0.9, 1.2, 0.1, 1)}


def _drv(c, med, sd, w, s):
    return f"{{'s': -least(4.0::DOUBLE, greatest(-4.0::DOUBLE, (CAST({c} AS DOUBLE) - {med}::DOUBLE) / {sd}::DOUBLE * {s}.0::DOUBLE)) * {w}::DOUBLE, 'n': '{c.replace('_', ' ')}'}}"


DRV = f"list_sort([{', '.join(_drv(c, *v) for c, v in STATS.items())}])"


@query("ml21_row_drivers", f"""{LT}, {CHURN}, d AS (SELECT as_of, customer_id, {DRV} AS b FROM churn) SELECT as_of, customer_id, CASE WHEN b[1].s < 0 THEN b[1].n ELSE '' END AS driver_1, CASE WHEN b[2].s < 0 THEN b[2].n ELSE '' END AS driver_2, CASE WHEN b[3].s < 0 THEN b[3].n ELSE '' END AS driver_3 FROM d""")
def _(spark, sf):
    return sc.drivers(churn_set(spark, sf), STATS).select("as_of", "customer_id", "driver_1", "driver_2", "driver_3")


RISK = f"""rk0 AS (SELECT c.*, {fx('(overdue_ratio / (1.0::DOUBLE + overdue_ratio))', 4)} AS churn_probability, {DRV} AS b FROM churn c WHERE is_scoring_row = 'Y'),
rk1 AS (SELECT *, CASE WHEN churn_probability >= 0.70 THEN 'Critical' WHEN churn_probability >= 0.45 THEN 'High' WHEN churn_probability >= 0.25 THEN 'Watch' ELSE 'Low' END AS risk_band, {fx('(churn_probability * margin_l180)')} AS ltv_at_risk, CASE WHEN b[1].s < 0 THEN b[1].n ELSE '' END AS driver_1 FROM rk0),
risk AS (SELECT customer_id, churn_probability, overdue_ratio, risk_band, ltv_at_risk, driver_1, CASE WHEN risk_band NOT IN ('High', 'Critical') THEN 'None' WHEN coalesce(promo_share_l180, 0) >= 50 THEN 'Win-back offer' WHEN txns_l180 > 0 THEN 'Loyalty bonus' ELSE 'Win-back offer' END AS recommended_action FROM rk1)"""


def risk(spark, sf):
    from shopledger.queries.q_customers import SCORING

    c = churn_set(spark, sf).where(F.col("as_of") == SCORING)
    c = c.withColumn("churn_probability", fixed(F.col("overdue_ratio") / (F.lit(1.0) + F.col("overdue_ratio")), 4))
    c = c.withColumn("points_earned_l180", F.col("txns_l180"))
    out = sc.risk_actions(sc.drivers(c, STATS), "churn_probability", "margin_l180")
    return out.select("customer_id", "churn_probability", "overdue_ratio", "risk_band", "ltv_at_risk", "driver_1", "recommended_action")


@query("ml22_risk_and_action", f"{LT}, {CHURN}, {RISK} SELECT * FROM risk")
def _(spark, sf):
    return risk(spark, sf)


DCH = f"""{RISK}, {RFM}, cr AS (SELECT c_custkey AS customer_id, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), gaps2 AS (SELECT customer_id, jdn, jdn - lag(jdn) OVER (PARTITION BY customer_id ORDER BY jdn) AS gap FROM days),
nx2 AS (SELECT customer_id, CASE WHEN count(*) >= 2 THEN max(jdn) + CAST(trunc(median(gap)) AS BIGINT) END AS expected_next_jdn FROM gaps2 GROUP BY 1),
dch AS (SELECT risk.*, cr.region, loyalty_tier, expected_next_jdn FROM risk JOIN cr USING (customer_id) JOIN rfm USING (customer_id) LEFT JOIN nx2 USING (customer_id))"""


def churn_mart(spark, sf):
    from shopledger.plans.customers import rfm

    store = retail.stores(spark, sf).select("store_id", "region")
    cust = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").cast("int").alias("store_id"))
    who = cust.join(store, "store_id").drop("store_id").join(rfm(kpi(spark, sf)).select("customer_id", "loyalty_tier"), "customer_id")
    return mk.dash_churn(risk(spark, sf), who, ipt_stats(retail.transactions(spark, sf), last_day(spark, sf)))


@query("mrt17_churn_mart", f"{LT}, {CHURN}, {DCH} SELECT * FROM dch")
def _(spark, sf):
    return churn_mart(spark, sf).drop("lifecycle_status")


LTV = "CAST(ltv_at_risk AS DECIMAL(18,2))"


@query("mrt17_churn_kpi", f"""{LT}, {CHURN}, {RISK} SELECT count(*) AS scored_customers, {spct("count(*) FILTER (WHERE risk_band IN ('Critical', 'High'))", 'count(*)')} AS critical_high_pct, {m(f"sum(CASE WHEN risk_band IN ('Critical', 'High') THEN {LTV} ELSE 0 END)")} AS ltv_at_risk,
{spct('count(*) FILTER (WHERE overdue_ratio > 1)', 'count(*)')} AS pct_overdue, {div('sum(CAST(churn_probability AS DECIMAL(10,4)))', 'count(*)', 4)} AS avg_churn_prob FROM risk""")
def _(spark, sf):
    return mk.churn_tiles(risk(spark, sf))["kpi"]


@query("mrt17_churn_tiles", f"""{LT}, {CHURN}, {RISK} SELECT 'band' AS tile, risk_band AS member, count(*) AS customers, {m(f'sum({LTV})')} AS ltv_at_risk FROM risk GROUP BY 2
UNION ALL SELECT 'action', recommended_action, count(*), {m(f'sum({LTV})')} FROM risk WHERE recommended_action <> 'None' GROUP BY 2 UNION ALL SELECT 'driver', driver_1, count(*), NULL FROM risk WHERE risk_band = 'Critical' GROUP BY 2""")
def _(spark, sf):
    t = mk.churn_tiles(risk(spark, sf))
    a = t["bands"].select(F.lit("band").alias("tile"), F.col("risk_band").alias("member"), "customers", "ltv_at_risk")
    b = t["actions"].select(F.lit("action").alias("tile"), F.col("recommended_action").alias("member"), "customers", "ltv_at_risk")
    c = t["drivers"].select(F.lit("driver").alias("tile"), F.col("driver_1").alias("member"), "customers", F.lit(None).cast("double").alias("ltv_at_risk"))
    return a.unionByName(b).unionByName(c)


@query("ml28_service_level", f"""{DENSE}, f AS (SELECT u AS y, CASE WHEN count(u) OVER r >= 7 THEN avg(u) OVER r END AS q FROM w WINDOW r AS (PARTITION BY store_id ORDER BY t ROWS BETWEEN 41 PRECEDING AND 14 PRECEDING)), l AS (SELECT 'mean' AS order_rule, y, q FROM f UNION ALL SELECT 'double', y, q * 2 FROM f)
SELECT order_rule, count(*) AS n, {div('count(*) FILTER (WHERE q >= y)', 'count(*)', 6)} AS service_level, {fx('sum(greatest(0, y - q))', 4)} AS units_short FROM l WHERE q IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    f = wn.roll_mean(dense_days(spark, sf), ["store_id"], "t", "u", 28, 14, "q").withColumn("q2", F.col("q") * 2)
    return sc.service_level(f, "u", {"mean": "q", "double": "q2"})


@query("ml30_daily_spine", f"{DENSE} SELECT s.store_id, CAST(s.d AS VARCHAR) AS sale_date, CAST(coalesce(a.units, 0) AS BIGINT) AS units, a.units IS NOT NULL AS observed FROM s LEFT JOIN a ON a.store_id = s.store_id AND a.sale_date = s.d")
def _(spark, sf):
    from shopledger.queries.q_windows import store_days

    return dm.daily_spine(store_days(spark, sf), "store_id", "sale_date", ["units"]).withColumn("sale_date", F.col("sale_date").cast("string"))
