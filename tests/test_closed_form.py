"""Hand-made frames with answers known in closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopledger import functions as fn
from shopledger.operators import filters as flt
from shopledger.operators import joins as jn
from shopledger.operators import windows as wn
from shopledger.operators.aggregates import sd_moments
from shopledger.plans import anomaly as an
from shopledger.plans import baskets as bk
from shopledger.plans import customers as cu
from shopledger.plans import finance as fi
from shopledger.plans import lineage as ln
from shopledger.plans import pages as pg
from shopledger.plans import pricing as pr
from shopledger.plans import repeat_buying as rb
from shopledger.plans import scoring as sc
from shopledger.plans import semantic as sem


def gaps_frame(spark):
    rows = [(1, d, "Regular Sale", 1, 10.0) for d in (1000, 1010, 1030, 1060)]
    df = spark.createDataFrame(rows, "customer_id long, jdn int, txn_type string, n int, v double")
    return df.withColumn("basket_value", F.col("v").cast("decimal(28,4)"))


@pytest.mark.parametrize("as_of, status", [(1080, "New"), (1105, "Lapsing"), (1150, "Churned"), (1090, "Active")])
def test_gap_profile(spark, as_of, status):
    r = cu.ipt_stats(gaps_frame(spark), F.lit(as_of)).first()
    assert (r.ipt_median_days, r.ipt_mean_days, r.churn_horizon_days) == (20.0, 20.0, 90)
    assert r.lifecycle_status == status


def test_slope_without_noise(spark):
    df = spark.createDataFrame([("a", x / 10, -2 * x / 10) for x in range(1, 9)], "item string, dp double, dq double")
    r = pr.ols0(df, "item", "dp", "dq").first()
    assert r.beta == pytest.approx(-2) and r.r2 == pytest.approx(1) and r.se == pytest.approx(0, abs=1e-6)
    short = pr.ols0(df.limit(5), "item", "dp", "dq").first()
    assert short.beta is None and short.n_diffs == 5


def test_shrinkage_to_the_group(spark):
    est = spark.createDataFrame([("a", "c", -1.0, 0.1), ("b", "c", -2.0, 0.2), ("d", "c", -3.0, 0.1), ("e", "c", None, None)], "item string, category string, beta double, se double")
    got = {r.item: r for r in pr.eb_shrink(est, "category").collect()}
    w = np.array([100.0, 25.0, 100.0])
    mean = float((w * np.array([-1.0, -2.0, -3.0])).sum() / w.sum())
    tau2 = 1.0 - (0.01 + 0.04 + 0.01) / 3
    assert got["a"].category_elasticity == pytest.approx(mean)
    assert got["b"].shrink_weight == pytest.approx(tau2 / (tau2 + 0.04))
    assert got["e"].elasticity_shrunk == pytest.approx(mean)


def test_robust_z(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "grp string, x double")
    r = an.robust_z(df, ["grp"], "x").where("x = 100").first()
    assert r.peer_median == 3 and r.robust_z == pytest.approx(97 / 1.4826)
    flat = spark.createDataFrame([("g", 2.0)] * 4, "grp string, x double")
    assert {x.robust_z for x in an.robust_z(flat, ["grp"], "x").collect()} == {0.0}


def test_rolling_mean_minimum(spark):
    df = spark.createDataFrame([("k", t, float(t)) for t in range(1, 11)], "k string, t int, u double")
    got = [r.m for r in wn.roll_mean(df, ["k"], "t", "u", 4, 2, "m").orderBy("t").collect()]
    assert got[:4] == [None, None, None, 1.5] and got[5] == 2.5 and got[9] == 6.5


def test_balances(spark):
    df = spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 0, 3), ("a", 3, 5, 0)], "k string, t int, plus int, minus int")
    rows = fi.rollforward(df, ["k"], "t", "plus", "minus").orderBy("t").collect()
    assert [r.closing_balance for r in rows] == [10, 7, 12] and [r.opening_balance for r in rows] == [0, 10, 7]


def test_effective_dated_rate(spark):
    rates = spark.createDataFrame([("x", "2019-01-01", 1.0), ("x", "2020-07-01", 2.0)], "k string, f string, rate double").withColumn("eff", F.col("f").cast("date"))
    df = spark.createDataFrame([("x", d) for d in ("2018-12-01", "2020-06-01", "2020-07-01", "2020-08-01")], "k string, s string").withColumn("d", F.col("s").cast("date"))
    got = [r.rate for r in jn.asof_join(df, rates, "k", "d", "eff").orderBy("d").collect()]
    assert got == [None, 1.0, 2.0, 2.0]


def test_blanks_are_one_bucket(spark):
    df = spark.createDataFrame([("",), (" ",), (None,), ("T ",)], "c string")
    got = {r.c: r.n for r in df.groupBy(fn.norm_blank(F.col("c")).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert got == {"": 3, "T": 1}


def test_scalar_filter_words(spark):
    df = spark.createDataFrame([("",), ("T",), ("M",)], "c string")
    assert flt.scalar_or_all(df, "c", "All").count() == 3
    assert [r.c for r in flt.scalar_or_all(df, "c", "NONE").collect()] == [""]
    assert flt.in_or_all(df, "c", None).count() == 3 and flt.in_or_all(df, "c", ["T"]).count() == 1


def test_dimension_of_any_size_is_spread(spark, monkeypatch):
    monkeypatch.setattr(jn, "MAX_INLINE_ROWS", 3)
    df = spark.range(2)
    assert jn.explode_by_dim(df, spark.range(3).withColumnRenamed("id", "d")).count() == 6
    got = jn.explode_by_dim(df, spark.range(10).withColumnRenamed("id", "d")).collect()
    assert sorted(map(tuple, got)) == [(i, d) for i in range(2) for d in range(10)]


def test_live_alert_reads_folders_of_part_files(spark, sf, tmp_path):
    from shopledger.queries.catalog import all_queries

    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    live = all_queries()["str01_live_alert"].build
    assert sorted(map(tuple, live(spark, str(tmp_path)).collect())) == sorted(map(tuple, live(spark, sf).collect()))


def test_active_intervals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    spans = [(int(a), int(a + rng.integers(0, 20))) for a in rng.integers(0, 60, 200)]
    base = F.lit("2020-01-01").cast("date")
    days = spark.range(60).select(F.date_add(base, F.col("id").cast("int")).alias("day"))
    ivals = spark.createDataFrame(spans, "a int, b int").select(F.date_add(base, F.col("a")).alias("s"), F.date_add(base, F.col("b")).alias("e"))
    got = [r.n for r in jn.active_count(days, ivals, "day", "s", "e", "n").orderBy("day").collect()]
    assert got == [sum(a <= d <= b for a, b in spans) for d in range(60)]


def test_basket_pairs_guard(spark):
    rows = [("small", i) for i in range(3)] + [("huge", i) for i in range(41)] + [("one", 1), ("dup", 5), ("dup", 5), ("dup", 6)]
    df = spark.createDataFrame(rows, "basket string, plu int")
    got = sorted(tuple(r) for r in jn.basket_pairs(df, high=40).collect())
    assert got == [("dup", 5, 6), ("small", 0, 1), ("small", 0, 2), ("small", 1, 2)]


def test_recommender_scores(spark):
    rows = [(b, p) for b in range(4) for p in (1, 2)] + [(9, 1), (9, 3)]
    df = spark.createDataFrame(rows, "basket int, plu int").withColumn("sale_date", F.lit("2020-01-01").cast("date"))
    s = bk.pair_scores(bk.pair_counts(df, "2021-01-01"), bk.item_counts(df, "2021-01-01"), 2)
    got = {(r.plu, r.rec_plu): r for r in s.collect()}
    assert float(got[(1, 2)].cosine) == pytest.approx(4 / math.sqrt(5 * 4), abs=1e-9)
    assert got[(2, 1)].lift == pytest.approx(4 * 10 / 20) and got[(1, 3)].lift == 0.0


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = an.iforest(df, ["a", "b"], ["id"], trees=100).orderBy(F.col("iforest_score").desc()).limit(2).collect()
    assert got[0].id == 999 and got[0].iforest_score > 0.6


def test_isolation_tree_partitions_its_sample():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(256, 3))
    nodes = an.grow_tree(x, rng, 8)
    assert sum(n[4] for n in nodes if n[0] < 0) == 256 and nodes[0][4] == 256


def test_classification_metrics_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y int, p double")
    r = sc.clf_metrics(df, "y", "p", "id").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap = sum((p[y == 1] == t).sum() * (y[p >= t].mean()) for t in np.unique(p)) / y.sum()
    assert r.auc_roc == pytest.approx(auc, abs=1e-6) and r.auc_pr == pytest.approx(ap, abs=1e-6)
    assert r.brier == pytest.approx(((p - y) ** 2).mean(), abs=1e-6)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, -3.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    r = sc.reg_metrics(df, "y", "p").first()
    assert (r.n, r.mae, r.wape) == (3, pytest.approx(2 / 3, abs=1e-6), pytest.approx(0.4))


def test_permutation_keeps_the_values(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(200)], "id long, v double")
    got = sc.permuted_beside(df.withColumn("w", F.col("v") + 1), "id", ["v", "w"], 3).orderBy("id").collect()
    assert sorted(r._other.v for r in got) == [float(i * i) for i in range(200)]
    assert all(r._other.w == r._other.v + 1 for r in got)
    assert sum(r._other.v == r.id**2 for r in got) < 20


def plain_nll(x, tx, t, p):
    """The published likelihood with gamma functions, one history at a time."""
    r, alpha, a, b = p
    beta = lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v)
    first = beta(a, b + x) - beta(a, b) + math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha) - (r + x) * math.log(alpha + t)
    total = math.exp(first)
    if x:
        total += math.exp(beta(a + 1, b + x - 1) - beta(a, b) + math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha) - (r + x) * math.log(alpha + tx))
    return -math.log(total)


def test_likelihood_and_slopes(spark):
    rows = [(0, 0.0, 10.0), (3, 8.0, 12.0), (3, 8.0, 12.0), (40, 90.0, 100.0), (1, 2.0, 60.0)]
    par = (0.9, 10.0, 0.7, 3.0)
    x, tx, t = (np.array(c) for c in zip(*rows, strict=True))
    got = rb.negative_log_likelihood(x, tx, t, np.ones(5), par)
    assert got[0] == pytest.approx(sum(plain_nll(*row, par) for row in rows))
    for k in range(4):
        up, down = (tuple(v + (d if j == k else 0) for j, v in enumerate(par)) for d in (1e-5, -1e-5))
        slope = sum(plain_nll(*row, up) - plain_nll(*row, down) for row in rows) / 2e-5
        assert got[1 + k] == pytest.approx(slope, rel=1e-4)
    df = spark.createDataFrame(rows, "x int, t_x double, t double")
    assert rb.bgnbd_nll(df, [par]).first().nll == pytest.approx(got[0])
    none = rb.bgnbd_fit(df.limit(0))
    assert none.customers == 0 and none.converged


def test_fit_recovers_simulated_customers(spark):
    rng = np.random.default_rng(11)
    want = {"r": 0.8, "alpha": 6.0, "a": 0.8, "b": 2.5}
    rows = []
    for _ in range(12000):
        rate, leave, t = rng.gamma(want["r"], 1 / want["alpha"]), rng.beta(want["a"], want["b"]), float(rng.integers(40, 100))
        x, at, last = 0, 0.0, 0.0
        while True:
            at += rng.exponential(1 / max(rate, 1e-12))
            if at > t:
                break
            x, last = x + 1, at
            if rng.random() < leave:
                break
        rows.append((x, last, t))
    df = spark.createDataFrame(rows, "x int, t_x double, t double")
    fit = rb.bgnbd_fit(df)
    assert fit.converged and fit.slope <= 1e-6 and fit.customers == 12000 and fit.rounds < 60
    assert fit.nll <= rb.bgnbd_nll(df, [tuple(want.values())]).first().nll
    for name, value in want.items():
        assert fit.params[name] == pytest.approx(value, rel=0.25), name


def test_pairs_of_a_basket_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(i)) for i in range(5000)] + [(2, int(i)) for i in rng.choice(5000, 700, replace=False)] + [(3, 7), (3, 7), (3, 9), (4, 1), (None, 3), (None, 4), (5, None), (5, 2)]
    df = spark.createDataFrame(rows, "basket int, plu int")
    pairs = jn.basket_pairs(df)
    assert pairs.where("item_a >= item_b").count() == 0
    counts = {r.basket: r.n for r in pairs.groupBy("basket").agg(F.countDistinct("item_a", "item_b").alias("d"), F.count("*").alias("n")).where("n = d").collect()}
    assert counts == {1: 5000 * 4999 // 2, 2: 700 * 699 // 2, 3: 1}
    small = df.where("basket IN (2, 3) OR plu < 60")
    want = sorted((r.basket, a, b) for r in small.dropna().groupBy("basket").agg(F.sort_array(F.collect_set("plu")).alias("xs")).collect() for k, a in enumerate(r.xs) for b in r.xs[k + 1 :])
    for block in (3, 40, 1000):
        assert sorted(map(tuple, jn.basket_pairs(small, block=block).collect())) == want
    assert {r.basket for r in jn.basket_pairs(df, low=2, high=40).select("basket").distinct().collect()} == {3}
    assert {r.basket for r in jn.basket_pairs(df, low=3, high=800).select("basket").distinct().collect()} == {2}


def test_no_cell_of_a_large_basket_is_large(spark):
    """5,000 items in blocks of 100: every key of the join has about 100 rows on each side."""
    df = spark.range(5000).select(F.lit(1).alias("basket"), F.col("id").alias("plu"))
    pairs = jn.basket_pairs(df, block=100)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and "_j" in plan
    blocks = df.groupBy(F.pmod(F.xxhash64("plu"), F.lit(50))).count().agg(F.max("count")).first()[0]
    assert blocks < 200 and pairs.count() == 5000 * 4999 // 2


def test_source_tables(spark):
    df = spark.createDataFrame(
        [(1, "SELECT 1 FROM a.b JOIN C c ON $P{x} = 1 join c d"), (2, "select * from (SELECT 1 FROM t) z JOIN u")], "asset int, sql string"
    )
    got = sorted(tuple(r) for r in ln.source_tables(df, "asset", "sql").select("asset", "table_name", "confidence").collect())
    assert got == [(1, "C", "parsed"), (1, "a.b", "parsed"), (2, "t", "inferred"), (2, "u", "inferred")]


def test_product_page(spark):
    page = (
        '<html><script type="application/ld+json">{"@type":"Product","productID":"42","name":"Pie","offers":{"price":5.5,"availability":"InStock"}}</script>'
        "<span> 1.5 kg </span><h2>Ingredients</h2><p>Ingredients</p><p>Flour, water &amp; a pinch of salt</p><div>Nutrition Facts</div><div>Per 1 slice (80 g)</div><div>Calories 210</div><div>Sodium</div><div>12 mg</div></html>"
    )
    r = pg.extract_product(spark.createDataFrame([(1, page), (2, "<html></html>")], "id int, html string"), "id").collect()
    assert len(r) == 1
    assert (r[0].plu, r[0].price, r[0].size_g, r[0].serving_g, r[0].calories, r[0].sodium_mg) == ("42", "5.5", "1500", "80", "210", "12")
    assert r[0].ingredients == "Flour, water & a pinch of salt"


def test_relationship_cardinality(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sem.relationship(left, good, "k").count() == 3
    with pytest.raises(Exception, match="repeats"):
        sem.relationship(left, good.unionByName(good), "k").collect()


def test_metric_limits(spark):
    model = sem.Model("m", lambda s, f: s.range(3)).dimension("id").measure("n", "count(*)").metric("rows", "n", ["id"])
    df = model.rows(spark, "")
    assert sem.metric(df, model, "rows").first().value == 3.0
    with pytest.raises(ValueError):
        sem.metric(df, model, "rows", ["other"])
    with pytest.raises(KeyError):
        model.metric("x", "missing")


def test_deviation_never_negative(spark):
    r = spark.createDataFrame([(0.1,)] * 3, "x double").agg(sd_moments(F.col("x")).alias("s")).first()
    assert r.s == pytest.approx(0, abs=1e-7)


def test_fixed_decimals(spark):
    vals = [2.675, -2.675, 1.005, 0.0, None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in vals], "x double").select(fn.fixed(F.col("x"), 1).alias("v")).collect()]
    assert got == [2.7, -2.7, 1.0, 0.0, None]


def test_lineage_reads_names_after_from_and_join(spark):
    from shopledger.plans import lineage

    rows = [(1, "select 'x from y' FROM Dw.A a JOIN b ON $P{from c} left join DW.a z"), (2, "select 1 from (select 2 from t) q"), (3, "from"), (4, ""), (5, None)]
    got = lineage.source_tables(spark.createDataFrame(rows, "q int, s string"), "q", "s").collect()
    assert sorted(tuple(r) for r in got) == [(1, "parsed", "Dw.A"), (1, "parsed", "b"), (2, "inferred", "t")]


def test_pages_without_parts_or_text(spark):
    from shopledger.plans import pages

    ld = '<script type="application/ld+json">{"@type":"Product","productID":"7","name":"N"}</script>'
    long = "salt " * 2000
    rows = [(1, None), (2, ""), (3, ld), (4, f"{ld}<b>Ingredients</b><i>Ingredients</i><p>{long}</p><p>Allergens</p><p>Egg</p><p>Trans Fat</p><p>3 g</p><p>Fat</p><p>2.5 g</p>")]
    df = spark.createDataFrame(rows, "k int, html string")
    got = {r.k: r for r in pages.extract_product(df, "k").collect()}
    assert set(got) == {3, 4} and got[3].ingredients == "" and got[3].fat_g == "" and got[3].package_size == ""
    assert got[4].ingredients == long.strip() and got[4].allergens == "Egg" and got[4].fat_g == "2.5"
    assert {r.k: r.flat for r in pages.flatten_html(df).collect()}[2] == ""
