"""Rebuilt tables, plans without copied rows, boosted trees with missing values, receivables, lineage columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopledger.operators import windows as wn
from shopledger.plans import baskets as bk
from shopledger.plans import finance as fi
from shopledger.plans import learning as le
from shopledger.plans import lineage as ln
from shopledger.plans import models as md
from shopledger.plans import scoring as sc
from shopledger.plans import semantic as sem
from shopledger.plans import training as tr
from shopledger.queries.catalog import all_queries
from shopledger.sources import tables
from shopledger.sources.tables import read_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def values(df):
    return sorted(r[0] for r in df.collect())


def test_rebuild_may_read_its_own_table(spark, tmp_path):
    path = str(tmp_path / "t")
    first = tables.rebuild(spark.range(3), path)
    again = tables.rebuild(tables.read_rebuilt(spark, path).select((F.col("id") + 10).alias("id")), path)
    assert values(first) == [0, 1, 2] and values(again) == [10, 11, 12] and values(tables.read_rebuilt(spark, path)) == [10, 11, 12]
    tables.rebuild(again.select((F.col("id") + 1).alias("id")), path)
    assert len(tables.versions(spark, path)) == 2  # the oldest one went


def test_a_failed_rebuild_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.rebuild(spark.range(3), path)
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.rebuild(broken, path)
    assert values(tables.read_rebuilt(spark, path)) == [0, 1, 2]
    assert values(tables.rebuild(spark.range(1), path)) == [0]
    with pytest.raises(FileNotFoundError):
        tables.read_rebuilt(spark, str(tmp_path / "none"))


def test_bucket_count_follows_the_size(spark, monkeypatch):
    rows = spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert tables.measured_buckets(rows)[1] == tables.LEAST_BUCKETS
    monkeypatch.setattr(tables, "BUCKET_BYTES", 40_000)
    many = tables.measured_buckets(rows)[1]
    assert many > tables.LEAST_BUCKETS and many & (many - 1) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = tables.write_bucketed(rows, "depth_a", "id")
        monkeypatch.setattr(tables, "BUCKET_BYTES", 128 << 20)
        b = tables.write_bucketed(spark.range(500), "depth_b", "id", many // 2)
        joined = a.join(b, "id")
        assert "Exchange" not in plan(joined) and joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS depth_a")
        spark.sql("DROP TABLE IF EXISTS depth_b")


def test_class_totals_do_not_move_the_rows(spark, sf):
    rows = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))
    out = wn.over_class(rows, "c_mktsegment", "bal")
    assert "hashpartitioning" not in plan(out) and "SortMergeJoin" not in plan(out)
    nulls = wn.over_class(spark.createDataFrame([("a", 1), (None, 2), (None, 4)], "k string, v int"), "k", "v").collect()
    assert sorted(((r.k or "", r.class_rows, r.class_total) for r in nulls)) == [("", 2, 6), ("", 2, 6), ("a", 1, 1)]


def test_distinct_counts_do_not_copy_rows(spark, sf):
    for name in ("sem02_measures", "sem04_return_rate", "sem04_default_filters_lifted"):
        assert "Expand" not in plan(all_queries()[name].build(spark, sf)), name
    model = sem.Model("m", lambda s, f: None).dimension("g")
    model.measure("rate", "", formula="a / b", plain={"b": "sum(v)"}, distinct={"a": ("k", "v > 1")}).measure("n", "count(*)").metric("rate", "rate", ["g"])
    rows = spark.createDataFrame([("x", 1, 2), ("x", 1, 3), ("x", 2, 1), (None, 3, 5), ("y", None, 4)], "g string, k int, v int")
    got = {r.g: (r.rate, r.n) for r in sem.measured(rows, model, ["rate", "n"], [F.col("g")]).collect()}
    assert got == {"x": (1 / 6, 3), None: (1 / 5, 1), "y": (0.0, 1)}
    assert sem.measured(rows, model, ["rate", "n"]).collect() == [(2 / 15, 5)]
    assert sem.metric(rows, model, "rate", ["g"]).where("g = 'x'").first().value == pytest.approx(1 / 6)


def test_measures_in_parts_equal_their_text(spark, sf):
    model = md.pos_model()
    names = [n for n, x in model.measures.items() if x.formula]
    rows = model.rows(spark, sf)
    plain = rows.groupBy("store_region").agg(*[F.expr(model.measures[n].expr).alias(n) for n in names])
    split = sem.measured(rows, model, names, [F.col("store_region")]).select(plain.columns)
    assert len(names) == 8
    for a, b in zip(plain.orderBy("store_region").collect(), split.orderBy("store_region").collect(), strict=True):
        assert a[0] == b[0] and [float(v) for v in a[1:]] == pytest.approx([float(v) for v in b[1:]])


def test_states_are_carried_to_every_cutoff(spark):
    days = spark.createDataFrame([(1, 5, 1, 1.0), (1, 9, 1, 2.0), (1, 30, 2, 4.0), (2, 25, 1, 1.0), (3, 60, 1, 1.0)], "customer_id int, jdn int, baskets int, v double").withColumn("day_value", F.col("v").cast("decimal(28,4)"))
    got = {(r.customer_id, r.as_of): (r.purchase_days_asof, r.baskets_asof, float(r.sales_asof), r.median, r.mean, r.last_jdn, r.next_jdn) for r in tr.asof_states(days, [10, 20, 30, 50]).collect()}
    assert got == {
        (1, 10): (2, 2, 3.0, 4.0, 4.0, 9, 30), (1, 20): (2, 2, 3.0, 4.0, 4.0, 9, 30),
        (1, 30): (3, 4, 7.0, 12.5, 12.5, 30, None), (1, 50): (3, 4, 7.0, 12.5, 12.5, 30, None),
    }


def test_lineage_pattern_runs_once(spark, sf):
    text = plan(all_queries()["lin01_source_tables"].build(spark, sf))
    assert text.count("regexp_extract_all") == 1


def test_columns_go_to_the_table_of_their_alias(spark):
    df = spark.createDataFrame([
        (1, "SELECT a.x, B.y, c.z, t.w FROM s.t JOIN u AS b ON t.k = b.k left join v a on $P{c.q} = 'c.r'"), (2, "select 1"), (3, None), (4, "SELECT p.a, p.a FROM p WHERE p.b > 1.5"),
    ], "asset int, sql string")
    got = sorted(tuple(r) for r in ln.source_columns(df, "asset", "sql").collect())
    assert got == [(1, "s.t", "k"), (1, "s.t", "w"), (1, "u", "k"), (1, "u", "y"), (1, "v", "x"), (4, "p", "a"), (4, "p", "b")]


def test_receivables_at_a_date(spark):
    day = dt.date
    pnl = spark.createDataFrame([(1, "E", 202001, 5.0, 2.0), (1, "E", 202002, 6.0, 2.0), (2, "W", 202001, 1.0, 1.0), (2, "W", 202002, 0.0, 0.0)], "store_id int, region string, yyyymm int, royalty_fee double, marketing_fee double")
    pays = spark.createDataFrame([(1, day(2020, 1, 5)), (1, day(2020, 3, 20)), (2, day(2020, 2, 3))], "store_id int, pay_date date")
    months = spark.createDataFrame([(202001, day(2020, 1, 31)), (202002, day(2020, 2, 29)), (202003, day(2020, 3, 31))], "yyyymm int, month_end date")
    aged = {r.invoice_number: r for r in fi.fee_aging(fi.fee_invoices(pnl, pays, months), "2020-03-10").collect()}
    assert {k: (r.status, r.aging_bucket, r.balance) for k, r in aged.items()} == {"FF-1-202001": ("Overdue", "1-30 days", 7.0), "FF-1-202002": ("Open", "Current", 8.0), "FF-2-202001": ("Paid", "Paid", 0.0)}
    assert aged["FF-1-202001"].days_overdue == 24
    late = {r.invoice_number: r for r in fi.fee_aging(fi.fee_invoices(pnl, pays, months), "2020-12-31").collect()}
    assert late["FF-1-202001"].status == "Paid" and late["FF-1-202001"].days_paid_late == 34


def test_targets_are_ranked_for_shared_sets(spark):
    visible = spark.createDataFrame([(1, 10, 50), (1, 11, 50), (2, 11, 51), (2, 10, 51), (3, 10, 99), (4, 12, 50)], "basket int, plu int, target int")
    scores = spark.createDataFrame([(10, 50, 0.5), (11, 50, 0.1), (10, 51, 0.7), (11, 52, 0.6), (12, 50, 0.2), (10, 11, 0.9)], "plu int, rec_plu int, cosine double")
    shared = {r.basket: r.rep for r in bk.shared_sets(visible).collect()}
    assert shared[1] == shared[2] == 1 and len(set(shared.values())) == 3
    assert {r.basket: r["rank"] for r in bk.target_ranks(visible, scores).collect()} == {1: 2, 2: 1, 4: 1}  # 51 is above, 52 ties after


@pytest.fixture(scope="module")
def labelled(spark):
    """The label follows x where x is known and is 3 where it is not; z says nothing."""
    known = F.col("id") % 4 != 0
    x = (F.hash("id", F.lit(1)) % 100 / 10.0).cast("double")
    return spark.range(1500).select("id", F.when(known, x).alias("x"), (F.hash("id", F.lit(2)) % 50).cast("double").alias("z"), F.lit("a").alias("c")).withColumn("label", F.when(known, F.when(F.col("x") > 0, 8.0).otherwise(1.0)).otherwise(3.0)).cache()


def test_trees_stop_early_and_see_missing_values(labelled):
    curved = labelled.withColumn("label", F.when(F.col("x").isNull(), 30.0).otherwise(F.col("x") * F.col("x") / 10 + F.col("z") / 10))
    model = le.fitted(curved, ["x", "z"], ["c"], "label", False, F.col("id"))
    assert 5 < le.tree_count(model) < le.MOST_TREES
    out = model.transform(curved).groupBy(F.col("x").isNull().alias("missing")).agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("e"))
    assert sorted(r.missing for r in out.collect()) == [False, True] and all(r.e < 1.5 for r in out.collect())


def test_importance_is_that_of_the_feature_that_counts(labelled):
    train, later = labelled.where("id < 1000"), labelled.where("id >= 1000")
    model = le.fitted(train, ["x", "z"], [], "label", False, F.col("id"))
    rise = {r.feature: r.error_rise for r in sc.perm_importance(model, later.drop("c"), ["x", "z"], "id", "label").collect()}
    assert set(rise) == {"x", "z"} and rise["x"] > 1.0 > 10 * abs(rise["z"])
    flag = labelled.withColumn("label", (F.col("label") > 5).cast("double"))
    model = le.fitted(flag.where("id < 1000"), ["x", "z"], [], "label", True, F.col("id"), trees=20)
    rise = {r.feature: r.error_rise for r in sc.perm_importance(model, flag.where("id >= 1000").drop("c"), ["x", "z"], "id", "label", classify=True).collect()}
    assert rise["x"] > 0.2 > abs(rise["z"])
