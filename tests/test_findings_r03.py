"""Dense weeks without a join, equal rows as weights, narrow rows dealt to tasks, long texts in parts."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopledger.operators.ordered import exact_quantiles
from shopledger.plans import demand as dm
from shopledger.plans import learning as le
from shopledger.plans import stores as st
from shopledger.queries import q_checks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def weeks(spark):
    day = lambda week: dt.date(2000, 1, 1) + dt.timedelta(days=7 * week)
    rows = [(1, 10, day(0), 2, "T"), (1, 10, day(0), 1, ""), (1, 10, day(3), 4, ""), (2, 10, day(1), 5, ""), (None, 11, day(1), 7, ""), (None, 11, day(2), 7, "")]
    lines = spark.createDataFrame(rows, "store_id int, plu long, sale_date date, quantity long, promo_type string")
    lines = lines.withColumn("sales", (F.col("quantity") * 3).cast("decimal(18,4)")).withColumn("cost", F.col("quantity").cast("decimal(18,2)"))
    return dm.store_plu_week(lines, F.lit("2000-01-01").cast("date"))


def test_dense_weeks_are_made_without_a_join(spark):
    got = weeks(spark)
    assert "Join" not in plan(got)
    rows = [tuple(r) for r in got.select("store_id", "plu", "week_seq", "units", F.col("sales").cast("int"), F.col("margin").cast("int"), "promo_units").collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 10, 0, 3, 9, 6, 2), (1, 10, 1, 0, 0, 0, 0), (1, 10, 2, 0, 0, 0, 0), (1, 10, 3, 4, 12, 8, 0), (2, 10, 1, 5, 15, 10, 0), (None, 11, 1, 0, 0, 0, 0), (None, 11, 2, 0, 0, 0, 0),
    ], key=str)


def test_weighted_quantiles_equal_those_of_repeated_rows(spark):
    counted = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, 3), ("b", 4.0, 2), ("b", 5.0, 2)], "k string, v double, n long")
    repeated = counted.select("k", "v", F.explode(F.sequence(F.lit(1), "n")))
    one, two = (sorted(map(tuple, d.collect())) for d in (exact_quantiles(counted, "v", {"q": 0.85, "m": 0.5}, ["k"], weight="n"), exact_quantiles(repeated, "v", {"q": 0.85, "m": 0.5}, ["k"])))
    assert one == two


def test_forecast_fits_equal_rows_once_with_their_number(spark, monkeypatch):
    seen, fit = {}, le.fitted

    def watched(train, *args, **kwargs):
        seen["rows"], seen["stands_for"] = train.agg(F.count("*"), F.sum("_rows")).first()
        model = fit(train, *args, **kwargs)
        full = train.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), "_rows"))).drop("_rows")
        whole = fit(full, *args, **{k: v for k, v in kwargs.items() if k != "weight"})
        a, b = (m.transform(train).agg(F.sum(F.col("prediction") * F.col("_rows"))).first()[0] for m in (model, whole))
        seen["same"] = a == pytest.approx(b, rel=1e-6)
        return model

    monkeypatch.setattr(le, "fitted", watched)
    r = F.xxhash64("id") % 7
    panel = spark.range(6000).select((F.col("id") % 10).cast("int").alias("store_id"), (F.floor(F.col("id") / 10) % 20).alias("plu"), F.floor(F.col("id") / 200).cast("int").alias("week_seq"), F.when(r == 0, 4).otherwise(0).cast("bigint").alias("units"))
    nums = ["lag_2", "lag_4", "lag_8", "lag_13", "roll4", "roll13", "roll13_std", "zero_rate13", "trend_ratio"]
    out = le.plu_forecast(dm.plu_week_lags(panel), nums, 24, trees=3)
    assert out.count() == 5 * 200 and out.where("order_quantity < predicted_units").count() == 0
    assert seen["stands_for"] == 25 * 20 * 8 > seen["rows"] and seen["same"]


def test_lines_of_purchase_orders_are_read_once(spark):
    rows = [(1, 1, 5, 200001, 3, 0, "N"), (1, 1, 6, 200001, 4, 5, "R"), (2, 1, 5, 200002, 2, 2, "N"), (1, None, 5, 200001, 9, 9, "N")]
    lines = spark.createDataFrame(rows, "store_id int, supplier_id long, plu long, yyyymm int, quantity long, ship_days int, return_flag string")
    lines = lines.withColumn("sale_date", F.lit("2000-01-05").cast("date")).withColumn("cost", F.lit(10).cast("decimal(18,2)"))
    out = st.purchase_orders(lines)
    assert "Join" not in plan(out)
    got = [tuple(r) for r in out.select("store_id", "expected_lead_days", "actual_lead_days", "line_count", "on_time").collect()]
    assert sorted(got) == [(1, 2, 5, 2, "N"), (2, 2, 2, 1, "Y")]


def test_product_pages_are_dealt_to_many_tasks(spark, sf):
    assert q_checks.product_pages(spark, sf).rdd.getNumPartitions() >= 8


def test_signatures_of_long_texts_come_in_parts():
    from shopledger.llm import neardup as nd

    texts = [f"w{k} " * (nd.PART_BYTES // 3) for k in range(4)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4), pa.int64()), "text": texts})
    out = list(nd.signature_rows(4)(iter([batch])))
    assert len(out) == 4 and [r for b in out for r in b.column(1).to_pylist()] == [1, 1, 1, 1]
