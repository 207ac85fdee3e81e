"""Features of product-weeks made once for each series of weeks that pairs share."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shopledger.plans import demand as dm
from shopledger.plans import learning as le
from shopledger.queries import q_learning as ql

NUMS = ql.PLU_NUMS
UNTIL = 40


def first_day():
    return F.lit("2000-01-01").cast("date")


def lines_of(spark, pairs, weeks, seed=7):
    """Lines of some weeks of each pair, with lone, close and repeated weeks, sums of zero, and unknown stores, products and numbers."""
    rng, rows = random.Random(seed), []
    for k in range(pairs):
        store, plu = rng.choice([0, 1, 2, 3, 4, 6, None]), None if k % 17 == 0 else k
        for week in rng.sample(range(60), rng.randint(*weeks)):
            for _ in range(rng.randint(1, 2)):
                rows.append((store, plu, dt.date(2000, 1, 1) + dt.timedelta(days=7 * week + rng.randrange(7)), rng.choice([1, 1, 2, 5, 0, None, -1]), ""))
    rows.append((1, 3, None, 4, ""))
    lines = spark.createDataFrame(rows, "store_id int, plu long, sale_date date, quantity long, promo_type string")
    return lines.withColumn("sales", F.col("quantity").cast("decimal(18,4)")).withColumn("cost", F.col("quantity").cast("decimal(18,2)"))


def rows_of(df, *cols):
    return sorted(([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("weeks", [(1, 3), (20, 40), (60, 60)])
def test_weeks_of_a_run_have_the_features_of_their_series(spark, weeks):
    lines = lines_of(spark, 60, weeks).cache()
    dense = dm.plu_week_lags(dm.store_plu_week(lines, first_day()).select("store_id", "plu", "week_seq", "units"))
    runs = dm.week_series(dm.plu_week_runs(lines, first_day())).cache()
    feats = dm.plu_week_lags(dm.series_panel(dm.series_steps(runs)), keys=["series"]).withColumnRenamed("week_seq", "step")
    each = runs.withColumn("w", F.explode(F.sequence("week_seq", "until"))).withColumn("step", F.least(F.col("w") - F.col("week_seq"), F.lit(dm.LOOK_BACK + 1)))
    got = each.select("store_id", "plu", F.col("w").alias("week_seq"), "series", "step").join(feats, ["series", "step"])
    cols = ("store_id", "plu", "week_seq", "units", *NUMS)
    assert rows_of(got, *cols) == rows_of(dense, *cols)


def test_forecast_from_series_equals_that_from_all_weeks(spark, monkeypatch):
    lines = lines_of(spark, 300, (2, 6)).cache()
    fits, fit = [], le.fitted
    monkeypatch.setattr(le, "fitted", lambda train, *a, **k: fits.append(rows_of(train, *NUMS, "label", "_held", "_rows")) or fit(train, *a, **k))
    panel = dm.store_plu_week(lines, first_day()).select("store_id", "plu", "week_seq", "units")
    dense = le.plu_forecast(dm.plu_week_lags(panel), NUMS, UNTIL, trees=3)
    runs = dm.week_series(dm.plu_week_runs(lines, first_day())).cache()
    steps = dm.series_steps(runs)
    short = le.plu_forecast(dm.plu_week_lags(dm.series_panel(steps), keys=["series"]), NUMS, UNTIL, trees=3, runs=runs)
    assert fits[0] == fits[1] and len(fits[0]) > 100
    cols = ("store_id", "seen_store", "plu", "week_seq", "units", "predicted_units", "velocity_band", "lag_2", "roll4", "order_quantity")
    want = rows_of(dense, *cols)
    assert rows_of(short, *cols) == want and len(want) == panel.where(F.col("week_seq") > UNTIL).count() > 0


@pytest.mark.parametrize(("weeks", "by_series"), [((2, 6), True), ((60, 60), False)])
def test_features_are_made_for_fewer_rows_than_weeks(spark, sf, monkeypatch, weeks, by_series):
    lines, made, lags = lines_of(spark, 200, weeks), [], dm.plu_week_lags
    monkeypatch.setattr(ql, "plu_week", lambda spark, sf, weeks=dm.store_plu_week: weeks(lines, first_day()))
    monkeypatch.setattr(dm, "plu_week_lags", lambda panel, *a, **k: made.append(panel.count()) or lags(panel, *a, **k))
    monkeypatch.setattr(le, "plu_forecast", lambda features, nums, until, runs=None: (features, runs))
    _, runs = ql.plu_scored(spark, sf)
    dense = dm.store_plu_week(lines, first_day()).count()
    assert (runs is not None) == by_series and len(made) == 1 and (made[0] < dense if by_series else made[0] == dense)
