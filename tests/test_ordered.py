"""Distributed ranks, sums and quantiles against brute force, with a hot key
and a hot value that hold a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopledger.operators.ordered import exact_ntile, exact_quantiles, exact_row_number, prefix_sum


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 9000
    key = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    val = np.where(rng.random(n) < 0.34, 5, rng.integers(-100, 100, n))
    pdf = pd.DataFrame({"id": rng.permutation(n), "key": key, "val": val, "w": rng.integers(0, 9, n)})
    return spark.createDataFrame(pdf).repartition(6), pdf


def test_row_number(skewed):
    df, pdf = skewed
    got = exact_row_number(df, ["val", "id"], ranges=16).toPandas().sort_values("row_number")
    want = pdf.sort_values(["val", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["row_number"].tolist() == list(range(1, len(pdf) + 1))


def test_row_number_per_key(skewed):
    df, pdf = skewed
    got = exact_row_number(df, ["val", "id"], ["key"], ranges=16).toPandas().set_index("id")["row_number"]
    want = pdf.sort_values(["val", "id"]).assign(rn=lambda d: d.groupby("key").cumcount() + 1).set_index("id")["rn"]
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_prefix_sum_per_key(skewed):
    df, pdf = skewed
    got = prefix_sum(df, ["val", "id"], "w", ["key"], ranges=16).toPandas().set_index("id")["before"].sort_index()
    s = pdf.sort_values(["val", "id"])
    want = (s.groupby("key")["w"].cumsum() - s["w"]).set_axis(s["id"]).sort_index()
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("tiles", [5, 20, 7])
def test_ntile_is_the_window_function(skewed, spark, tiles):
    df, _ = skewed
    from pyspark.sql import Window

    got = exact_ntile(df, ["val", "id"], {"t": tiles}, ranges=8)
    want = df.withColumn("t2", F.ntile(tiles).over(Window.orderBy("val", "id"))).select("id", "t2")
    assert got.join(want, "id").where("t <> t2").count() == 0


def test_ntile_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(i, i) for i in range(3)], "id long, val long")
    assert [r["t"] for r in exact_ntile(df, ["val", "id"], {"t": 5}).orderBy("id").collect()] == [1, 2, 3]


def test_quantiles(skewed):
    df, pdf = skewed
    got = exact_quantiles(df, "val", {"a": 0.1, "m": 0.5, "z": 0.98}, ["key"], ranges=16).toPandas().set_index("key").sort_index()
    want = pdf.groupby("key")["val"].quantile([0.1, 0.5, 0.98]).unstack()
    assert np.allclose(got[["a", "m", "z"]].to_numpy(float), want.to_numpy(float))


def test_hot_value_spreads_over_ranges(skewed):
    from shopledger.operators.ordered import with_ranges

    df, pdf = skewed
    sizes = with_ranges(df, ["val", "id"], 16).groupBy("_range").count().toPandas()["count"]
    assert sizes.max() < len(pdf) / 5
