"""Work that must stay under limits of memory and time."""

import tracemalloc

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from __spark_entry__ import queries
from shopledger.llm import ctw
from shopledger.plans import learning as le
from shopledger.plans.semantic import Model, measured
from shopledger.queries import q_learning


def chunk(data: bytes, docs: int) -> dict:
    size = len(data) // docs
    body = data[: size * docs]
    return {"chunk": 1, "ids": np.arange(docs, dtype=np.int64).tobytes(), "lens": np.full(docs, size, np.int64).tobytes(), "body": zstandard.ZstdCompressor(level=1).compress(body)}


def test_grams_of_a_chunk_are_counted_in_little_memory():
    rng = np.random.default_rng(3)
    row = chunk(rng.choice(np.frombuffer(b"abcdefg  ", np.uint8), 6 << 20).tobytes(), 600)
    ctw.questions(chunk(b"ab " * 100, 3))
    tracemalloc.start()
    code, count, term, use = ctw.questions(row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 << 20
    train = ~ctw.held_out(np.arange(600))
    ids, offsets, data = ctw.chunk_parts(row)
    whole = ctw.Text(ids, offsets, data)
    for names, counts, every, weight in ((code, count, whole.code, np.repeat(train, whole.sizes)), (term, use, whole.word, train[whole.word_doc])):
        unique, number = np.unique(every, return_inverse=True)
        assert np.array_equal(names, unique)
        assert np.array_equal(counts, np.bincount(number, weights=weight))


def test_fine_groups_count_values_in_a_stage_of_their_own(spark):
    rows = [(None, "a", 1), (None, "a", 1), (None, "a", 2), (1, "a", 1), (1, "a", None), (1, "b", 3), (1, "b", 3), (2, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, v long")
    model = Model("m", lambda spark, folder: df).measure("n", "count(*)").measure("vs", "count(DISTINCT v)", formula="t", distinct={"t": ("v", "true")})
    keys = [F.col("k"), F.col("s")]
    fine, usual = (measured(df, model, ["n", "vs"], keys, fine=f) for f in (True, False))
    want = {(None, "a", 3, 2), (1, "a", 2, 1), (1, "b", 2, 1), (2, None, 1, 0)}
    assert {tuple(r) for r in fine.collect()} == {tuple(r) for r in usual.collect()} == want
    assert "Window" in fine._jdf.queryExecution().executedPlan().toString()


def test_line_dimensions_hold_no_map_of_lines(spark):
    plan = queries()["sem01_line_dimensions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any("HashAggregate(keys" in line and "_v#" in line for line in plan.splitlines())


class Written(Exception):
    """Ends a query at its first written table."""


def written_columns(monkeypatch, module, run) -> set[str]:
    def stop(df):
        raise Written(df.columns)

    monkeypatch.setattr(module, "cut_lineage", stop)
    with pytest.raises(Written) as got:
        run()
    return set(got.value.args[0])


def test_fits_write_only_the_columns_they_read(spark, monkeypatch):
    base = ["as_of int", "customer_id long", "is_scoring_row string", "churn_adaptive int", "bgnbd_frequency long", "bgnbd_recency int", "bgnbd_t int", "segment string", "unread double"]
    churn = spark.createDataFrame([], ", ".join(base + [f"{c} double" for c in le.CHURN_NUMS]))
    got = written_columns(monkeypatch, le, lambda: le.train_churn(churn, 10, ["segment"]))
    assert got == {"as_of", "customer_id", "is_scoring_row", "bucket", "label", "bgnbd_frequency", "bgnbd_recency", "bgnbd_t", "segment", *le.CHURN_NUMS}
    value = spark.createDataFrame([], ", ".join(["customer_id long", "as_of_seq int", "future_margin decimal(18,2)", "future_sales decimal(18,2)"] + [f"{c} double" for c in le.CLV_NUMS]))
    monkeypatch.setattr(q_learning, "clv_set", lambda spark, sf: value)
    got = written_columns(monkeypatch, q_learning, lambda: queries()["ml19_permutation_importance"](spark, ""))
    assert got == {"customer_id", "as_of_seq", "label", *le.CLV_NUMS}
