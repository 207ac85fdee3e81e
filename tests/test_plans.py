"""Shapes of the physical plans: what reaches the scan, what is broadcast."""

from pyspark.sql import functions as F

from shopledger.queries.catalog import all_queries
from shopledger.sources import retail
from shopledger.sources.tables import read_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark, sf):
    text = plan(all_queries()["src01_table_scan"].build(spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate" in text


def test_unused_measures_are_pruned(spark, sf):
    text = plan(retail.transactions(spark, sf).groupBy("store_id").agg(F.sum("basket_value")))
    assert "l_discount" in text and "l_returnflag" not in text and "l_tax" not in text


def test_one_row_lookups_are_not_cross_joins(spark, sf):
    for name in ("jn05_one_row_scalars", "agg18_share_of_total", "mrt28_scaled_tender_split", "jn06_explode_by_accounts", "jn07_stacked_snapshots"):
        text = plan(all_queries()[name].build(spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_no_query_collects_the_fact_in_one_window(spark, sf):
    # windows without keys may only see calendar-sized or range-sized rows
    text = plan(all_queries()["win18_decile_table"].build(spark, sf))
    assert "windowspecdefinition(0" not in text.replace(" ", "") or "_range" in text


def test_bucketed_tables_join_without_a_shuffle(spark, sf):
    from shopledger.sources.tables import write_bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = write_bucketed(read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "plan_a", "k")
        b = write_bucketed(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "plan_b", "k")
        assert "Exchange" not in plan(a.join(b, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS plan_a")
        spark.sql("DROP TABLE IF EXISTS plan_b")


def test_metrics_read_only_the_tables_they_name(spark, sf):
    text = plan(all_queries()["sem03_metric_by_grain"].build(spark, sf))
    assert "EqualTo(o_orderstatus,F)" in text and "p_partkey" not in text
    assert "p_retailprice" in plan(all_queries()["sem03_margin_by_week"].build(spark, sf))
