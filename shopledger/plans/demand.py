"""Dense demand series, store-day and product-week features and forecasts
(MRT-48, MRT-49, ML-18, ML-25..28, ML-30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_spine(df: DataFrame, key: str, day: str, zero: Sequence[str]) -> DataFrame:
    """ML-30: one row per day between a key's first and last day; filled days
    carry zeros and ``observed`` false."""
    life = df.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = life.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    seen = df.withColumn("observed", F.lit(True))
    out = days.join(seen, [key, day], "left")
    return out.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in out.columns if c != "observed"],
        F.coalesce("observed", F.lit(False)).alias("observed"),
    )


# The columns a store-day model may see: all known on the morning of the day.
STORE_DAY_COLUMNS = ["dow_num", "mo", "is_weekend", "is_holiday", "promos_active", "region", "store_format", "square_feet"]


def store_day_features(daily: DataFrame, calendar: DataFrame, stores: DataFrame) -> DataFrame:
    """MRT-48: store-day rows with calendar and store columns from an explicit
    allow-list; whole-period figures would leak the future and are left out."""
    cal = calendar.select("calendar_date", *[c for c in STORE_DAY_COLUMNS if c in calendar.columns])
    fixed_cols = stores.select("store_id", *[c for c in STORE_DAY_COLUMNS if c in stores.columns])
    out = daily.join(cal, daily.sale_date == cal.calendar_date).join(fixed_cols, "store_id", "left")
    return out.select("store_id", "calendar_date", *STORE_DAY_COLUMNS, F.col("s").alias("target_sales"), F.col("tx").alias("target_transactions"))


def plu_week_runs(lines: DataFrame, first_day) -> DataFrame:
    """MRT-49: the weeks with lines of each store-product pair.  The week is
    arithmetic on the day, not a range join.

    A week with lines stands for itself and for the empty weeks ``until`` the
    next one, so only weeks with lines are shuffled.
    """
    from shopledger.functions import week_seq, jdn

    actual = lines.groupBy("store_id", "plu", week_seq(jdn(F.col("sale_date")), jdn(first_day)).alias("week_seq")).agg(
        F.sum("quantity").alias("units"), F.sum("sales").alias("sales"), (F.sum("sales") - F.sum("cost")).alias("margin"),
        F.sum(F.when(F.col("promo_type") != "", F.col("quantity")).otherwise(F.lit(0))).alias("promo_units"),
    )
    by_week = Window.partitionBy("store_id", "plu").orderBy("week_seq")
    until = F.coalesce(F.lead("week_seq").over(by_week) - 1, F.col("week_seq"))
    return actual.where("week_seq IS NOT NULL").withColumn("until", until)


def own_week(column: str) -> Column:
    """A figure of a run's first week: zero where it is unknown, or the store or the product is."""
    known = F.col("store_id").isNotNull() & F.col("plu").isNotNull()
    return F.when(known, F.coalesce(F.col(column), F.lit(0))).otherwise(F.lit(0))


def store_plu_week(lines: DataFrame, first_day) -> DataFrame:
    """MRT-49: every week inside each store-product pair's carried life, zeros
    included; the dense rows are made last, from the runs.

    Lines without a store have no week of their own: all their weeks are zero.
    """
    values = ("units", "sales", "margin", "promo_units")
    weeks = F.posexplode(F.sequence("week_seq", "until")).alias("gap", "week")
    out = plu_week_runs(lines, first_day).select("store_id", "plu", weeks, *values)
    return out.select("store_id", "plu", F.col("week").alias("week_seq"), *[F.when(F.col("gap") == 0, own_week(c)).otherwise(F.lit(0)).alias(c) for c in values])


#: How many weeks back the features of ``plu_week_lags`` see with its horizon of two weeks.
LOOK_BACK = 14


def week_series(runs: DataFrame) -> DataFrame:
    """ML-27: each run with its ``series``: all that the features of its weeks can see.

    That are the weeks since the pair began (``age``) and the sales of its own and
    of the weeks before (``past``), as far as the features look back. Runs with
    the same series have the same features week by week.
    """
    by_week = Window.partitionBy("store_id", "plu").orderBy("week_seq")
    units = runs.select("store_id", "plu", "week_seq", "until", own_week("units").alias("units"))
    seen = F.collect_list(F.struct("week_seq", "units")).over(by_week.rangeBetween(-LOOK_BACK, 0))
    age = F.least(F.col("week_seq") - F.min("week_seq").over(by_week), F.lit(LOOK_BACK)).cast("int")
    out = units.withColumn("age", age).withColumn("seen", seen)
    sold = F.filter("seen", lambda p: p["units"] != 0)
    out = out.withColumn("past", F.transform(sold, lambda p: F.struct((F.col("week_seq") - p["week_seq"]).cast("int").alias("back"), p["units"].alias("units"))))
    series = F.concat_ws(" ", F.col("age").cast("string"), F.transform("past", lambda p: F.concat_ws(":", p["back"].cast("string"), p["units"].cast("string"))))
    return out.select("store_id", "plu", "week_seq", "until", series.alias("series"), "age", "past")


def series_steps(runs: DataFrame) -> DataFrame:
    """One row per series, with the last of its steps that a run of it needs; from LOOK_BACK + 1 on all weeks are alike."""
    return runs.groupBy("series", "age", "past").agg(F.max(F.least(F.col("until") - F.col("week_seq"), F.lit(LOOK_BACK + 1))).cast("int").alias("steps"))


def series_panel(steps: DataFrame) -> DataFrame:
    """The dense weeks of every series: those before the run's own week, number 0, have negative numbers."""
    own = F.get(F.filter("past", lambda p: p["back"] == -F.col("week_seq")), F.lit(0))["units"]
    weeks = steps.select("series", "past", F.explode(F.sequence(-F.col("age"), F.col("steps"))).alias("week_seq"))
    return weeks.select("series", "week_seq", F.coalesce(own, F.lit(0).cast("bigint")).alias("units"))


def store_day_lags(spine: DataFrame, t: str = "t", target: str = "u", horizon: int = 14) -> DataFrame:
    """ML-25: lag, rolling and momentum features, every one at least
    ``horizon`` days old."""
    from shopledger.functions import safe_div
    from shopledger.operators import windows as wn

    k = ["store_id"]
    out = wn.lags(spine, k, t, target, [14, 21, 28, 35, 364])
    out = wn.roll_mean(out, k, t, target, 7, horizon, "roll7")
    out = wn.roll_mean(out, k, t, target, 28, horizon, "roll28")
    out = wn.roll_std(out, k, t, target, 28, horizon, "rollstd28")
    out = wn.same_weekday(out, k, t, target)
    return out.withColumn("trend_ratio", safe_div(F.col("roll7"), F.col("roll28")))


def plu_week_lags(panel: DataFrame, horizon: int = 2, keys: Sequence[str] = ("store_id", "plu")) -> DataFrame:
    """ML-27: lag, rolling and intermittency features of the dense panel."""
    from shopledger.functions import safe_div
    from shopledger.operators import windows as wn

    k = list(keys)
    out = wn.lags(panel, k, "week_seq", "units", [2, 4, 8, 13])
    out = wn.roll_mean(out, k, "week_seq", "units", 4, horizon, "roll4")
    out = wn.roll_mean(out, k, "week_seq", "units", 13, horizon, "roll13")
    out = wn.roll_std(out, k, "week_seq", "units", 13, horizon, "roll13_std")
    out = wn.zero_rate(out, k, "week_seq", "units", 13, horizon, "zero_rate13")
    return out.withColumn("trend_ratio", safe_div(F.col("roll4"), F.col("roll13")))


def forward_frame(hist: DataFrame, last_day, horizon: int, static: Sequence[str], holidays: dict[str, str], grace_days: int = 0) -> DataFrame:
    """ML-26: the rows to score after the last day: stores still trading, their
    last known attributes, the mean promotion load by month and weekday, and
    holidays by month and day."""
    from shopledger.functions import dow0, fixed

    known = hist.groupBy("store_id").agg(F.max("calendar_date").alias("_last"), *[F.max_by(c, "calendar_date").alias(c) for c in static])
    active = known.withColumn("_end", last_day).where(F.datediff("_end", "_last") <= grace_days)
    days = active.withColumn("calendar_date", F.explode(F.sequence(F.date_add("_end", 1), F.date_add("_end", horizon)))).drop("_last", "_end")
    # one row per calendar day first: stores share the promotion load
    load = hist.select("calendar_date", "promos_active").distinct().groupBy(F.month("calendar_date").alias("mo"), dow0(F.col("calendar_date")).alias("dow_num")).agg(F.avg("promos_active").alias("p"))
    names = F.create_map(*[F.lit(x) for kv in holidays.items() for x in kv])
    d = F.col("calendar_date")
    name = F.element_at(names, F.date_format(d, "MM-dd"))
    out = days.withColumn("mo", F.month(d)).withColumn("dow_num", dow0(d)).join(load, ["mo", "dow_num"], "left")
    return out.select(
        "store_id", "calendar_date", "mo", "dow_num", *static, fixed(F.col("p"), 6).alias("promos_expected"), F.when(name.isNotNull(), "Y").otherwise("N").alias("is_holiday"),
        F.coalesce(name, F.lit("None")).alias("holiday_name"), F.lit(False).alias("observed"),
    )
