"""Ordered calculations per key (WIN-01..20).

Keys here are already at a calendar grain (one row per key and day, week or
month), so a key has no more rows than the calendar has steps, even where it
holds a third of the raw lines.  Global ranks go through ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import nonzero, pct
from shopledger.operators.joins import beside
from shopledger.operators.ordered import exact_ntile


def _by(keys: Sequence[str], t: str):
    return Window.partitionBy(*keys).orderBy(t)


def gap(df: DataFrame, keys, t: str, out: str = "gap") -> DataFrame:
    """WIN-01: difference to the step before within the key."""
    return df.withColumn(out, F.col(t) - F.lag(t).over(_by(keys, t)))


def pct_change(df: DataFrame, keys, t: str, cols: Sequence[str]) -> DataFrame:
    """WIN-02: percent change to the month before for several measures."""
    w = _by(keys, t)
    for c in cols:
        prev = F.lag(c).over(w)
        df = df.withColumn(f"{c}_change_pct", pct(F.col(c) - prev, prev))
    return df


def nth(df: DataFrame, keys, t: str, n: int, descending: bool = False) -> DataFrame:
    """WIN-03: the nth step of each key from either end."""
    w = Window.partitionBy(*keys).orderBy(F.col(t).desc() if descending else F.col(t))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n).drop("_n")


def rank_groups(df: DataFrame, group: list[str], within: list[str], measure: Column, n: int) -> DataFrame:
    """WIN-04: rank aggregated rows, ties by the group columns."""
    sums = df.groupBy(*dict.fromkeys([*within, *group])).agg(measure.alias("measure"))
    w = Window.partitionBy(*within).orderBy(F.col("measure").desc(), *group)
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def over_class(df: DataFrame, cls: str, value: str) -> DataFrame:
    """WIN-07: class count, class total and class share next to the detail row, which stays where it is."""
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("class_rows"), F.sum(value).alias("class_total"))
    total = df.agg(F.sum(value).alias("t")).scalar()
    return beside(df, per, cls).withColumn("class_share_pct", pct(F.col("class_total"), total))


def running_sum(df: DataFrame, keys, t: str, col: str, out: str) -> DataFrame:
    """WIN-09: total to date."""
    return df.withColumn(out, F.sum(col).over(_by(keys, t).rowsBetween(Window.unboundedPreceding, 0)))


def running_max(df: DataFrame, keys, t: str, col: str, out: str) -> DataFrame:
    """WIN-10: largest value to date."""
    return df.withColumn(out, F.max(col).over(_by(keys, t).rowsBetween(Window.unboundedPreceding, 0)))


def lags(df: DataFrame, keys, t: str, col: str, steps: Sequence[int]) -> DataFrame:
    """WIN-11: several lags of a dense series."""
    w = _by(keys, t)
    return df.select("*", *[F.lag(col, k).over(w).alias(f"lag_{k}") for k in steps])


def _frame(keys, t: str, width: int, lag: int):
    return _by(keys, t).rowsBetween(-lag - width + 1, -lag)


def roll_mean(df: DataFrame, keys, t: str, col: str, width: int, lag: int, out: str) -> DataFrame:
    """WIN-12: lagged rolling mean, NULL under max(2, width / 4) observations."""
    w = _frame(keys, t, width, lag)
    need = max(2, width // 4)
    return df.withColumn(out, F.when(F.count(col).over(w) >= need, F.avg(col).over(w)))


def roll_std(df: DataFrame, keys, t: str, col: str, width: int, lag: int, out: str) -> DataFrame:
    """WIN-13: lagged rolling sample deviation, NULL under width / 4 observations."""
    w = _frame(keys, t, width, lag)
    need = max(2, width // 4)
    return df.withColumn(out, F.when(F.count(col).over(w) >= need, F.stddev_samp(col).over(w)))


def mean_of_known(cols: Sequence[Column]) -> Column:
    """Mean over the values that are not NULL."""
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols[1:]), F.when(cols[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return total / nonzero(known.cast("double"))


def same_weekday(df: DataFrame, keys, t: str, col: str, out: str = "samedow_mean4") -> DataFrame:
    """WIN-14: mean of the same weekday 2, 3, 4 and 5 weeks back."""
    w = _by(keys, t)
    return df.withColumn(out, mean_of_known([F.lag(col, k).over(w) for k in (14, 21, 28, 35)]))


def zero_rate(df: DataFrame, keys, t: str, col: str, width: int, lag: int, out: str) -> DataFrame:
    """WIN-15: share of empty steps in the lagged frame."""
    w = _frame(keys, t, width, lag)
    need = max(2, width // 4)
    zero = F.when(F.col(col) == 0, 1.0).otherwise(0.0)
    return df.withColumn(out, F.when(F.count(col).over(w) >= need, F.avg(zero).over(w)))


def demean(df: DataFrame, grp: str, cols: Sequence[str]) -> DataFrame:
    """WIN-16: subtract the group mean; means are joined back."""
    means = df.groupBy(grp).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, grp)
    for c in cols:
        out = out.withColumn(c, F.col(c) - F.col(f"_m_{c}"))
    return out.drop(*[f"_m_{c}" for c in cols])


def rank_in(df: DataFrame, grp: list[str], col: str) -> DataFrame:
    """WIN-17: 1 + rows above within the group, and the group size."""
    w = Window.partitionBy(*grp)
    return df.withColumn("rank", F.rank().over(w.orderBy(F.col(col).desc()))).withColumn("of", F.count(F.lit(1)).over(w))


def decile(df: DataFrame, col: str, key: str, n: int = 10, out: str = "decile") -> DataFrame:
    """WIN-18: equal-sized groups by predicted value, ties by key."""
    return exact_ntile(df, [col, key], {out: n})


def consecutive_diff(df: DataFrame, keys, seq: str, cols: Sequence[str]) -> DataFrame:
    """WIN-19: differences between neighbouring steps; gaps are left out."""
    w = _by(keys, seq)
    out = df.select(
        "*", (F.col(seq) - F.lag(seq).over(w)).alias("_gap"), *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in cols]
    )
    return out.where(F.col("_gap") == 1).drop("_gap")


def last_known(df: DataFrame, key: str, t: str, cols: Sequence[str]) -> DataFrame:
    """WIN-20: the values of the last row of each key."""
    return df.groupBy(key).agg(*[F.max_by(c, t).alias(c) for c in cols])
