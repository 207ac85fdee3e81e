"""Join shapes of the reports and marts (JN-01..23).

No join here is hinted: the planner and adaptive execution broadcast a side
only when its measured size is under the session's limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.session import cut_lineage

MAX_INLINE_ROWS = 10_000
SMALL_SIDE_ROWS = 100_000
#: Items of a basket that are paired within one row.
BLOCK_ITEMS = 512


def enrich(df: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """JN-02: left joins to optional one-row-per-key dimensions."""
    return reduce(lambda acc, d: acc.join(d[0], d[1], "left"), dims, df)


def assemble(spine: DataFrame, parts: Sequence[DataFrame], keys: list[str], zero: Sequence[str] = ()) -> DataFrame:
    """JN-03: pre-aggregates onto one spine; the named measures default to 0."""
    out = reduce(lambda acc, p: acc.join(p, keys, "left"), parts, spine)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in set(zero) else F.col(c) for c in out.columns])


def join_clean(left: DataFrame, right: DataFrame, left_key: str, right_key: str, residual: Column | None = None, how: str = "left") -> DataFrame:
    """JN-04: join on a trimmed key with an extra condition in the ON clause."""
    on = F.trim(left[left_key]) == right[right_key]
    return left.join(right, on if residual is None else on & residual, how)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """JN-05: the columns of a one-row aggregate beside every row, as scalar
    subqueries, so there is no cross join to plan."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return df.select("*", packed.alias("_s")).select(*df.columns, "_s.*")


def beside(df: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Group totals beside the detail rows, null keys included, without moving the detail rows.

    The totals are written and counted; up to SMALL_SIDE_ROWS of them are sent to
    every executor, more of them are joined on the key, where adaptive execution
    splits a hot one.
    """
    totals = cut_lineage(totals)
    side = totals.withColumnRenamed(key, "_group")
    small = totals.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS
    return df.join(F.broadcast(side) if small else side, df[key].eqNullSafe(F.col("_group"))).drop("_group")


def explode_by_dim(df: DataFrame, dim: DataFrame) -> DataFrame:
    """JN-06: one output row per row and dimension member, at any size.

    A dimension of at most MAX_INLINE_ROWS is inlined as an array; a larger one
    is dealt into buckets of about that size and joined by bucket, which adaptive
    execution splits further."""
    row = F.struct(*dim.columns)
    if dim.limit(MAX_INLINE_ROWS + 1).count() <= MAX_INLINE_ROWS:
        members = dim.agg(F.sort_array(F.collect_list(row)).alias("a"))
        return df.select("*", F.explode(members.scalar()).alias("_d")).select(*df.columns, "_d.*")
    buckets = -(-dim.count() // MAX_INLINE_ROWS)
    dealt = dim.select(F.pmod(F.xxhash64(*dim.columns), F.lit(buckets)).cast("int").alias("_b"), row.alias("_d"))
    spread = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    return spread.join(dealt, "_b").select(*df.columns, "_d.*")


def asof_snapshots(history: DataFrame, cutoffs: Sequence[int], t: str, out: str = "as_of") -> DataFrame:
    """JN-07: every history row with every cutoff on or after it."""
    marks = F.array(*[F.lit(c) for c in cutoffs])
    return history.withColumn(out, F.explode(F.filter(marks, lambda c: c >= F.col(t))))


def lookback_join(events: DataFrame, cutoffs: Sequence[int], t: str, days: int, out: str = "as_of") -> DataFrame:
    """JN-08: rows in (cutoff - days, cutoff]."""
    marks = F.array(*[F.lit(c) for c in cutoffs])
    inside = F.filter(marks, lambda c: (c >= F.col(t)) & (c - days < F.col(t)))
    return events.withColumn(out, F.explode(inside))


def forward_join(events: DataFrame, cutoffs: Sequence[int], t: str, horizon: int, out: str = "as_of") -> DataFrame:
    """JN-09: rows strictly after the cutoff, at most ``horizon`` days on."""
    marks = F.array(*[F.lit(c) for c in cutoffs])
    inside = F.filter(marks, lambda c: (c < F.col(t)) & (F.col(t) <= c + horizon))
    return events.withColumn(out, F.explode(inside))


def dense_spine(pairs: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """JN-10: one row per step of each pair's carried life."""
    return pairs.withColumn(out, F.explode(F.sequence(F.col(first), F.col(last))))


def active_count(days: DataFrame, intervals: DataFrame, day: str, start: str, end: str, out: str) -> DataFrame:
    """JN-11: intervals open on each day.  Starts and ends are counted per day
    and summed over time: linear in days plus intervals, whatever their length."""
    edges = (
        intervals.select(F.col(start).alias("_d"), F.lit(1).alias("_s"))
        .unionByName(intervals.select(F.date_add(end, 1).alias("_d"), F.lit(-1).alias("_s")))
        .groupBy("_d").agg(F.sum("_s").alias("_s"))
    )
    marks = days.select(F.col(day).alias("_d"), F.lit(0).cast("bigint").alias("_s"), F.lit(1).alias("_q"))
    both = marks.unionByName(edges.withColumn("_q", F.lit(0)))
    # calendar-sized: at most one row per day plus one per edge day
    w = Window.partitionBy(F.lit(0)).orderBy("_d", "_q").rowsBetween(Window.unboundedPreceding, 0)
    open_now = both.withColumn(out, F.sum("_s").over(w)).where("_q = 1").select(F.col("_d").alias(day), out)
    return days.join(open_now, day)


def rate_intervals(rates: DataFrame, key: str, eff: str) -> DataFrame:
    """Effective-dated rows with the date the next one replaces them."""
    w = Window.partitionBy(key).orderBy(eff)
    return rates.withColumn("_until", F.lead(eff).over(w))


def asof_join(df: DataFrame, rates: DataFrame, key: str, t: str, eff: str, how: str = "left") -> DataFrame:
    """JN-12: the latest rate with effective date on or before ``t``.

    Rates become half-open intervals, so each left row meets at most one; the
    join stays an equi-join on the key that adaptive execution can split.
    """
    spans = rate_intervals(rates, key, eff).withColumnRenamed(key, "_k")
    on = (df[key] == spans["_k"]) & (df[t] >= spans[eff]) & (spans["_until"].isNull() | (df[t] < spans["_until"]))
    return df.join(spans, on, how).drop("_k", "_until")


def prior_year(df: DataFrame, keys: list[str], ym: str, measures: list[str]) -> DataFrame:
    """JN-13: each month beside the same month a year before."""
    prev = df.select(*keys, (F.col(ym) + 100).alias(ym), *[F.col(c).alias(f"{c}_py") for c in measures])
    return df.join(prev, [*keys, ym], "left")


def version_pivot(df: DataFrame, keys: list[str], ver: str, versions: dict[str, str], measures: list[str]) -> DataFrame:
    """JN-14: versions of one table side by side, in one pass."""
    aggs = [
        F.max(F.when(F.col(ver) == v, F.col(c))).alias(f"{prefix}_{c}")
        for v, prefix in versions.items() for c in measures
    ]
    return df.groupBy(*keys).agg(*aggs)


def basket_pairs(items: DataFrame, basket: str = "basket", item: str = "plu", low: int = 2, high: int | None = None, block: int = BLOCK_ITEMS) -> DataFrame:
    """JN-15: unordered item pairs of each basket with at least ``low`` items, and at most ``high`` if that is given.

    A basket of up to ``block`` items is one list, paired within its row. A larger
    one never becomes a list: its items are dealt into k blocks of about that
    size by hash, and every cell (i, j) of the triangle i <= j is a key of its own,
    to which block i comes from the left and block j from the right. A cell makes
    at most about block x block pairs, so one huge basket spreads over k * (k + 1) / 2 keys.
    """
    unique = items.select(basket, item).dropna().distinct()
    large = unique.groupBy(basket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    packed = unique.join(large, basket, "left_anti").groupBy(basket).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    size = F.size("xs")
    packed = packed.where(size >= low if high is None else size.between(low, high))
    left = packed.select(basket, "xs", F.posexplode("xs").alias("i", "item_a"))
    small = left.select(basket, "item_a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("item_b"))
    if high is not None and high <= block:
        return small
    wanted = large.where(F.col("_n") >= low if high is None else F.col("_n").between(low, high))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = unique.join(wanted, basket).select(basket, item, blocks.alias("_k"), F.pmod(F.xxhash64(item), blocks.cast("bigint")).cast("int").alias("_b"))
    rows = dealt.select(basket, F.col(item).alias("item_a"), F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_k") - 1)).alias("_j"))
    columns = dealt.select(basket, F.col(item).alias("item_b"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    cells = rows.join(columns, [basket, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("item_a") < F.col("item_b")))
    return small.unionByName(cells.select(basket, F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b")))


def scalar_lookup(df: DataFrame, other: DataFrame, key: str, agg: Column, out: str) -> DataFrame:
    """JN-16: a per-row lookup total, decorrelated by hand."""
    return df.join(other.groupBy(key).agg(agg.alias(out)), key, "left")


def theta_count(df: DataFrame, other: DataFrame, key: str, cond: Column, out: str) -> DataFrame:
    """JN-17: how many rows of ``other`` with the same key meet a condition."""
    counts = other.where(cond).groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint"))


def below_group_mean(df: DataFrame, grp: str, col: str) -> DataFrame:
    """JN-18: rows under the mean of their own group; the means are joined
    back, so a large group is not sorted in one place."""
    means = df.groupBy(grp).agg(F.avg(col).alias("_mean"))
    return df.join(means, grp).where(F.col(col) < F.col("_mean")).drop("_mean")


def semi(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """JN-19: rows whose key is present on the other side."""
    return df.join(other, key, "left_semi")


def anti(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """JN-20: rows whose key is absent from the other side."""
    return df.join(other, key, "left_anti")


def join_tree(anchor: DataFrame, joins: Sequence[tuple[DataFrame, Column, str]]) -> DataFrame:
    """JN-21: a model's join tree: inner, left, right or full outer, equality
    and extra conditions in one ON column each."""
    return reduce(lambda acc, j: acc.join(j[0], j[1], j[2]), joins, anchor)


def presence_flag(df: DataFrame, other: DataFrame, key: str, out: str) -> DataFrame:
    """JN-22: Y when the key is found on the other side, else N."""
    seen = other.select(key).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, key, "left").withColumn(out, F.when(F.col("_seen"), "Y").otherwise("N")).drop("_seen")


def orphans(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """JN-23: how many rows an inner join would lose."""
    lost = df.join(dim, key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct(key).alias("orphan_keys"))
    return lost
