"""Set operations and reshaping (SET-01..08)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """SET-01: like-shaped parts one under the other, matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-03: rows present in both."""
    return a.intersect(b)


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    """SET-04: wide to long in one scan."""
    return df.unpivot(ids, cols, name, value)


def statement_lines(df: DataFrame, ids: list[str], spec: Sequence[tuple[str, Column, Column, int]]) -> DataFrame:
    """SET-05: statement lines from one wide row: label, actual, budget, total flag."""
    rows = [
        F.struct(
            F.lit(i).alias("line_order"), F.lit(label).alias("line_label"),
            a.cast("double").alias("actual_amt"), b.cast("double").alias("budget_amt"), F.lit(t).alias("is_total"),
        )
        for i, (label, a, b, t) in enumerate(spec, 1)
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def to_ledger(df: DataFrame, ids: list[str], accounts: Sequence[tuple[str, str, str, dict[str, Column]]]) -> DataFrame:
    """SET-06: wide to account-long; costs come in negative."""
    rows = [
        F.struct(
            F.lit(code).alias("account_code"), F.lit(name).alias("account_name"), F.lit(group).alias("account_group"),
            *[c.cast("double").alias(k) for k, c in amounts.items()],
        )
        for code, name, group, amounts in accounts
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def funnel_rows(df: DataFrame, base: str, stages: Sequence[tuple[str, str]]) -> DataFrame:
    """SET-07: funnel stages as rows of one aggregate."""
    one = df.agg(F.sum(base).alias("_b"), *[F.sum(c).alias(f"_{i}") for i, (_, c) in enumerate(stages)])
    rows = [
        F.struct(
            F.lit(label).alias("stage"), F.lit(i + 1).alias("stage_order"),
            F.round(
                F.lit(100.0) * F.col(f"_{i}").cast("double") / F.nullif(F.col("_b").cast("double"), F.lit(0.0)), 2
            ).alias("pct_of_base"),
        )
        for i, (label, _) in enumerate(stages)
    ]
    return one.select(F.inline(F.array(*rows)))


def waterfall(df: DataFrame, start: tuple[str, Column], steps: Sequence[tuple[str, str, Column]], end: str) -> DataFrame:
    """SET-08: waterfall rows with floating base and bar kind.

    ``df`` is one row; each step is (label, up or down, amount).  The base of a
    falling bar is the level after it, of a rising bar the level before it.
    """
    level = start[1]
    rows = [(start[0], F.lit(0), start[1], "total")]
    for label, kind, amount in steps:
        after = level - amount if kind == "down" else level + amount
        rows.append((label, after if kind == "down" else level, amount, kind))
        level = after
    rows.append((end, F.lit(0), level, "total"))
    return df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("step_order"), F.lit(label).alias("step_label"),
                        F.round(base, 2).cast("double").alias("base_amt"),
                        F.round(bar, 2).cast("double").alias("bar_amt"), F.lit(kind).alias("bar_kind"),
                    )
                    for i, (label, base, bar, kind) in enumerate(rows, 1)
                ]
            )
        )
    )
