"""Governed metrics over DataFrames (SEM-01..11, UDF-01).

A model names dimensions, measures and metrics as SQL text; Spark parses and
plans them.  Users add their own with one call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopledger.functions import fixed, pct
from shopledger.operators.joins import with_scalars

GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Dimension:
    name: str
    expr: str
    kind: str = "string"
    grains: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    """An aggregate as SQL text. One with distinct counts may also say how it is
    made: a formula over named parts, plain aggregates and distinct counts
    (key, condition)."""

    name: str
    expr: str
    unit: str = ""
    formula: str = ""
    plain: tuple[tuple[str, str], ...] = ()
    distinct: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Metric:
    name: str
    measure: str
    by: tuple[str, ...] = ()
    grains: tuple[str, ...] = GRAINS
    filters: tuple[str, ...] = ()
    unit: str = ""


@dataclass
class Model:
    """A named source with its dimensions, measures, metrics and filters."""

    name: str
    source: Callable[[SparkSession, str], DataFrame]
    time: str | None = None
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    calcs: dict[str, str] = field(default_factory=dict)
    prefilters: list[str] = field(default_factory=list)
    narrow: Callable[[SparkSession, str, set[str], list[str]], DataFrame] | None = None

    def dimension(self, name: str, expr: str | None = None, kind: str = "string", grains: Sequence[str] = ()) -> Model:
        """SEM-01: a typed dimension."""
        self.dimensions[name] = Dimension(name, expr or name, kind, tuple(grains))
        return self

    def measure(self, name: str, expr: str, unit: str = "", formula: str = "", plain: dict[str, str] | None = None, distinct: dict[str, tuple[str, str]] | None = None) -> Model:
        """SEM-02, UDF-01: an aggregate given as SQL text.

        Distinct counts beside other aggregates copy every row when they are planned
        as one aggregate. With ``formula``, ``plain`` (part -> aggregate) and
        ``distinct`` (part -> (key, condition)) they are counted at their own grain.
        """
        parts = tuple((k, key, condition) for k, (key, condition) in (distinct or {}).items())
        self.measures[name] = Measure(name, expr, unit, formula, tuple((plain or {}).items()), parts)
        return self

    def metric(self, name: str, measure: str, by: Sequence[str] = (), filters: Sequence[str] = (), grains: Sequence[str] = GRAINS, unit: str = "") -> Model:
        """SEM-03: a metric with default filters, allowed groupings and grains."""
        if measure not in self.measures:
            raise KeyError(f"model {self.name} has no measure {measure}")
        self.metrics[name] = Metric(name, measure, tuple(by), tuple(grains), tuple(filters), unit)
        return self

    def calc(self, name: str, expr: str) -> Model:
        """SEM-10: a calculated field on the rows."""
        self.calcs[name] = expr
        return self

    def prefilter(self, condition: str) -> Model:
        """SEM-10: a row filter every query of the model keeps."""
        self.prefilters.append(condition)
        return self

    def rows(self, spark: SparkSession, folder: str) -> DataFrame:
        return self._prepared(self.source(spark, folder))

    def rows_for(
        self, spark: SparkSession, folder: str, name: str, by: Sequence[str] = (), grain: str | None = None,
        filters: Sequence[str] = (), default_filters: bool = True,
    ) -> DataFrame:
        """The rows of one metric, read from only the tables that its measure,
        groupings and filters name; ``narrow`` gets their words and the filters."""
        if self.narrow is None:
            return self.rows(spark, folder)
        m = self.metrics[name]
        conditions = [*(m.filters if default_filters else ()), *filters, *self.prefilters]
        texts = [self.measures[m.measure].expr, *conditions, *self.calcs.values(), *(self.dimensions[b].expr for b in by if b in self.dimensions)]
        words = set(re.findall(r"\w+", " ".join(texts)))
        return self._prepared(self.narrow(spark, folder, words, conditions))

    def _prepared(self, df: DataFrame) -> DataFrame:
        for name, expr in self.calcs.items():
            df = df.withColumn(name, F.expr(expr))
        for condition in self.prefilters:
            df = df.where(condition)
        return df

    def catalog(self) -> list[tuple[str, str, str, str]]:
        """Everything the model defines: kind, name, type or unit, text."""
        return (
            [("dimension", d.name, d.kind, d.expr) for d in self.dimensions.values()]
            + [("measure", x.name, x.unit, x.expr) for x in self.measures.values()]
            + [("metric", x.name, x.unit, x.measure) for x in self.metrics.values()]
        )


def metric(
    df: DataFrame, model: Model, name: str, by: Sequence[str] = (), grain: str | None = None,
    filters: Sequence[str] = (), default_filters: bool = True, out: str = "value",
) -> DataFrame:
    """SEM-03, SEM-04: one metric over the model's rows.

    Only declared groupings and grains are allowed; the default filters apply
    unless lifted.
    """
    m = model.metrics[name]
    bad = [b for b in by if b not in m.by]
    if bad:
        raise ValueError(f"metric {name} cannot be grouped by {bad}")
    if grain is not None and grain not in m.grains:
        raise ValueError(f"metric {name} has no grain {grain}")
    for condition in [*(m.filters if default_filters else ()), *filters]:
        df = df.where(condition)
    keys = [F.expr(model.dimensions[b].expr).alias(b) for b in by]
    if grain:
        keys.append(F.date_trunc(grain, F.expr(model.time)).cast("date").cast("string").alias(grain))
    return measured(df, model, [m.measure], keys).withColumn(m.measure, F.col(m.measure).cast("double")).withColumnRenamed(m.measure, out)


def measured(df: DataFrame, model: Model, names: Sequence[str], keys: Sequence[Column] = (), fine: bool = False) -> DataFrame:
    """SEM-02: several measures by the same groups, each part at its own grain.

    Plain aggregates take one pass. Distinct counts are first brought to one row
    for each group and counted value, with a flag for each condition, and then
    counted, so a row is never copied; one such pass serves all counts of a key.
    The results meet on the group keys.

    ``fine`` says that groups may be as fine as a row. Combining before the shuffle
    would then hold nearly every row twice in the task that joins them, so the rows
    go to a stage of their own, whose sort finds the first row of each counted value.
    """
    wanted = [model.measures[n] for n in names]
    keyed = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    groups = [f"_k{i}" for i in range(len(keys))]
    plain = {f"{x.name}__{part}" if x.formula else x.name: text for x in wanted for part, text in (x.plain if x.formula else ((x.name, x.expr),))}
    counts: dict[str, list[tuple[str, str]]] = {}
    for x in wanted:
        for part, key, condition in x.distinct:
            counts.setdefault(key, []).append((f"{x.name}__{part}", condition))
    sides = [keyed.groupBy(*groups).agg(*[F.expr(text).alias(name) for name, text in plain.items()])] if plain else []
    for key, parts in counts.items():
        value = F.expr(key)
        flagged = keyed.where(value.isNotNull()).select(*groups, value.alias("_v"), *[F.expr(condition).alias(name) for name, condition in parts])
        if fine and all(condition == "true" for _, condition in parts):
            first = F.row_number().over(Window.partitionBy(*groups, "_v").orderBy("_v"))
            per = flagged.repartition(*groups, "_v").withColumn("_row", first).where("_row = 1")
        else:
            per = flagged.groupBy(*groups, "_v").agg(*[F.max(name).alias(name) for name, _ in parts])
        sides.append(per.groupBy(*groups).agg(*[F.count_if(name).alias(name) for name, _ in parts]))
    out, zero = sides[0], [name for parts in counts.values() for name, _ in parts]
    for i, side in enumerate(sides[1:]):
        if not groups:
            out = with_scalars(out, side)
            continue
        side = side.select(*[F.col(g).alias(f"{g}_{i}") for g in groups], *[c for c in side.columns if c not in groups])
        same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"{g}_{i}")) for g in groups])
        out = out.join(side, same, "full")
        out = out.select(*[F.coalesce(F.col(g), F.col(f"{g}_{i}")).alias(g) for g in groups], *[c for c in out.columns if c not in groups and not c.startswith("_k")])
    out = out.select(*[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) if c in zero else F.col(c) for c in out.columns])

    def value_of(x: Measure) -> Column:
        if not x.formula:
            return F.col(x.name)
        text = x.formula
        for part in [p[0] for p in (*x.plain, *x.distinct)]:
            text = re.sub(rf"\b{part}\b", f"`{x.name}__{part}`", text)
        return F.expr(text).alias(x.name)

    labels = keyed.select(*keys).columns if keys else []
    return out.select(*[F.col(g).alias(label) for g, label in zip(groups, labels, strict=True)], *[value_of(x) for x in wanted])


def ratio_metric(a: DataFrame, b: DataFrame, keys: Sequence[str], scale: int = 4, factor: float = 1.0, out: str = "value") -> DataFrame:
    """SEM-05: one metric over another, joined on their group keys."""
    j = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), list(keys), "full")
    ratio = F.lit(float(factor)) * F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0))
    return j.select(*keys, fixed(ratio, scale).alias(out))


def level_measure(df: DataFrame, keys: Sequence[str], t: str, level: str) -> DataFrame:
    """SEM-06: a balance is read at its last month, never summed over months."""
    return df.groupBy(*keys).agg(F.max_by(level, t).alias(level), F.max(t).alias("as_of"))


def relationship(left: DataFrame, right: DataFrame, key: str, card: str = "N:1") -> DataFrame:
    """SEM-07: a declared join; the query fails if the one side repeats a key."""
    def unique(df: DataFrame) -> DataFrame:
        counted = df.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns if c != key])
        guard = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit(f"{key} repeats on the one side")).cast(df.schema[key].dataType))
        return counted.withColumn(key, guard).drop("_n")

    if card not in ("N:1", "1:1"):
        raise ValueError(f"unknown cardinality {card}")
    return (unique(left) if card == "1:1" else left).join(unique(right), key, "left")


def crosscheck(pairs: Sequence[tuple[str, DataFrame, DataFrame]], tolerance: float = 0.005) -> DataFrame:
    """SEM-08: each metric against an independent figure, with a verdict.

    Both sides are one-row frames whose single column is the number.
    """
    out = None
    for name, a, b in pairs:
        row = a.sparkSession.range(1).select(
            F.lit(name).alias("metric"), a.select(F.col(a.columns[0]).cast("double")).scalar().alias("metric_value"), b.select(F.col(b.columns[0]).cast("double")).scalar().alias("tile_value")
        )
        out = row if out is None else out.unionByName(row)
    x, y = F.col("metric_value"), F.col("tile_value")
    verdict = (
        F.when(x.isNull() | y.isNull(), "NO VALUE").when(x == y, "MATCH")
        .when((y != 0) & (F.abs(x - y) / F.abs(y) <= tolerance), "MATCH (within 0.5 pct)").otherwise("DELTA")
    )
    return out.withColumn("verdict", verdict).withColumn("delta_pct", pct(x - y, y, 4))


def expr_drift(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """SEM-09: stored definitions against expected ones, by metric name."""
    a = actual.select(F.col("name"), F.trim("expr").alias("actual"))
    e = expected.select(F.col("name"), F.trim("expr").alias("expected"))
    j = a.join(e, "name", "full")
    status = F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("actual") == F.col("expected"), "SAME").otherwise("DRIFT")
    return j.withColumn("status", status)


def join_models(models: dict[str, DataFrame], anchor: str, joins: Sequence[tuple[str, str, str]]) -> DataFrame:
    """SEM-11: related model rows joined to an anchor: (model, key, how)."""
    out = models[anchor]
    for name, key, how in joins:
        out = out.join(models[name], key, how)
    return out
