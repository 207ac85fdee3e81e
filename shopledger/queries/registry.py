"""Named queries: a DataFrame builder and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shopledger.session import tune

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under ``name`` with the SQL that must agree with it."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")

        def tuned(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        QUERIES[name] = Query(name, tuned, sql)
        return build

    return add
