"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from depotflow.catalog.star_sql import with_tables
from depotflow.sources.star import StarWarehouse


@dataclass(frozen=True)
class Query:
    build: Callable[[StarWarehouse], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(StarWarehouse(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def register(name: str, build: Callable[[StarWarehouse], DataFrame], sql: str | None,
             extra: dict[str, str] | None = None) -> None:
    """Name a query; ``extra`` holds further table expressions its SQL reads."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = Query(build, with_tables(sql, extra) if sql else None)
