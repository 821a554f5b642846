"""All core queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import catalog, graphs, resolutions, searches, sources, training

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [catalog, graphs, resolutions, searches, sources, training]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Impact radius of a shared class by kind of symbol and distance."""
    return graphs.impact_by_kind(spark, folder)
