"""All queries of the library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import FAMILIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["promoted_incidents"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for family in FAMILIES for k, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for family in FAMILIES for k, q in family.SQL.items()}
