"""All queries by name, with SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import catalog, records  # noqa: F401  records adds its queries to the catalogue


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.flagship_prf_slices(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
