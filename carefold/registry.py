"""All queries of the library by name, each over the driver's tables, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carefold.plans import catalog, charts, clinic, clinic_sql, frames


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.queries() | catalog.queries(charts.QUERIES) | frames.queries() | clinic.queries()


def oracle_sql() -> dict[str, str]:
    return catalog.oracle_sql() | catalog.oracle_sql(charts.QUERIES) | frames.oracle_sql() | clinic_sql.oracle_sql()
