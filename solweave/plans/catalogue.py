"""All queries outside the training-data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from solweave.plans import problems, solutions, storing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return solutions.queries() | storing.queries() | problems.queries()


def oracle_sql() -> dict[str, str]:
    return solutions.oracle_sql() | storing.oracle_sql() | problems.oracle_sql()
