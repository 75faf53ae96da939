"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalogue, changes, desk, intake, payloads, reviews


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**changes.Q.run, **reviews.Q.run, **catalogue.Q.run, **desk.Q.run, **intake.Q.run, **payloads.Q.run}


def oracle_sql() -> dict[str, str]:
    return {**changes.Q.sql, **reviews.Q.sql, **catalogue.Q.sql, **desk.Q.sql, **intake.Q.sql, **payloads.Q.sql}
