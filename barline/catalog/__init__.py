"""Registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.catalog import registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in registry.load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in registry.load().items() if entry.sql}
