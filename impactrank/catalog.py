"""Registered queries: name -> Spark callable and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from impactrank.plans import queries as registered


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anytime ranking under a medium budget."""
    return registered.QUERIES["rank_anytime_medium"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
