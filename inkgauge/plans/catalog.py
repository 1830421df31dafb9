"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkgauge.plans import cohorts, delivery, modelling, operations, records, reports, scoring, statistics, texts

_MODULES = (scoring, texts, statistics, cohorts, records, modelling, reports, operations, delivery)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.P07_information_gain(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
