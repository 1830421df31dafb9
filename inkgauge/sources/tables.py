"""Readers of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgauge.session import plan_bytes, spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of sf_dir; columns restricts what the scan reads."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """table() for work that is heavy on CPU: a small table is spread over all cores."""
    whole = table(spark, sf_dir, name)
    return spread(whole.select(*columns) if columns else whole, plan_bytes(whole))
