"""Views that queries share, each with its SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Queries of one module by name, with the SQL that tests them where SQL can."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.QUERIES[query.__name__] = query
            if sql is not None:
                self.SQL[query.__name__] = sql.strip()
            return query

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, and no negative zero, so that engines that add in another order agree."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


#: One row per item (model, domain, id) and level; copies of a row are averaged.
RATINGS = """ratings AS (
  SELECT generation_model AS model, domain, id, CAST(substr(level, 2) AS INTEGER) AS lv, avg(actual_ratio) AS r,
         avg(CAST(output_chars AS DOUBLE)) AS chars, avg(CAST(output_tokens AS DOUBLE)) AS tokens
  FROM level_results WHERE level IS NOT NULL GROUP BY 1, 2, 3, 4)"""

#: Items with all five levels scored.
ITEMS = (
    RATINGS
    + """, items AS (
  SELECT * FROM (SELECT *, count(r) OVER (PARTITION BY model, domain, id) AS k FROM ratings) WHERE k = 5 AND r IS NOT NULL)"""
)

#: One row per paired item, and level with both scores.
PAIRED = """paired AS (
  SELECT paired_id, evaluator, generation_model AS model, lower(trim(domain)) AS domain, id, CAST(i AS INTEGER) AS lv,
         whitebox_phi[i] AS phi, blackbox_actual[i] AS act
  FROM paired_items, range(1, 6) AS t(i)
  WHERE whitebox_phi[i] IS NOT NULL AND blackbox_actual[i] IS NOT NULL)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id", "level", "actual_ratio", "output_chars", "output_tokens")
    rows = rows.filter("level is not null")
    keys = [F.col("generation_model").alias("model"), "domain", "id", F.substring("level", 2, 8).cast("int").alias("lv")]
    return rows.groupBy(*keys).agg(
        F.avg("actual_ratio").alias("r"), F.avg(F.col("output_chars").cast("double")).alias("chars"), F.avg(F.col("output_tokens").cast("double")).alias("tokens")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).filter("r is not null")
    whole = rows.groupBy("model", "domain", "id").agg(F.count("*").alias("k")).filter("k = 5").drop("k")
    same = [rows[c].eqNullSafe(whole[c]) for c in ("model", "domain", "id")]
    return rows.join(whole, same, "left_semi")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_items", "paired_id", "evaluator", "generation_model", "domain", "id", "whitebox_phi", "blackbox_actual")
    both = F.arrays_zip(F.col("whitebox_phi").alias("phi"), F.col("blackbox_actual").alias("act"))
    long = rows.select(
        "paired_id", "evaluator", F.col("generation_model").alias("model"), F.lower(F.trim("domain")).alias("domain"), "id", F.posexplode(both).alias("i", "s")
    )
    out = long.select("paired_id", "evaluator", "model", "domain", "id", (F.col("i") + 1).alias("lv"), "s.phi", "s.act")
    return out.filter("lv <= 5 and phi is not null and act is not null")
