"""Sources with rejects (S) and stream monitors (X)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.plans.base import Register
from inkgauge.sources import strict
from inkgauge.sources.tables import table
from inkgauge.streaming import monitors

query = Register()

_MESSAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("prompt", T.StringType())])


@query("""WITH p AS (SELECT delivery_id, raw_value, json_extract_string(raw_value, '$.id') AS id, sha256(raw_value) AS h FROM jsonl_rows),
c AS (SELECT id, h, count(*) AS n FROM p WHERE id IS NOT NULL AND trim(id) <> '' GROUP BY 1, 2), k AS (SELECT id, count(*) AS contents, min(h) AS first FROM c GROUP BY 1)
SELECT p.delivery_id, CASE WHEN p.id IS NULL OR trim(p.id) = '' THEN 'key missing' WHEN k.contents > 1 AND p.h <> k.first THEN 'conflict' WHEN c.n > 1 THEN 'duplicate' ELSE 'good' END AS reason
FROM p LEFT JOIN c ON p.id = c.id AND p.h = c.h LEFT JOIN k ON p.id = k.id""")
def S01_strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jsonl_rows", "delivery_id", "raw_value")
    checked = strict.checked_lines(rows, "raw_value", _MESSAGE, "id")
    return checked.select("delivery_id", F.coalesce("reason", F.lit("good")).alias("reason"))


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY source_cluster_id) AS k, row_number() OVER (PARTITION BY source_cluster_id ORDER BY sha256(text), doc_id) AS r FROM documents WHERE source_cluster_id IS NOT NULL AND text IS NOT NULL)
SELECT count(*) AS documents, count(DISTINCT CASE WHEN k > 1 THEN source_cluster_id || printf('__row%04d_', r) || substr(sha256(text), 1, 8) ELSE source_cluster_id END) AS identifiers FROM n""")
def S04_unique_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "source_cluster_id", "text").dropna()
    named = strict.unique_ids(rows, "source_cluster_id", "text", "identifier")
    return named.agg(F.count("*").alias("documents"), F.countDistinct("identifier").alias("identifiers"))


@query()
def S15_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = strict.inventory(spark, sf_dir)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size", "sha256")


@query("""SELECT event_id, user_id, count(event_id) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent,
count(event_id) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 3 AS over FROM events""".replace(" AS over FROM", ' AS "over" FROM'))
def X01_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitors.rate_limited(events, "user_id", "ts", "event_id", 3, 3600).drop("ts")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("failed", F.coalesce(F.col("event_type") == "error", F.lit(False)))


@query("""WITH e AS (SELECT user_id, ts, coalesce(event_type = 'error', FALSE) AS failed FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, failed) AS before FROM e),
r AS (SELECT *, sum(CASE WHEN NOT failed OR coalesce(epoch_us(ts) - epoch_us(before) > 3600000000, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, failed ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, count(*) AS failures, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, count(*) >= 6 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 180000000 AS opens FROM r WHERE failed GROUP BY user_id, run""")
def X03_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of failures of a user, its length in time, and whether it opens the circuit: six over three minutes or more."""
    runs = monitors.failure_runs(_failures(spark, sf_dir), "user_id", "ts", "failed")
    micros = F.unix_micros("ended") - F.unix_micros("begun")
    opens = (F.col("failures") >= monitors.FAILURES) & (micros >= monitors.DURATION * 1_000_000)
    return runs.select("user_id", "failures", micros.alias("micros"), opens.alias("opens"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""")
def X04_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = f"counts_{uuid.uuid4().hex[:8]}"
    return monitors.stream_counts(spark, f"{sf_dir}/events.parquet*", schema, "ts", "event_type", "1 hour", "1 hour", name)


QUERIES, SQL = query.QUERIES, query.SQL
