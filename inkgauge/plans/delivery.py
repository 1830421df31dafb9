"""Queries of problem 3: messages delivered more than once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.operators import delivery
from inkgauge.plans.base import Register
from inkgauge.session import materialized
from inkgauge.sources.tables import table

query = Register()
_COLUMNS = ("delivery_id", "item_id", "raw_value", "received_at")

_TRIMMED = r"regexp_replace(nfc_normalize({0}), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
#: Identifier of every delivery, and its content as the sorted leaves of the JSON value.
_MESSAGES = rf"""k AS (SELECT delivery_id, received_at, raw_value, coalesce(nullif({_TRIMMED.format('item_id')}, ''), nullif({_TRIMMED.format("json_extract_string(raw_value, '$.id')")}, '')) AS identifier FROM jsonl_rows),
leaves AS (SELECT k.delivery_id, list_sort(list(j.fullkey || '=' || j.type || '=' || coalesce(json_extract_string(j.atom, '$'), ''))) AS content FROM k, json_tree(k.raw_value) AS j WHERE j.atom IS NOT NULL GROUP BY 1),
m AS (SELECT k.delivery_id, k.received_at, k.identifier, leaves.content, row_number() OVER (PARTITION BY k.identifier, leaves.content ORDER BY k.received_at NULLS LAST, k.delivery_id) AS place
  FROM k LEFT JOIN leaves ON k.delivery_id = leaves.delivery_id WHERE k.identifier IS NOT NULL)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(delivery.messages(table(spark, sf_dir, "jsonl_rows", *_COLUMNS)), "messages")


@query(f"WITH {_MESSAGES} SELECT delivery_id FROM m WHERE place > 1")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.surplus(table(spark, sf_dir, "jsonl_rows", *_COLUMNS))


@query(f"WITH {_MESSAGES} SELECT identifier, delivery_id FROM m WHERE place = 1")
def p3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy kept of every message, absorbed as one batch."""
    return delivery.absorbed(_known(spark, sf_dir), 1)[0].select("identifier", "delivery_id")


@query(rf"""WITH {_MESSAGES}, n AS (SELECT DISTINCT regexp_extract(identifier, '^(?s)(.*?)[0-9]{{9,18}}$', 1) || '#' || length(regexp_extract(identifier, '[0-9]{{9,18}}$')) AS producer,
  CAST(regexp_extract(identifier, '[0-9]{{9,18}}$') AS BIGINT) AS number FROM m WHERE regexp_matches(identifier, '[0-9]{{9,18}}$')),
i AS (SELECT *, number - row_number() OVER (PARTITION BY producer ORDER BY number) AS run FROM n)
SELECT producer, min(number) AS low, max(number) AS high, count(*) AS numbers FROM i GROUP BY producer, run""")
def p3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges seen after all batches."""
    state = delivery.absorbed(_known(spark, sf_dir))[1]
    return delivery.ranges(state.seen).withColumn("numbers", F.col("high") - F.col("low") + 1)


QUERIES, SQL = query.QUERIES, query.SQL
