"""Exactly one copy of each message of an at-least-once stream.

An identifier that ends in a sequence number of fixed width is a producer and a number. Per producer the seen numbers are
kept as disjoint ranges, and a batch is judged by them:

- a number outside the ranges is accepted once, without any lookup, and is covered from then on;
- a number inside them has been seen, but another content is another message, which ranges cannot tell: such deliveries,
  and numbers that come with several contents in one batch, are looked up among the accepted messages of their number;
- other identifiers are malformed and looked up by their exact key (identifier, content).

Ranges are kept cut at the borders of blocks of BLOCK numbers. Placing numbers in ranges and merging ranges are sorts
within (producer, block), so no step lists the numbers of a range and no producer is one group.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgauge.functions.types import row
from inkgauge.session import materialized

#: Numbers of a block. A group of (producer, block) has at most so many numbers and half as many ranges.
BLOCK = 1 << 16
#: Digits of a sequence number; identifiers that end in fewer are malformed.
DIGITS = "9,18"
#: Batches, by received_at, in which a whole table is absorbed.
BATCHES = 2

_SEEN = "producer string, block bigint, low bigint, high bigint"
_KEYS = "identifier string, digest string"
_SINK = "producer string, number bigint, digest string"


@dataclass(frozen=True)
class State:
    """What absorb() knows: seen ranges, exact keys of malformed identifiers, and the accepted messages that have numbers.

    The last is the stream's own output and is only read where a covered number comes again; what has to be kept besides
    are the ranges and the keys.
    """

    seen: DataFrame
    keys: DataFrame
    sink: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], schema) for schema in (_SEEN, _KEYS, _SINK)))


def canonical_json(text: str) -> str | None:
    """Canonical spelling: sorted keys, compact separators, Unicode kept; None if text is no JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def _message(item_id: str | None, raw: str | None) -> tuple[str | None, str | None]:
    clean = lambda v: unicodedata.normalize("NFC", v).strip()
    identifier = clean(item_id) if isinstance(item_id, str) else ""
    if not isinstance(raw, str):
        return identifier or None, None
    try:
        value = json.loads(raw)
        content = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        value, content = None, "\0" + raw
    if not identifier and isinstance(value, dict) and value.get("id") is not None:
        given = value["id"]
        identifier = clean(given if isinstance(given, str) else json.dumps(given))
    return identifier or None, hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(row(identifier="string", digest="string"))
def _messages(item_id: pd.Series, raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_message(a, b) for a, b in zip(item_id, raw)], columns=["identifier", "digest"])


def messages(rows: DataFrame) -> DataFrame:
    """delivery_id, received_at, identifier, digest, producer and number of every row of a received stream.

    The identifier is item_id in NFC without outer white space or, where that is missing or empty, the id in raw_value; it
    is null where neither exists. The digest is the SHA-256 of raw_value's canonical JSON; text that is no JSON counts as
    its own content, null as the empty one. producer and number are null where the identifier has no sequence number.
    """
    out = rows.select("delivery_id", "received_at", _messages("item_id", "raw_value").alias("m"))
    out = out.select("delivery_id", "received_at", "m.identifier", F.coalesce("m.digest", F.lit("")).alias("digest"))
    digits = F.regexp_extract("identifier", rf"([0-9]{{{DIGITS}}})$", 1)
    stem = F.regexp_extract("identifier", rf"^(?s)(.*?)[0-9]{{{DIGITS}}}$", 1)
    return out.withColumns(
        {
            "producer": F.when(digits != "", F.concat(stem, F.lit("#"), F.length(digits))),
            "number": F.when(digits != "", digits).cast("long"),
        }
    )


def _first() -> Column:
    return F.min(F.struct(F.col("received_at").isNull().alias("late"), "received_at", "delivery_id"))["delivery_id"]


def placed(numbers: DataFrame, seen: DataFrame) -> DataFrame:
    """numbers (producer, number, ...) with block and old, whether the number lies in a range of seen.

    The greatest start of a range at or below a number decides: one sort of numbers and starts within (producer, block).
    """
    block = F.floor(F.col("number") / BLOCK).cast("long")
    starts = seen.select("producer", "block", F.col("low").alias("number"), F.col("high").alias("_reach"))
    rows = numbers.withColumn("block", block).unionByName(starts.withColumn("_start", F.lit(True)), allowMissingColumns=True)
    order = W.partitionBy("producer", "block").orderBy("number", F.asc_nulls_last("_start"))
    reach = F.last("_reach", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("old", F.coalesce(reach >= F.col("number"), F.lit(False))).filter("_start is null")
    return rows.drop("_reach", "_start")


def islands(numbers: DataFrame) -> DataFrame:
    """(producer, block, low, high): maximal runs within blocks of the different numbers (producer, number); null producers
    have none.
    """
    cells = numbers.filter(F.col("producer").isNotNull()).select("producer", "number").distinct()
    cells = cells.withColumn("block", F.floor(F.col("number") / BLOCK).cast("long"))
    first = F.col("number") - F.row_number().over(W.partitionBy("producer", "block").orderBy("number"))
    runs = cells.withColumn("_run", first).groupBy("producer", "block", "_run")
    return runs.agg(F.min("number").alias("low"), F.max("number").alias("high")).drop("_run")


def merged(parts: DataFrame) -> DataFrame:
    """(producer, block, low, high) of disjoint parts, with those that touch within a block made one. Only ends are read."""
    order = W.partitionBy("producer", "block").orderBy("low")
    new = F.coalesce(F.lag("high").over(order) + 1 != F.col("low"), F.lit(True)).cast("long")
    runs = parts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy("producer", "block", "_run")
    return runs.agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def ranges(seen: DataFrame) -> DataFrame:
    """Disjoint maximal ranges (producer, low, high) of seen, over the borders of blocks.

    A whole inner range stays as it is; only those that reach a border, at most two of a block, are sorted per producer.
    """
    inner = (F.col("low") % BLOCK != 0) & (F.col("high") % BLOCK != BLOCK - 1)
    order = W.partitionBy("producer").orderBy("low")
    new = F.coalesce(F.lag("high").over(order) + 1 != F.col("low"), F.lit(True)).cast("long")
    edge = seen.filter(~inner).withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    edge = edge.groupBy("producer", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return seen.filter(inner).select("producer", "low", "high").unionByName(edge.select("producer", "low", "high"))


def absorb(batch: DataFrame, state: State) -> tuple[DataFrame, State]:
    """One batch of messages() against the state: (accepted, new state).

    accepted: delivery_id, identifier, digest, producer, number, by_range, one row for each new message; by_range is true
    where the ranges alone have decided. Of copies in one batch the earliest received_at (null last) is accepted, then the
    smallest delivery_id. Rows without an identifier are no messages: they are not in accepted, and they are never surplus.
    """
    named = batch.filter(F.col("identifier").isNotNull())
    counted = named.filter(F.col("producer").isNotNull()).groupBy("producer", "number").agg(
        F.min("digest").alias("digest"), F.max("digest").alias("other"), _first().alias("delivery_id")
    )
    numbers = materialized(placed(counted, state.seen), "numbers")
    one = F.col("digest") == F.col("other")
    columns = ["producer", "number", "digest", "delivery_id"]
    fresh = numbers.filter(~F.col("old") & one).select(*columns)
    # Numbers with several contents in this batch, few: each content is a message of its own.
    several = named.join(numbers.filter(~one).select("producer", "number"), ["producer", "number"], "left_semi")
    several = several.groupBy("producer", "number", "digest").agg(_first().alias("delivery_id"))
    asked = numbers.filter(F.col("old") & one).select(*columns).unionByName(several.select(*columns))
    asked = asked.join(state.sink, ["producer", "number", "digest"], "left_anti")
    malformed = named.filter(F.col("producer").isNull()).groupBy("identifier", "digest").agg(_first().alias("delivery_id"))
    malformed = malformed.join(state.keys, ["identifier", "digest"], "left_anti")
    digits = F.element_at(F.split("producer", "#"), -1).cast("int")
    stem = F.expr("left(producer, length(producer) - length(element_at(split(producer, '#'), -1)) - 1)")
    identifier = F.concat(stem, F.lpad(F.col("number").cast("string"), digits, "0"))
    by_number = fresh.withColumn("by_range", F.lit(True)).unionByName(asked.withColumn("by_range", F.lit(False)))
    new = by_number.withColumn("identifier", identifier).unionByName(malformed.withColumn("by_range", F.lit(False)), allowMissingColumns=True)
    new = materialized(new, "accepted")
    ours = new.filter("producer is not null")
    seen = merged(state.seen.unionByName(islands(numbers.filter(~F.col("old")))))
    return new, State(
        materialized(seen, "seen"),
        state.keys.unionByName(new.filter("producer is null").select("identifier", "digest")),
        state.sink.unionByName(ours.select("producer", "number", "digest")),
    )


def absorbed(known: DataFrame, batches: int | None = None) -> tuple[DataFrame, State]:
    """(accepted, state) of messages() taken in batches in the order of received_at (null last) on an empty state.

    Batches have about equal sizes; deliveries of one time share a batch.
    """
    batches = BATCHES if batches is None else batches
    state = empty_state(known.sparkSession)
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(known.agg(F.percentile_approx("received_at", shares)).first()[0] or [])) if shares else []
    at = F.col("received_at")
    new = []
    for after, until in zip([None, *cuts], [*cuts, None]):
        batch = known if after is None else known.filter((at > F.lit(after)) | at.isNull())
        batch = batch if until is None else batch.filter(at <= F.lit(until))
        found, state = absorb(batch, state)
        new.append(found)
    return reduce(DataFrame.unionByName, new), state


def surplus(rows: DataFrame, batches: int | None = None) -> DataFrame:
    """delivery_id of every delivery that has an identifier and is not accepted by absorb().

    rows: delivery_id, item_id, raw_value, received_at; other columns are ignored. Rows without an identifier, and an
    empty table, give nothing. Copies are counted before they are shuffled and surplus rows are found by their unique
    delivery_id, so a message that is delivered very often is no hot key.
    """
    known = materialized(messages(rows), "messages")
    accepted, _ = absorbed(known, batches)
    return known.filter(F.col("identifier").isNotNull()).select("delivery_id").join(accepted.select("delivery_id"), "delivery_id", "left_anti")
