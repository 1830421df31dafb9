"""Problem 6: filling containers of fixed capacity.

Windows of WINDOW containers are filled by deficit round-robin over one queue per source: in each window a source may send
tokens up to its quantum, its share of the window, plus the deficit that it carries; an item that exceeds this waits and
the deficit is carried on. A queue that has ended leaves its quantum to the others in proportion to their shares.

What all queues have sent while a queue of weight w sent its first e tokens is a sum over the sources alone: each has sent
w' e / w tokens or all it has. So the window of an item follows from the running total of its own queue, which is taken over
cells of the queue first and within cells after: deficits pass from window to window and from partition to partition
without a sequential pass, and no source is one task. Each window, a bounded number of tokens, is then packed by best fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions.types import row
from inkgauge.session import materialized

#: Tokens of a window at least, and containers in it at least. A window is the unit that one task packs.
WINDOW_TOKENS, WINDOW = 400_000, 64
#: Tokens of a cell of a queue, about.
CELL_TOKENS = 2_000_000
#: Items without tokens in a window, about.
EMPTY_ITEMS = 50_000

_PACKED = row(container="string", window="long", bin="int", source="string", doc_id="long", piece="long", start_token="long", tokens="long")


def pieces(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """container, capacity, doc_id, source, piece, start_token, tokens: every document for every container.

    A document is one piece unless it exceeds the capacity; a longer one is cut into full pieces and a rest. Empty
    documents are one piece of 0 tokens. Containers whose capacity is null or not positive take nothing.
    """
    specs = specs.filter("capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("long").alias("capacity"))
    every = sized.join(F.broadcast(specs))  # as many rows of specs as there are kinds of container
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("long") - 1, F.lit(0))
    cut = every.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * F.col("capacity")
    return cut.select("container", "capacity", "doc_id", "source", "piece", start.alias("start_token"), F.least(F.col("capacity"), F.col("tokens") - start).alias("tokens"))


def schedule(items: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """items with window: the round of deficit round-robin in which each is served.

    shares (source, share) are the target proportions of every window, taken in proportion over the sources that have
    tokens; a source named twice has the sum. By default each source's share is its own part of all tokens, with which all
    queues end together. Sources that shares does not name, or names with a share that is null or not positive, have
    windows of their own after all others, in proportion to their tokens. A queue stands in hash order of its documents.
    """
    queue = F.coalesce("source", F.lit("\0"))
    per_window = F.greatest(F.lit(WINDOW_TOKENS), F.col("capacity") * WINDOW)
    items = items.withColumn("queue", queue).withColumn("place", F.xxhash64("doc_id", F.lit("queue")))
    have = items.groupBy("container", "queue").agg(F.sum("tokens").alias("_sum"), F.count_if(F.col("tokens") == 0).alias("_none"))
    if shares is None:
        have = have.withColumn("_share", F.col("_sum").cast("double"))
    else:
        asked = shares.groupBy(queue.alias("queue")).agg(F.sum(F.greatest("share", F.lit(0.0))).alias("_share"))
        have = have.join(asked, "queue", "left")
    # Queues without a target come after the others: their weight is what they hold.
    have = have.withColumn("_later", ~F.coalesce(F.col("_share") > 0, F.lit(False)))
    have = have.withColumn("weight", F.when(F.col("_later"), F.col("_sum").cast("double")).otherwise(F.col("_share")))
    queues = F.struct("_later", F.col("_sum").alias("has"), "weight")
    quanta = have.withColumn("queues", F.collect_list(queues).over(W.partitionBy("container")))  # one of each source
    quanta = quanta.withColumn("cells", F.ceil(F.col("_sum") / CELL_TOKENS) + 1)
    quanta = quanta.withColumn("spread", F.ceil(F.col("_none") / EMPTY_ITEMS)).select("container", "queue", "_later", "weight", "queues", "cells", "spread")
    placed = items.join(F.broadcast(quanta), ["container", "queue"])  # one row per source and container
    placed = placed.withColumn("cell", F.pmod("place", F.col("cells")))
    cells = placed.groupBy("container", "queue", "cell").agg(F.sum("tokens").alias("_t"))
    before = F.sum("_t").over(W.partitionBy("container", "queue").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("container", "queue", "cell", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("tokens").over(W.partitionBy("container", "queue", "cell").orderBy("place", "doc_id", "piece"))
    sent = placed.join(cells, ["container", "queue", "cell"]).withColumn("_end", F.col("_before") + within)
    turn = F.try_divide(F.col("_end").cast("double"), F.col("weight"))
    total = lambda queues, value: F.aggregate(queues, F.lit(0.0), lambda acc, q: acc + value(q))
    mine = F.filter("queues", lambda q: q["_later"] == F.col("_later"))
    served = total(mine, lambda q: F.least(q["has"].cast("double"), q["weight"] * turn))
    named = total(F.filter("queues", lambda q: ~q["_later"]), lambda q: q["has"].cast("double"))
    first = F.when(F.col("_later"), F.ceil(named / per_window)).otherwise(F.lit(0))
    window = first + F.greatest(F.ceil(F.coalesce(served / per_window, F.lit(0.0)) - 1e-9).cast("long") - 1, F.lit(0))
    # Items without tokens take no part in the round-robin; they are spread so that no window holds many of them.
    window = F.when(F.col("tokens") == 0, F.pmod("place", F.greatest("spread", F.lit(1)))).otherwise(window).cast("long")
    return sent.withColumn("window", window).drop("queue", "place", "cells", "cell", "weight", "queues", "_later", "spread", "_before", "_end")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, by best fit in descending order."""
    bins: list[int] = [0] * len(sizes)
    free: list[tuple[int, int]] = []
    used = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, number = free.pop(at)
        else:
            left, number, used = capacity, used, used + 1
        bins[i] = number
        if left > size:
            insort(free, (left - size, number))
        elif size == 0:
            insort(free, (left, number))
    return bins


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "piece"], kind="stable")
    group["bin"] = best_fit(group["tokens"].tolist(), int(group["capacity"].iloc[0]))
    return group[_PACKED.names]


def pack(sized: DataFrame, specs: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """container, window, bin, source, doc_id, piece, start_token, tokens of every document in every kind of container.

    A container is known by its kind, window and bin. sized: doc_id, source, tokens. shares as in schedule().
    """
    planned = schedule(pieces(sized, specs), shares)
    return planned.groupBy("container", "window").applyInPandas(_pack, _PACKED)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind of container: containers used, tokens, unused tokens and their share, and the fewest containers possible."""
    used = packed.groupBy("container", "window", "bin").agg(F.sum("tokens").alias("t")).groupBy("container")
    used = used.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    out = used.join(F.broadcast(specs), "container").withColumn("room", F.col("containers") * F.col("capacity_tokens"))
    return out.select(
        "container", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest_possible"), "tokens",
        "fullest", (F.col("room") - F.col("tokens")).alias("unused"), ((F.col("room") - F.col("tokens")) / F.col("room")).alias("unused_share"),
    )


def proportions(packed: DataFrame) -> DataFrame:
    """Per kind of container and source: share of all tokens and the least and largest share in a whole window."""
    by_window = packed.groupBy("container", "window", "source").agg(F.sum("tokens").alias("t"))
    by_window = by_window.withColumn("w", F.sum("t").over(W.partitionBy("container", "window")))
    by_window = by_window.withColumn("last", F.max("window").over(W.partitionBy("container")))
    total = F.sum("t").over(W.partitionBy("container"))
    by_window = by_window.withColumn("all", total).withColumn("share", F.try_divide(F.col("t"), F.col("w")))
    whole = F.when(F.col("window") < F.col("last"), F.col("share"))
    return by_window.groupBy("container", "source").agg(
        F.try_divide(F.sum("t"), F.first("all")).alias("share"), F.min(whole).alias("least"), F.max(whole).alias("most")
    )
