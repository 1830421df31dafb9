"""Problem 7: drawing sources towards target shares.

Every document has a place in its source, a 60-bit hash. A source of budget B and size A uses each document B div A
times, and those below a threshold once more. The threshold comes from histograms: tokens by source and the top bits of
the place give the bucket in which the rest of the budget ends, only that bucket is refined by the next bits, and so on
until single documents are left. Documents are then filtered by comparison with the threshold; nothing is sorted, and a
larger budget always keeps what a smaller one drew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.session import materialized

#: Bits by which one level of a histogram divides a bucket, and the levels: 60 bits of a hash.
BITS, LEVELS = 12, 5


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("place")), 64 - BITS * LEVELS)


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, refill: bool = False) -> DataFrame:
    """Per target source: share, max_repeats, documents, available, budget, passes (whole uses) and rest.

    total_tokens is the size to be drawn; by default all tokens of the sources that are in targets. A source gives at most
    max_repeats times what it has. Null shares or repeats count as 0 and 1. Sources named twice add their shares. What a
    source cannot give is missing from the total or, with refill, handed on to the others in proportion to their shares.
    """
    source = F.lower(F.trim("source"))
    share = F.greatest(F.coalesce(F.sum("target_share"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.groupBy(source.alias("source")).agg(
        share.alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("long").alias("max_repeats")
    )
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    joined = wanted.join(have, "source", "left").withColumns(
        {"documents": F.coalesce("documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))}
    )
    everything = W.partitionBy()  # one row per target source
    size = F.lit(total_tokens) if total_tokens is not None else F.sum("available").over(everything)
    shares = F.sum("target_share").over(everything)
    asked = F.floor(F.coalesce(F.try_divide(F.col("target_share"), shares), F.lit(0.0)) * size)
    most = F.col("available") * F.col("max_repeats")
    out = joined.withColumn("asked", asked).withColumn("budget", F.least(asked, most))
    if refill:
        # Sources fill up in the order of most / share. The level at which the rest share what is left is the first that
        # the next source can hold.
        out = out.withColumn("_full", F.coalesce(F.try_divide(most.cast("double"), F.col("target_share")), F.lit(0.0)))
        order = W.orderBy("_full", "source")
        given = F.coalesce(F.sum(F.when(F.col("target_share") > 0, most)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        waiting = F.sum("target_share").over(order.rowsBetween(0, W.unboundedFollowing))
        out = out.withColumn("_level", F.try_divide(size - given, waiting))
        level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(everything)["_level"]
        out = out.withColumn("budget", F.least(most, F.coalesce(F.floor(F.col("target_share") * level + 1e-6), most)))
        out = out.withColumn("budget", F.when(F.col("target_share") > 0, F.col("budget")).otherwise(F.lit(0))).drop("_full", "_level")
    out = out.withColumn("passes", F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("available"))), F.lit(0)))
    return out.withColumn("rest", F.col("budget") - F.col("passes") * F.col("available"))


def thresholds(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, limit): documents of placed (source, place, tokens) with place < limit fit the rest of the budget.

    The first document that does not fit is not used, so the tokens drawn miss the budget by less than one document (or
    by those that share one 60-bit place). Each level reads sums of at most 2^BITS buckets per source.
    """
    state = plan.filter("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            state = materialized(state, f"level{level}")
        inside = placed.join(F.broadcast(state), "source")  # one row per target source
        if level:
            inside = inside.filter(F.shiftright("place", shift + BITS) == F.col("prefix"))
        if level == 1:
            # Only the boundary bucket is refined, so further levels read nothing else.
            placed = materialized(inside.select("source", "place", "tokens"), "boundary")
            inside = placed.join(F.broadcast(state), "source")
        bucket = F.shiftright("place", shift).alias("bucket")
        sums = inside.groupBy("source", "prefix", "left", bucket).agg(F.sum("tokens").alias("t"))
        upto = F.sum("t").over(W.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
        edge = sums.groupBy("source", "prefix", "left").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("below"))).alias("e"))
        state = edge.select("source", (F.col("left") - F.col("e.below")).alias("left"), F.col("e.bucket").alias("prefix"))
    return state.select("source", F.col("prefix").alias("limit"))


def draw(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, refill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of sized documents (doc_id, source, tokens) drawn towards targets.

    uses: doc_id, source, tokens, uses for every document; documents without a source or of a source that is not in
    targets are used 0 times. refill as in budgets(). shares: per target source what was asked, drawn and reached, with capped set where the
    repeats did not allow the target; a source without documents has drawn 0.
    """
    plan = materialized(budgets(sized, targets, total_tokens, refill), "plan")
    placed = sized.withColumn("place", _place(F.col("doc_id")))
    limits = materialized(thresholds(placed, plan), "limits")
    rules = plan.filter("documents > 0").select("source", "passes", "rest").join(limits, "source", "left")
    once = (F.col("rest") > 0) & (F.col("place") < F.col("limit"))
    uses = placed.join(F.broadcast(rules), "source", "left")
    uses = uses.select("doc_id", "source", "tokens", F.coalesce(F.col("passes") + F.coalesce(once, F.lit(False)).cast("long"), F.lit(0)).alias("uses"))
    drawn = uses.filter("uses > 0").groupBy("source").agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("drawn"), F.count("*").alias("used_documents"), F.max("uses").alias("most_uses")
    )
    shares = plan.join(drawn, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("drawn", "used_documents", "most_uses")})
    total = F.sum("drawn").over(W.partitionBy())
    return uses, shares.select(
        "source", "target_share", "max_repeats", "documents", "available", "asked", "drawn", "used_documents", "most_uses",
        F.coalesce(F.try_divide(F.col("drawn"), total), F.lit(0.0)).alias("actual_share"), (F.col("asked") > F.col("budget")).alias("capped"),
    )
