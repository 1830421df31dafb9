"""Problem 4: splits that keep related records together.

Related rows form connected components over their sources. Components are found by random-mate contraction: in each round
every vertex draws a coin; a vertex that drew heads and has a neighbour that drew tails is collapsed into the least such
neighbour, edges are rewritten, and loops and repeats vanish. When no edge is left, each vertex has moved at most once, and
the moves are unwound: a pass lets every vertex follow the move of the vertex it has come to, so k passes reach over 2^k
rounds. Edges that fit one task, at the start or after some rounds, are settled by one union-find. A round is a handful of joins and aggregations on keys; nothing about vertices or edges reaches the driver but
whether edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.functions.unicode import nfc_strip
from inkgauge.session import materialized, plan_bytes

#: No hash but a mark that older rows carry instead of one (a fixed value of the data).
NO_FINGERPRINT = "legacy-id-fallback"
#: Stored bytes of edges up to which one task finds the components of what is left.
FEW_BYTES = 4 << 20
#: Cells of the hash in which components of one size class are summed up before the running total.
CELLS = 1024


def source_key(domain: Column, source_id: Column) -> Column:
    """domain:id of a source, domain trimmed and in lower case, id in NFC and trimmed; null if the id is missing or empty."""
    ident = nfc_strip(source_id)
    return F.when(ident != "", F.concat(F.lower(nfc_strip(F.coalesce(domain, F.lit("")))), F.lit(":"), ident))


def fingerprint_key(fingerprint: Column) -> Column:
    """Lower-case hash; null for null, an empty text and the mark of rows without one."""
    clean = F.lower(F.trim(fingerprint))
    return F.when((clean != "") & (clean != NO_FINGERPRINT), clean)


def _coin(vertex: Column, round_no: int) -> Column:
    return F.pmod(F.xxhash64(vertex, F.lit(round_no)), F.lit(2)) == 1


def contract(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(vertex, root) of every vertex of edges (a, b); vertices of one component share one root.

    edges may hold loops, repeats, either direction and nulls (ignored). Each round collapses, for each edge that is left,
    one end into the other with probability at least 1/2 if it is isolated and at least 1/4 per vertex otherwise, so the
    number of rounds grows with the logarithm of the edges; max_rounds is a guard that raises, not a cap.
    """
    a, b = F.col("a"), F.col("b")
    live = edges.filter(a < b).select("a", "b").unionByName(edges.filter(a > b).select(b.alias("a"), a.alias("b")))
    live = materialized(live.distinct(), "edges")
    if live.isEmpty():
        return live.select(a.alias("vertex"), b.alias("root"))
    moves: list[DataFrame] = []
    while not live.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError("contraction did not end")
        if plan_bytes(live) <= FEW_BYTES:
            ends = T.StructType([T.StructField(x, live.schema["a"].dataType) for x in ("child", "parent")])
            moves.append(live.coalesce(1).mapInPandas(_forest, ends))
            break
        mates = _mates(live, len(moves))
        moves.append(mates)
        to_a, to_b = (mates.select(F.col("child").alias(x), F.col("parent").alias(f"{x}_to")) for x in ("a", "b"))
        moved = live.join(to_a, "a", "left").join(to_b, "b", "left")
        moved = moved.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).filter("a <> b")
        live = materialized(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # The edges of each round are written and coins are hashes, so moves are the same when they are taken again.
    found = materialized(reduce(DataFrame.unionByName, moves).select(F.col("child").alias("vertex"), F.col("parent").alias("root")), "moves")
    reach = 1
    while reach < len(moves):
        later = found.select(F.col("vertex").alias("root"), F.col("root").alias("_end"))
        found = materialized(found.join(later, "root", "left").select("vertex", F.coalesce("_end", "root").alias("root")), "roots")
        reach *= 2
    return found.unionByName(found.select(F.col("root").alias("vertex"), "root").distinct())


def _mates(live: DataFrame, round_no: int) -> DataFrame:
    """(child, parent): the vertices of live (a, b) that drew heads and their least neighbour that drew tails."""
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    heads = _coin(F.col("a"), round_no) & ~_coin(F.col("b"), round_no)
    return both.filter(heads).groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent"))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(child, parent) of every vertex of the edges (a, b) but the roots, parent being the root of its component."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    moved = [(x, root(x)) for x in list(up)]
    yield pd.DataFrame([m for m in moved if m[0] != m[1]], columns=["child", "parent"])


def related(rows: DataFrame, key: str) -> DataFrame:
    """rows with source, fingerprint and the component: root, group_key, n_sources.

    rows needs key, source_cluster_domain, source_cluster_id and source_cluster_fingerprint; only these are carried on.
    Rows share a component if they share a source or a fingerprint, and so on through further rows. group_key is the least
    source of the component in code point order; a row with neither source nor fingerprint is a component of its own with
    a null group_key, and so is one whose fingerprint no row with a source has.
    """
    keyed = rows.select(
        key,
        source_key(F.col("source_cluster_domain"), F.col("source_cluster_id")).alias("source"),
        fingerprint_key(F.col("source_cluster_fingerprint")).alias("fingerprint"),
    )
    keyed = materialized(keyed, "keyed")
    # A fingerprint ties its sources to the least of them: a star, however many rows and sources share it.
    pairs = materialized(keyed.filter("source is not null").select("source", "fingerprint").distinct(), "pairs")
    stars = pairs.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("source").alias("hub"))
    stars = materialized(stars, "stars")
    edges = pairs.join(stars, "fingerprint").select(F.col("source").alias("a"), F.col("hub").alias("b"))
    roots = contract(edges.filter("a <> b"))
    sources = pairs.select("source").distinct().join(roots.withColumnRenamed("vertex", "source"), "source", "left")
    sources = sources.select("source", F.coalesce("root", "source").alias("root"))
    named = sources.groupBy("root").agg(F.min("source").alias("group_key"), F.count("*").alias("n_sources"))
    sources = materialized(sources.join(named, "root"), "sources")
    by_source = keyed.filter("source is not null").join(sources, "source", "left")
    hubs = stars.join(sources.withColumnRenamed("source", "hub"), "hub").drop("hub")
    rest = keyed.filter("source is null").join(hubs, "fingerprint", "left")
    alone = F.coalesce("root", F.concat(F.lit("\0"), F.coalesce(F.col("fingerprint"), F.col(key).cast("string"))))
    columns = [key, "source", "fingerprint", "root", "group_key", F.coalesce("n_sources", F.lit(0)).alias("n_sources")]
    return by_source.select(*columns).unionByName(rest.withColumn("root", alone).select(*columns))


def split_components(grouped: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, weight, split) of the components of related(), split by cumulative weight.

    Components stand in descending classes of size (powers of two) and, within a class, in hash order, so that small ones
    settle the borders. A component belongs to the split in whose stretch the middle of its weight falls; splits stand in
    descending order of their share. Shares are used in proportion; null or negative ones count as 0. The running total is
    taken over cells of the hash first and within a cell after, so no task orders all components.
    """
    weights = grouped.groupBy("root").agg(F.count("*").alias("weight"))
    weights = weights.withColumn("size", F.floor(F.log2(F.col("weight")))).withColumn("place", F.xxhash64("root"))
    weights = materialized(weights.withColumn("cell", F.pmod("place", F.lit(CELLS))), "weights")
    cells = weights.groupBy("size", "cell").agg(F.sum("weight").alias("_w"))  # at most 63 x CELLS rows
    order = W.orderBy(F.desc("size"), "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("size", "cell", F.coalesce(F.sum("_w").over(order), F.lit(0)).alias("_before"))
    within = W.partitionBy("size", "cell").orderBy("place", "root").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("weight").over(within), F.lit(0))
    total = weights.agg(F.sum("weight").alias("_total"))
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    ordered = W.orderBy(F.desc("share"), "split")
    stretch = targets.select("split", share.alias("share"))
    stretch = stretch.select(
        "split", F.sum("share").over(ordered).alias("_to"), F.sum("share").over(W.partitionBy()).alias("_all"), "share"
    ).filter("share > 0")
    stretch = stretch.select("split", ((F.col("_to") - F.col("share")) / F.col("_all")).alias("_from"), (F.col("_to") / F.col("_all")).alias("_to"))
    stretch = stretch.agg(F.array_sort(F.collect_list(F.struct("_to", "split"))).alias("_splits"))  # as many as splits
    placed = weights.join(F.broadcast(cells), ["size", "cell"]).withColumn("_before", before)
    placed = placed.join(F.broadcast(total)).join(F.broadcast(stretch))
    middle = (F.col("_before") + F.col("weight") / 2) / F.col("_total")
    first = F.filter("_splits", lambda s: s["_to"] >= middle - F.lit(1e-12))
    chosen = F.coalesce(F.get(first, F.lit(0)), F.element_at("_splits", -1))["split"]
    return placed.select("root", "weight", chosen.alias("split"))


def assign_splits(rows: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """(key, group_key, split) of every row; all rows of a component share the split."""
    grouped = materialized(related(rows, key), "grouped")
    return grouped.join(split_components(grouped, targets).select("root", "split"), "root").select(key, "group_key", "split")
