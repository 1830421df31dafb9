"""Cohorts by hash rank, strata by score, and digests of rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions import stats


def hash_top(df: DataFrame, keys: list[str], member: str, n: int, seed: str, place: str) -> DataFrame:
    """The n members of each group that a seeded SHA-256 ranks first, with their place from 1.

    The same rows are chosen in any order of the input. Spark keeps only n rows of each partition before the shuffle.
    """
    rank = F.sha2(F.concat_ws("\0", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(member).cast("string")), 256)
    order = W.partitionBy(*keys).orderBy(rank, member)
    return df.withColumn(place, F.row_number().over(order).cast("long")).filter(F.col(place) <= n)


def stratify(df: DataFrame, cell: list[str], score: str, ties: list[str], strata: int = 5) -> DataFrame:
    """df with stratum: equal parts of each cell by descending score; what does not divide goes to the last.

    A cell with fewer rows than strata lies in the last one. Ties follow the columns ties.
    """
    placed = stats.places(df, cell, [F.desc(score), *[F.col(t) for t in ties]], "_place")
    sizes = df.groupBy(*cell).agg(F.floor(F.count("*") / strata).alias("_size"))
    sizes = sizes.withColumnsRenamed({c: f"_{c}" for c in cell})
    same = F.lit(True)
    for c in cell:
        same = same & placed[c].eqNullSafe(sizes[f"_{c}"])
    at = F.floor(F.try_divide(F.col("_place") - 1, F.col("_size")))
    out = placed.join(sizes, same).withColumn("stratum", (F.least(F.coalesce(at, F.lit(strata - 1)), F.lit(strata - 1)) + 1).cast("int"))
    return out.drop("_place", "_size", *[f"_{c}" for c in cell])


def roster_digest(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """SHA-256 over the different members of each group in any order: of the sums, by lane, of their hashes.

    Each member's SHA-256 is cut into eight lanes of 32 bits, the lanes are added up as whole numbers, and the count and the
    sums are hashed. Sums need no list and no order, so a group of any size is aggregated before it is shuffled.
    """
    hashed = df.select(*keys, F.sha2(F.col(member).cast("string"), 256).alias("_h")).distinct()
    lanes = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"_l{i}") for i in range(8)]
    sums = hashed.groupBy(*keys).agg(F.count("*").cast("string").alias("_n"), *lanes)
    return sums.select(*keys, F.sha2(F.concat_ws(":", "_n", *[f"_l{i}" for i in range(8)]), 256).alias("digest"))
