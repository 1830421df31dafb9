"""Cluster bootstrap. Replicates are tables of multiplicities, never copies of the rows.

The multiplicity of a cluster in a replicate is Poisson(1) from a hash of both, which stands for drawing as many clusters as
there are with replacement: no list of clusters, no state and no order is needed, and every statistic of one replicate sees
the same draw. Replicate POINT has each cluster once; its statistics are the point estimates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import stats
from inkgauge.session import materialized

#: Seed of all draws (a fixed value of the measure), and the replicate that is the sample itself.
SEED, POINT = 20260823, -1
#: Bits of the hash that make a draw.
BITS = 52
#: Share of the replicates in which a statistic must be defined for its interval to stand.
SUPPORT = 0.99


def _thresholds() -> list[float]:
    """Cumulative probabilities of Poisson(1) as far as BITS can tell them from 1."""
    out, total, term, k = [], 0.0, math.exp(-1.0), 0
    while total + term < 1.0 - 2.0**-BITS and k < 64:
        total, k = total + term, k + 1
        out.append(total)
        term /= k
    return out


THRESHOLDS = _thresholds()


def poisson_weight(replicate: Column, cluster: Column, seed: int = SEED) -> Column:
    """Multiplicity of a cluster in a replicate, 1 in replicate POINT."""
    text = F.concat_ws("\0", F.lit(str(seed)), replicate.cast("string"), cluster)
    u = F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))
    # A lambda's variable is computed once, however many thresholds ask for it.
    weight = F.transform(F.array(u), lambda x: _steps(x))[0]
    return F.when(replicate == POINT, 1).otherwise(weight)


def _steps(u: Column) -> Column:
    out = F.when(u < THRESHOLDS[0], 0)
    for k, t in enumerate(THRESHOLDS[1:], 1):
        out = out.when(u < t, k)
    return out.otherwise(len(THRESHOLDS))


def weight_sql(replicate: str, cluster: str, seed: int = SEED) -> str:
    """poisson_weight() in SQL."""
    u = f"(CAST('0x' || substr(sha256('{seed}' || chr(0) || CAST({replicate} AS VARCHAR) || chr(0) || {cluster}), 1, {BITS // 4}) AS BIGINT) / CAST({1 << BITS} AS DOUBLE))"
    return f"CASE WHEN {replicate} = {POINT} THEN 1 ELSE len(list_filter(CAST({THRESHOLDS} AS DOUBLE[]), lambda t: {u} >= t)) END"


def replicated(clusters: DataFrame, cluster: str, replicates: int, seed: int = SEED) -> DataFrame:
    """clusters for every replicate and POINT, with rep and w; rows of multiplicity 0 are left out. A null cluster is one.

    clusters has few rows for each cluster, as sums by level or rater are: they are taken together, so that a draw is made
    once for all of them.
    """
    rest = [c for c in clusters.columns if c != cluster]
    sets = clusters.groupBy(cluster).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    draws = sets.withColumn("rep", F.explode(F.sequence(F.lit(POINT), F.lit(replicates - 1))))
    draws = draws.withColumn("w", poisson_weight(F.col("rep"), F.coalesce(F.col(cluster).cast("string"), F.lit("")), seed)).filter("w > 0")
    return draws.select(cluster, "rep", "w", F.inline("_rows"))


def replicated_rows(rows: DataFrame, cluster: str, replicates: int, seed: int = SEED) -> DataFrame:
    """replicated() for rows as they are, of which one cluster may have any number."""
    out = rows.withColumn("rep", F.explode(F.sequence(F.lit(POINT), F.lit(replicates - 1))))
    return out.withColumn("w", poisson_weight(F.col("rep"), F.coalesce(F.col(cluster).cast("string"), F.lit("")), seed)).filter("w > 0")


def intervals(values: DataFrame, keys: list[str], value: str, replicates: int) -> DataFrame:
    """keys, point, low, high, valid: the 2.5 and 97.5 % points of value over the replicates in which it is defined.

    values: keys, rep, value. Without SUPPORT of the replicates low and high are null.
    """
    drawn = F.when(F.col("rep") != POINT, F.col(value))
    found = values.groupBy(*keys).agg(
        F.max(F.when(F.col("rep") == POINT, F.col(value))).alias("point"), F.percentile(drawn, [0.025, 0.975]).alias("_p"), F.count(drawn).alias("valid")
    )
    stands = F.col("valid") >= SUPPORT * replicates
    return found.select(*keys, "point", F.when(stands, F.col("_p")[0]).alias("low"), F.when(stands, F.col("_p")[1]).alias("high"), "valid")


def intervals_sql(source: str, keys: str, value: str, replicates: int) -> str:
    """intervals() in SQL, with doubles rounded to 6 digits."""
    drawn = f"CASE WHEN rep <> {POINT} THEN {value} END"
    stands = f"count({drawn}) >= {SUPPORT * replicates}"
    return f"""SELECT {keys}, round(max(CASE WHEN rep = {POINT} THEN {value} END), 6) AS point, round(CASE WHEN {stands} THEN quantile_cont({drawn}, 0.025) END, 6) AS low,
round(CASE WHEN {stands} THEN quantile_cont({drawn}, 0.975) END, 6) AS high, count({drawn}) AS valid FROM {source} GROUP BY {keys}"""


def additive(clusters: DataFrame, keys: list[str], cluster: str, total: str, count: str, replicates: int) -> DataFrame:
    """(keys, rep, mean) of sum(total) / sum(count) over redrawn clusters, from one row per key and cluster with its sums."""
    draws = replicated(clusters, cluster, replicates)
    return draws.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(total)), F.sum(F.col("w") * F.col(count))).alias("mean"))


#: Sums from which moments of two values follow.
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_sums(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and SUMS of x and y; rows with a null in either are left out."""
    a, b = F.col(x), F.col(y)
    parts = {"n": F.lit(1.0), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    return rows.dropna(subset=[x, y]).groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in parts.items()])


def weighted_sums(draws: DataFrame, keys: list[str], stratum: str | None = None) -> DataFrame:
    """keys, rep and SUMS of replicated pair_sums(). With a stratum each stratum is scaled to the size that it has in the sample."""
    if stratum is None:
        return draws.groupBy(*keys, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in SUMS])
    parts = draws.groupBy(*keys, stratum, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in SUMS])
    whole = parts.filter(F.col("rep") == POINT).select(*keys, stratum, F.col("n").alias("_all"))
    parts = parts.join(whole, [*keys, stratum])
    return parts.groupBy(*keys, "rep").agg(*[F.sum(F.col(c) * F.col("_all") / F.col("n")).alias(c) for c in SUMS])


def correlation() -> Column:
    """Pearson's r from SUMS; null for a constant side."""
    n, x, y, xx, yy, xy = (F.col(c) for c in SUMS)
    spread = (n * xx - x * x) * (n * yy - y * y)
    return F.when(spread > 1e-12, (n * xy - x * y) / F.sqrt(spread))


CORRELATION_SQL = "CASE WHEN (n * xx - x * x) * (n * yy - y * y) > 1e-12 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END"


def rank_correlations(rows: DataFrame, keys: list[str], cluster: str, x: str, y: str, replicates: int) -> DataFrame:
    """(keys, rep, rho): Spearman's rho of x and y with clusters redrawn, at any size.

    A row that counts w times holds w ranks; the weighted midranks come from counted ranges of values (stats.midranks), so
    neither a replicate nor a group is one task and nothing is kept on the driver.
    """
    draws = replicated_rows(rows.select(*keys, cluster, x, y).dropna(subset=[x, y]), cluster, replicates)
    # Written, as each ranking reads its rows three times: to count, to cut ranges and to join.
    draws = materialized(draws.groupBy(*keys, "rep", x, y).agg(F.sum("w").alias("w")), "draws")
    ranked = materialized(stats.midranks(draws, [*keys, "rep"], x, "_rx", "w"), "ranked")
    ranked = stats.midranks(ranked, [*keys, "rep"], y, "_ry", "w")
    w, a, b = F.col("w"), F.col("_rx"), F.col("_ry")
    parts = {"n": w.cast("double"), "x": w * a, "y": w * b, "xx": w * a * a, "yy": w * b * b, "xy": w * a * b}
    sums = ranked.groupBy(*keys, "rep").agg(*[F.sum(c).alias(name) for name, c in parts.items()])
    return sums.select(*keys, "rep", correlation().alias("rho"))
