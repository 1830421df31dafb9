"""Statistics of paired and grouped values as aggregate expressions. What is undefined is null, never NaN."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.session import materialized


def pearson(x: str, y: str) -> Column:
    """Pearson's r; null for fewer than two pairs or a constant side."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(F.col(x) + F.col(y)) >= 2, r)


def alpha(x: str, y: str) -> Column:
    """Krippendorff's interval alpha of two raters without gaps, from sums; null for fewer than two units.

    Without any variation it is 1 if the raters agree and null otherwise.
    """
    n = F.count(F.lit(1)).cast("double")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    between = F.sum((a - b) * (a - b)) / n
    total = F.sum(a + b)
    spread = 2 * (2 * n * F.sum(a * a + b * b) - total * total) / (2 * n * (2 * n - 1))
    return F.when(n < 2, None).when(F.abs(spread) < 1e-12, F.when(between < 1e-12, 1.0)).otherwise(1 - between / spread)


def alpha_z(r: Column, n: Column, raters: int = 2) -> Column:
    """Alpha of z-scores, which follows from the (mean) correlation alone."""
    size = raters * n.cast("double")
    return F.when(n >= 2, 1 - (1 - r) * (size - 1) / size)


def midranks(df: DataFrame, keys: list[str], value: str, to: str, weight: str | None = None) -> DataFrame:
    """df with the average-tie rank of value within keys in column to; null values have no rank. A row counts weight times.

    Values are counted first. The running count is taken over ranges of values that a range partitioning cuts, so one
    large group is many tasks: ties settle within a value, values within a range, ranges by their sums.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    ranged = counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    ranged = materialized(ranged, "ranges")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    below = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_below"))
    within = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranks = ranged.join(sums, [*keys, "_part"])  # a row for each range and group
    last = F.col("_below") + F.sum("_n").over(within)
    ranks = ranks.select(*keys, value, (last - (F.col("_n") - 1) / 2.0).alias(to))
    return df.join(ranks, [*keys, value], "left")


def places(df: DataFrame, keys: list[str], order: list[Column], to: str) -> DataFrame:
    """df with the place of each row, from 1, within keys in order; order must leave no ties.

    Rows are cut into ranges of keys and order; places are counted within a range and ranges by their sizes, so a large
    group is many tasks.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    ranged = materialized(ranged, "places")
    sums = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_s"))
    below = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_below"))
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    same = ranged["_part"] == sums["_p"]
    for i, k in enumerate(keys):
        same = same & ranged[k].eqNullSafe(sums[f"_k{i}"])
    out = ranged.withColumn("_own", own).join(sums, same)
    return out.withColumn(to, F.col("_own") + F.col("_below")).drop("_own", "_part", "_p", "_below", *[f"_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys and, for each name of wanted, the exact quantile of value by linear interpolation; a row counts weight times.

    Values are counted first and the running count is taken over ranges of values, as in midranks(): no task holds all
    values of a group. Null values, and weights that are not positive, do not count.
    """
    rows = df.filter(F.col(value).isNotNull())
    rows = rows.filter(F.col(weight) > 0) if weight else rows
    counts = rows.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    ranged = materialized(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "quantiles")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    every = W.partitionBy(*keys)
    sums = sums.withColumn("_below", F.coalesce(F.sum("_s").over(every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("_all", F.sum("_s").over(every)).drop("_s")
    names = [f"_k{i}" for i in range(len(keys))]
    sums = sums.withColumnsRenamed(dict(zip(keys, names))).withColumnRenamed("_part", "_p")
    same = ranged["_part"] == sums["_p"]
    for name, k in zip(names, keys):
        same = same & ranged[k].eqNullSafe(sums[name])
    upto = F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = ranged.withColumn("_own", upto).join(sums, same).withColumn("_upto", F.col("_own") + F.col("_below"))
    found = []
    for name, q in wanted.items():
        at = (F.col("_all") - 1) * q
        low, high = (F.min(F.when(F.col("_upto") > f(at), F.col(value))) for f in (F.floor, F.ceil))
        found.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(*found)


def summary(value: str) -> list[Column]:
    """n, mean, sd (ddof 1), min, max."""
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float] | None = None) -> DataFrame:
    """keys, n, mean, sd (ddof 0), min, quantiles by linear interpolation, by default quartiles, and max."""
    moments = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")]
    found = df.groupBy(*keys).agg(*moments)
    wanted = QUARTILES if wanted is None else wanted
    q = quantiles(df, keys, value, wanted).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & found[k].eqNullSafe(q[f"_{k}"])
    return found.join(q, same, "left").select(*keys, "n", "mean", "sd", "min", *wanted, "max")


def alpha_of(m: int, sum_: Column, squares: Column) -> Column:
    """Krippendorff's interval alpha of units with m ratings each, none missing, from each unit's sum and sum of squares.

    Null for no unit, and without variation.
    """
    n = F.count(F.lit(1)).cast("double") * m
    within = 2 * F.sum(m * squares - sum_ * sum_) / ((m - 1) * n)
    total = 2 * (n * F.sum(squares) - F.sum(sum_) * F.sum(sum_)) / (n * (n - 1))
    return F.when(F.abs(total) > 1e-12, 1 - within / total)


def phi(alone: Column, given: Column) -> Column:
    """White-box share of a text's mean negative log-likelihood that its prompt explains; 0 where it has none alone."""
    return F.when(alone > 0, (alone - given) / alone).when(alone.isNotNull(), F.lit(0.0))


def tau_b(pairs: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of x and y per keys, from all pairs of the few rows of a group (levels of one item)."""
    left = pairs.select(*keys, F.col(order).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    right = pairs.select(*keys, F.col(order).alias("_j"), F.col(x).alias("_u"), F.col(y).alias("_v"))
    both = left.join(right, keys).filter("_i < _j")
    a, b = F.signum(F.col("_x") - F.col("_u")), F.signum(F.col("_y") - F.col("_v"))
    sums = both.groupBy(*keys).agg(F.sum(a * b).alias("s"), F.sum(a * a).alias("p"), F.sum(b * b).alias("q"))
    return sums.select(*keys, F.try_divide(F.col("s"), F.sqrt(F.col("p") * F.col("q"))).alias("tau"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or 1e-300)
            c = 1.0 + term / c or 1e-300
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(n) or n < 1 else incomplete_beta(n / 2, 0.5, n / (n + a * a)) for a, n in zip(t, df)], dtype="Float64")


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)) for v in z], dtype="Float64")


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal value; null for null."""
    return _normal_p(z.cast("double"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null where t is null or df is below 1."""
    return _student_p(t, df.cast("double"))
