"""Grouped folds and cross-validated ridge regression from sufficient statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHAS = tuple(10.0**k for k in range(-6, 7))
FOLDS = 5
#: Cells of the hash in which clusters of one size class are counted before the running count.
CELLS = 1024


def with_folds(df: DataFrame, domain: str, cluster: str, seed: int, to: str, n_folds: int = FOLDS) -> DataFrame:
    """df with the fold of its cluster in column to: all rows of a cluster share it, and it does not depend on any order.

    The clusters of a domain stand in descending classes of size (powers of two) and, within a class, in hash order, and are
    dealt to the folds in turn, so folds differ by about one cluster of each class. The place of a cluster is counted over
    cells of the hash first and within a cell after: no task orders all clusters and none reach the driver.
    """
    sizes = df.groupBy(domain, cluster).agg(F.count("*").alias("_n")).withColumn("_class", F.floor(F.log2("_n")))
    sizes = sizes.withColumn("_place", F.xxhash64(F.lit(seed), domain, cluster)).withColumn("_cell", F.pmod("_place", F.lit(CELLS)))
    cells = sizes.groupBy(domain, "_class", "_cell").agg(F.count("*").alias("_c"))  # at most 63 x CELLS rows of a domain
    before = F.coalesce(F.sum("_c").over(W.partitionBy(domain).orderBy(F.desc("_class"), "_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(domain).alias("_d"), F.col("_class").alias("_k"), F.col("_cell").alias("_m"), before.alias("_before"))
    same = sizes[domain].eqNullSafe(cells["_d"]) & (sizes["_class"] == cells["_k"]) & (sizes["_cell"] == cells["_m"])
    within = F.row_number().over(W.partitionBy(domain, "_class", "_cell").orderBy("_place", cluster)) - 1
    start = F.pmod(F.xxhash64(F.lit(seed), domain), F.lit(n_folds))
    dealt = sizes.join(cells, same).select(F.col(domain).alias("_d"), F.col(cluster).alias("_c"), F.pmod(F.col("_before") + within + start, F.lit(n_folds)).cast("int").alias(to))
    return df.join(dealt, df[domain].eqNullSafe(dealt["_d"]) & df[cluster].eqNullSafe(dealt["_c"])).drop("_d", "_c")


def moments(df: DataFrame, folds: list[str], columns: list[str]) -> dict[tuple, np.ndarray]:
    """Per combination of folds the matrix of sums of products of (1, columns): one pass, small results."""
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    found = df.groupBy(*folds).agg(*[F.sum(values[i] * values[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # a row per fold
    out = {}
    for r in found:
        m = np.zeros((len(values), len(values)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[tuple(r[f] for f in folds)] = m
    return out


def ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients of ridge regression on predictors standardized by their population deviation."""
    n, p = m[0, 0], len(m) - 2
    if n == 0:
        return np.zeros(p + 1)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p] / n, 0))
    sd[sd < 1e-12] = 1.0
    gram, target = cov[:p, :p] / np.outer(sd, sd), cov[:p, p] / sd
    u, s, vt = np.linalg.svd(gram, hermitian=True)
    beta = (vt.T * (1 / (s + alpha))) @ (u.T @ target) / sd
    return np.concatenate([[mean[p] - beta @ mean[:p]], beta])


def squared_error(m: np.ndarray, beta: np.ndarray) -> float:
    """Sum of squared errors of a linear model, from the sums of products alone."""
    w = np.concatenate([beta, [-1.0]])
    return float(w @ m @ w)


def best_alpha(inner: dict[int, np.ndarray]) -> float:
    """The largest alpha whose pooled error over inner folds is least, up to rounding."""
    total = sum(inner.values())
    errors = {a: sum(squared_error(m, ridge(total - m, a)) for m in inner.values()) / max(1.0, total[0, 0]) for a in ALPHAS}
    least = min(errors.values())
    return max(a for a, e in errors.items() if e <= least + 1e-12 + 1e-10 * abs(least))


def predictions(sums: dict[tuple, np.ndarray], columns: list[str], outer: str, xs: list[str], y: str) -> tuple[Column, dict[int, float]]:
    """Prediction of y by a ridge model that never saw its outer fold, and the alpha of each outer fold.

    sums are moments() of columns, among them xs and y, by outer and inner fold: every model of every fold, alpha, set of
    predictors and target is solved from one aggregation.
    """
    at = [0, *[1 + columns.index(c) for c in (*xs, y)]]
    sums = {k: m[np.ix_(at, at)] for k, m in sums.items()}
    prediction: Column = F.lit(None).cast("double")
    alphas: dict[int, float] = {}
    for fold in sorted({o for o, _ in sums}):
        parts: dict[int, np.ndarray] = {}
        for (o, i), m in sums.items():
            if o != fold:
                parts[i] = parts.get(i, 0) + m
        if not parts:
            continue
        alphas[fold] = best_alpha(parts)
        beta = ridge(sum(parts.values()), alphas[fold])
        linear = F.lit(float(beta[0]))
        for b, x in zip(beta[1:], xs):
            linear = linear + F.lit(float(b)) * F.col(x)
        prediction = F.when(F.col(outer) == fold, linear).otherwise(prediction)
    return prediction, alphas


def out_of_fold(df: DataFrame, outer: str, inner: str, xs: list[str], y: str) -> tuple[DataFrame, dict[int, float]]:
    """df with prediction of predictions()."""
    columns = [*xs, y]
    prediction, alphas = predictions(moments(df.dropna(subset=columns), [outer, inner], columns), columns, outer, xs, y)
    return df.withColumn("prediction", prediction), alphas
