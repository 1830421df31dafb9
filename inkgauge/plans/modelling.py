"""Resampling (B) and cross-validated models (M), folds (C08), predictors (F08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions import stats
from inkgauge.operators import models, resample
from inkgauge.plans.base import PAIRED, Register, paired, rounded
from inkgauge.session import materialized
from inkgauge.sources.tables import table

query = Register()
#: Draws of statistics that follow from sums, and of rank statistics, whose rows are replicated.
REPLICATES, RANK_REPLICATES = 2000, 200

_REPS = f"reps AS (SELECT CAST(r AS BIGINT) AS rep FROM range({resample.POINT}, {{0}}) AS t(r))"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "level", "source_cluster_id", "actual_ratio").dropna()
    return rows.groupBy("level", F.trim("source_cluster_id").alias("cluster")).agg(F.sum("actual_ratio").alias("total"), F.count("*").alias("n"))


def _level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statistic, level, rep, value): means of the levels, and what each has over the next."""
    means = resample.additive(_clusters(spark, sf_dir), ["level"], "cluster", "total", "n", REPLICATES)
    after = F.lead("mean").over(W.partitionBy("rep").orderBy("level"))  # five rows
    both = F.array(F.struct(F.lit("mean").alias("statistic"), F.col("mean").alias("value")), F.struct(F.lit("delta").alias("statistic"), (F.col("mean") - F.col("after")).alias("value")))
    return means.withColumn("after", after).select("level", "rep", F.inline(both)).filter("value is not null")


_LEVEL_MEANS = f"""WITH {_REPS.format(REPLICATES)}, c AS (SELECT level, trim(source_cluster_id) AS cluster, sum(actual_ratio) AS total, count(*) AS n FROM level_results
  WHERE level IS NOT NULL AND source_cluster_id IS NOT NULL AND actual_ratio IS NOT NULL GROUP BY 1, 2),
k AS (SELECT DISTINCT cluster FROM c), d AS (SELECT cluster, rep, {resample.weight_sql('rep', 'cluster')} AS w FROM k, reps),
m AS (SELECT level, rep, sum(w * total) / nullif(sum(w * n), 0) AS mean FROM c JOIN d ON c.cluster = d.cluster WHERE w > 0 GROUP BY 1, 2),
s AS (SELECT 'mean' AS statistic, level, rep, mean AS value FROM m UNION ALL SELECT 'delta', level, rep, mean - lead(mean) OVER (PARTITION BY rep ORDER BY level) FROM m),
v AS (SELECT * FROM s WHERE value IS NOT NULL)"""


@query(f"{_LEVEL_MEANS} {resample.intervals_sql('v', 'statistic, level', 'value', REPLICATES)}")
def B06_level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.intervals(_level_means(spark, sf_dir), ["statistic", "level"], "value", REPLICATES))


@query(f"""{_LEVEL_MEANS}, i AS ({resample.intervals_sql('v', 'statistic, level', 'value', REPLICATES)})
SELECT statistic, level, low, high, CASE WHEN low > 0 THEN 'positive' WHEN high < 0 THEN 'negative' WHEN low IS NOT NULL THEN 'open' END AS sign FROM i WHERE statistic = 'delta'""")
def A36_interval_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a level has over the next is surely positive, surely negative or open; null without enough replicates."""
    out = rounded(B06_level_means(spark, sf_dir)).filter("statistic = 'delta'")
    sign = F.when(F.col("low") > 0, "positive").when(F.col("high") < 0, "negative").when(F.col("low").isNotNull(), "open")
    return out.select("statistic", "level", "low", "high", sign.alias("sign"))


@query(f"""WITH {PAIRED}, {_REPS.format(RANK_REPLICATES)}, k AS (SELECT DISTINCT id FROM paired), d AS (SELECT id, rep, {resample.weight_sql('rep', 'id')} AS w FROM k, reps),
x AS (SELECT p.evaluator, d.rep, p.phi, p.act, CAST(sum(d.w) AS DOUBLE) AS w FROM paired p JOIN d ON p.id = d.id WHERE d.w > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT *, sum(w) OVER (PARTITION BY evaluator, rep ORDER BY phi) - (sum(w) OVER (PARTITION BY evaluator, rep, phi) - 1) / 2 AS a,
  sum(w) OVER (PARTITION BY evaluator, rep ORDER BY act) - (sum(w) OVER (PARTITION BY evaluator, rep, act) - 1) / 2 AS b FROM x),
s AS (SELECT evaluator, rep, sum(w) AS n, sum(w * a) AS x, sum(w * b) AS y, sum(w * a * a) AS xx, sum(w * b * b) AS yy, sum(w * a * b) AS xy FROM r GROUP BY 1, 2),
v AS (SELECT evaluator, rep, {resample.CORRELATION_SQL} AS rho FROM s) {resample.intervals_sql('v', 'evaluator', 'rho', RANK_REPLICATES)}""")
def B02_rank_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho of both scores per evaluator with items redrawn."""
    values = resample.rank_correlations(paired(spark, sf_dir), ["evaluator"], "id", "phi", "act", RANK_REPLICATES)
    return rounded(resample.intervals(values, ["evaluator"], "rho", RANK_REPLICATES))


def _draws(spark: SparkSession, sf_dir: str, stratum: str | None, replicates: int) -> DataFrame:
    """(evaluator, rep, SUMS) of both scores with items redrawn; one item has one draw for all evaluators and models."""
    keys = ["evaluator", "id", *([stratum] if stratum else [])]
    sums = resample.pair_sums(paired(spark, sf_dir), keys, "phi", "act")
    draws = resample.replicated(sums, "id", replicates)
    return resample.weighted_sums(draws, ["evaluator"], stratum)


_ITEM_SUMS = "c AS (SELECT evaluator, domain, id, CAST(count(*) AS DOUBLE) AS n, sum(phi) AS x, sum(act) AS y, sum(phi * phi) AS xx, sum(act * act) AS yy, sum(phi * act) AS xy FROM paired GROUP BY 1, 2, 3)"
_DRAWN = f"""WITH {PAIRED}, {_REPS.format(REPLICATES)}, {_ITEM_SUMS}, k AS (SELECT DISTINCT id FROM c), d AS (SELECT id, rep, {resample.weight_sql('rep', 'id')} AS w FROM k, reps)"""
_SUMMED = ", ".join(f"sum(w * {c}) AS {c}" for c in resample.SUMS)

#: Statistics of both scores from their sums, with the SQL of each.
_STATISTICS = {
    "r": resample.CORRELATION_SQL,
    "alpha": "CASE WHEN 2 * (2 * n * (xx + yy) - (x + y) * (x + y)) > 1e-12 THEN 1 - ((xx + yy - 2 * xy) / n) / (2 * (2 * n * (xx + yy) - (x + y) * (x + y)) / (2 * n * (2 * n - 1))) END",
    "mean_phi": "x / n",
    "mean_act": "y / n",
    "bias": "(y - x) / n",
    "rmse": "sqrt(greatest((xx + yy - 2 * xy) / n, 0))",
    "sd_phi": "sqrt(greatest(xx / n - (x / n) * (x / n), 0))",
    "sd_act": "sqrt(greatest(yy / n - (y / n) * (y / n), 0))",
    "slope": "CASE WHEN n * xx - x * x > 1e-12 THEN (n * xy - x * y) / (n * xx - x * x) END",
    "intercept": "CASE WHEN n * xx - x * x > 1e-12 THEN (y - (n * xy - x * y) / (n * xx - x * x) * x) / n END",
    "r2": "CASE WHEN (n * xx - x * x) * (n * yy - y * y) > 1e-12 THEN (n * xy - x * y) * (n * xy - x * y) / ((n * xx - x * x) * (n * yy - y * y)) END",
    "concordance": "CASE WHEN xx + yy > 1e-12 THEN 2 * (xy / n - x / n * y / n) / nullif(xx / n - (x / n) * (x / n) + yy / n - (y / n) * (y / n) + (x / n - y / n) * (x / n - y / n), 0) END",
}


@query(f"""{_DRAWN}, s AS (SELECT evaluator, rep, {_SUMMED} FROM c JOIN d ON c.id = d.id WHERE w > 0 GROUP BY 1, 2),
v AS ({' UNION ALL '.join(f"SELECT evaluator, '{name}' AS statistic, rep, {sql} AS value FROM s" for name, sql in _STATISTICS.items())})
{resample.intervals_sql('v', 'evaluator, statistic', 'value', REPLICATES)}""")
def B01_twelve_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve statistics of both scores per evaluator, all on the same draws of items."""
    sums = _draws(spark, sf_dir, None, REPLICATES)
    long = F.array(*[F.struct(F.lit(name).alias("statistic"), F.expr(sql).cast("double").alias("value")) for name, sql in _STATISTICS.items()])
    values = sums.select("evaluator", "rep", F.inline(long))
    return rounded(resample.intervals(values, ["evaluator", "statistic"], "value", REPLICATES))


@query(f"""{_DRAWN}, s AS (SELECT evaluator, rep, {_SUMMED} FROM c JOIN d ON c.id = d.id WHERE w > 0 GROUP BY 1, 2), r AS (SELECT evaluator, rep, n, {resample.CORRELATION_SQL} AS r FROM s),
v AS (SELECT a.evaluator AS first, b.evaluator AS second, a.rep, a.r - b.r AS value FROM r a JOIN r b ON a.rep = b.rep AND a.evaluator < b.evaluator) {resample.intervals_sql('v', 'first, second', 'value', REPLICATES)}""")
def B03_paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one evaluator's correlation has over another's, on the same draws; valid counts the draws in which both exist."""
    r = materialized(_draws(spark, sf_dir, None, REPLICATES).select("evaluator", "rep", resample.correlation().alias("r")), "correlations")
    other = r.select(F.col("evaluator").alias("second"), "rep", F.col("r").alias("r2"))
    pairs = r.join(other, "rep").filter("evaluator < second").select(F.col("evaluator").alias("first"), "second", "rep", F.expr("r - r2").alias("value"))
    return rounded(resample.intervals(pairs, ["first", "second"], "value", REPLICATES))


_STRATIFIED = f"""t AS (SELECT evaluator, domain, rep, {_SUMMED} FROM c JOIN d ON c.id = d.id WHERE w > 0 AND domain IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT t.evaluator, t.domain, t.rep, {', '.join(f't.{c} * o.n / t.n AS {c}' for c in resample.SUMS)} FROM t JOIN t o ON o.evaluator = t.evaluator AND o.domain = t.domain AND o.rep = {resample.POINT}),
s AS (SELECT evaluator, rep, {', '.join(f'sum({c}) AS {c}' for c in resample.SUMS)} FROM u GROUP BY 1, 2), v AS (SELECT evaluator, rep, {resample.CORRELATION_SQL} AS r FROM s)"""


@query(f"{_DRAWN}, {_STRATIFIED} {resample.intervals_sql('v', 'evaluator', 'r', REPLICATES)}")
def B04_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of both scores with items redrawn within domains, which keep their sizes."""
    values = _draws(spark, sf_dir, "domain", REPLICATES).select("evaluator", "rep", resample.correlation().alias("r"))
    return rounded(resample.intervals(values, ["evaluator"], "r", REPLICATES))


@query(f"""{_DRAWN}, t AS (SELECT evaluator, domain, rep, {_SUMMED} FROM c JOIN d ON c.id = d.id WHERE w > 0 AND domain IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT evaluator, domain, rep, {resample.CORRELATION_SQL} AS r FROM t) {resample.intervals_sql('v', 'evaluator, domain', 'r', REPLICATES)}""")
def B05_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of both scores in each domain; the replicates are written, so a lost executor repeats only its part."""
    sums = resample.pair_sums(paired(spark, sf_dir).filter("domain is not null"), ["evaluator", "domain", "id"], "phi", "act")
    drawn = materialized(resample.weighted_sums(resample.replicated(sums, "id", REPLICATES), ["evaluator", "domain"]), "replicates")
    values = drawn.select("evaluator", "domain", "rep", resample.correlation().alias("r"))
    return rounded(resample.intervals(values, ["evaluator", "domain"], "r", REPLICATES))


_MODEL = ("pair_id", "domain", "source_cluster_id", "level", "output_chars", "output_tokens", "actual_ratio")


@query("""SELECT pair_id, round(ln(1 + output_chars), 6) AS l_chars, round(ln(1 + output_tokens), 6) AS l_tokens, round(ln(1 + output_chars) * ln(1 + output_chars), 6) AS h_chars2,
round(ln(1 + output_tokens) * ln(1 + output_tokens), 6) AS h_tokens2, round(ln(1 + output_chars) * ln(1 + output_tokens), 6) AS h_cross, round(actual_ratio, 6) AS r, round(actual_ratio * output_chars, 6) AS g
FROM level_results WHERE output_chars IS NOT NULL AND output_tokens IS NOT NULL AND actual_ratio IS NOT NULL""")
def F08_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictor columns: l_ of the lengths alone, h_ their squares and product, r the ratio and g the gain."""
    return rounded(_predictors(spark, sf_dir).select("pair_id", *_SETS["full"], "r", "g"))


def _predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", *_MODEL).dropna()
    a, b = F.log1p("output_chars"), F.log1p("output_tokens")
    columns = {"l_chars": a, "l_tokens": b, "h_chars2": a * a, "h_tokens2": b * b, "h_cross": a * b, "r": F.col("actual_ratio"), "g": F.col("actual_ratio") * F.col("output_chars")}
    return rows.withColumns(columns | {"cluster": F.trim("source_cluster_id"), "lv": F.substring("level", 2, 1).cast("double")})


#: Sets of predictors: each length alone, both, and both with squares and product.
_SETS = {"chars": ["l_chars"], "tokens": ["l_tokens"], "both": ["l_chars", "l_tokens"], "full": ["l_chars", "l_tokens", "h_chars2", "h_tokens2", "h_cross"]}
_TARGETS = ("r", "g", "log_g", "r2", "lv")


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictors(spark, sf_dir).withColumns({"log_g": F.log1p(F.greatest("g", F.lit(0.0))), "r2": F.col("r") * F.col("r")})
    outer = models.with_folds(rows, "domain", "cluster", 20260823, "outer_fold")
    return materialized(models.with_folds(outer, "domain", "cluster", 20260824, "inner_fold"), "folds")


@query()
def C08_grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "domain", "source_cluster_id").dropna().select("domain", F.trim("source_cluster_id").alias("cluster"))
    return models.with_folds(rows, "domain", "cluster", 20260823, "fold").groupBy("domain", "cluster", "fold").agg(F.count("*").alias("n"))


_X = ["lv", *_SETS["full"]]


@query()
def M01_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = models.out_of_fold(_modelled(spark, sf_dir), "outer_fold", "inner_fold", _X, "r")
    return rounded(out.select("pair_id", "outer_fold", "actual_ratio", "prediction"))


@query()
def M03_predictive_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of prediction and ratio over all pairs, by level and by domain."""
    out, _ = models.out_of_fold(_modelled(spark, sf_dir), "outer_fold", "inner_fold", _X, "r")
    scopes = F.array(*[F.struct(F.lit(scope).alias("scope"), part.alias("part")) for scope, part in (("pooled", F.lit("")), ("level", F.col("level")), ("domain", F.col("domain")))])
    long = out.select("r", "prediction", F.inline(scopes))
    err = F.col("r") - F.col("prediction")
    r2 = 1 - F.try_divide(F.sum(err * err), F.var_pop("r") * F.count("*"))
    return rounded(long.groupBy("scope", "part").agg(F.count("*").alias("n"), stats.pearson("r", "prediction").alias("pearson"), r2.alias("r2"), F.avg(F.abs(err)).alias("mae")))


@query()
def M04_length_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per set of length predictors and target: rows, share of the variance that lengths explain out of fold, deviation of
    the residuals and their correlation with the level. All models come from one aggregation.
    """
    rows = _modelled(spark, sf_dir)
    columns = [*_SETS["full"], *_TARGETS]
    sums = models.moments(rows, ["outer_fold", "inner_fold"], columns)
    entries = []
    for name, xs in _SETS.items():
        for y in _TARGETS:
            prediction, _ = models.predictions(sums, columns, "outer_fold", xs, y)
            entries.append(F.struct(F.lit(name).alias("predictors"), F.lit(y).alias("target"), F.col(y).alias("y"), (F.col(y) - prediction).alias("e"), F.col("lv")))
    long = rows.select(F.inline(F.array(*entries))).groupBy("predictors", "target")
    explained = 1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("y") * F.count("*"))
    return rounded(long.agg(F.count("*").alias("n"), explained.alias("explained"), F.stddev_pop("e").alias("deviation"), stats.pearson("e", "lv").alias("r_level")))


QUERIES, SQL = query.QUERIES, query.SQL
