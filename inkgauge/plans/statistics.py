"""Aggregations and agreement statistics (A), window-style statistics (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions import stats
from inkgauge.operators import cohorts
from inkgauge.plans.base import ITEMS, PAIRED, RATINGS, Register, items, paired, ratings, rounded
from inkgauge.sources.tables import table

query = Register()
ITEM = ["model", "domain", "id"]


@query(f"""WITH {RATINGS} SELECT model, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd,
round(min(r), 6) AS min, round(max(r), 6) AS max FROM ratings GROUP BY model""")
def A01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratings(spark, sf_dir).groupBy("model").agg(*stats.summary("r")))


@query(f"""WITH {RATINGS} SELECT domain, count(r) AS n, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS sd, round(min(r), 9) AS min,
round(quantile_cont(r, 0.25), 9) AS q25, round(quantile_cont(r, 0.5), 9) AS median, round(quantile_cont(r, 0.75), 9) AS q75,
round(max(r), 9) AS max FROM ratings GROUP BY domain""")
def A02_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(ratings(spark, sf_dir), ["domain"], "r"), 9)


@query(f"""WITH {RATINGS} SELECT lv, model, domain, CAST(grouping(lv) * 4 + grouping(model) * 2 + grouping(domain) AS BIGINT) AS scope, count(r) AS n,
round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS sd, round(min(r), 9) AS min, round(max(r), 9) AS max
FROM ratings GROUP BY CUBE (lv, model, domain)""")
def A03_grouped_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ratings(spark, sf_dir).cube("lv", "model", "domain").agg(
        F.grouping_id().cast("long").alias("scope"), F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.min("r").alias("min"), F.max("r").alias("max")
    )
    return rounded(out, 9)


@query(f"""WITH {RATINGS} SELECT lv, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS sd, round(median(r), 9) AS median FROM ratings GROUP BY lv""")
def A04_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(ratings(spark, sf_dir), ["lv"], "r", {"median": 0.5}).select("lv", "mean", "sd", "median"), 9)


@query("""SELECT pair_id, generation_model AS model, rank() OVER (PARTITION BY generation_model ORDER BY actual_ratio)
+ (count(*) OVER (PARTITION BY generation_model, actual_ratio) - 1) / 2.0 AS midrank FROM level_results WHERE actual_ratio IS NOT NULL""")
def A05_midranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", "generation_model", "actual_ratio").filter("actual_ratio is not null")
    return stats.midranks(rows.withColumnRenamed("generation_model", "model"), ["model"], "actual_ratio", "midrank").drop("actual_ratio")


_R = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


@query(f"""WITH {PAIRED} SELECT evaluator, count(*) AS n, round({_R.format('phi', 'act')}, 6) AS r FROM paired GROUP BY evaluator""")
def A06_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(spark, sf_dir).groupBy("evaluator").agg(F.count("*").alias("n"), stats.pearson("phi", "act").alias("r")))


_RANKED = f"""WITH {PAIRED}, ranked AS (SELECT *,
  rank() OVER (PARTITION BY evaluator ORDER BY phi) + (count(*) OVER (PARTITION BY evaluator, phi) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY evaluator ORDER BY act) + (count(*) OVER (PARTITION BY evaluator, act) - 1) / 2.0 AS ra FROM paired)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.midranks(stats.midranks(paired(spark, sf_dir), ["evaluator"], "phi", "rp"), ["evaluator"], "act", "ra")


@query(f"{_RANKED} SELECT evaluator, count(*) AS n, round({_R.format('rp', 'ra')}, 6) AS rho FROM ranked GROUP BY evaluator")
def A07_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).groupBy("evaluator").agg(F.count("*").alias("n"), stats.pearson("rp", "ra").alias("rho")))


@query(f"""WITH {ITEMS} SELECT model, {', '.join(f"round({_R.format(a, b)}, 6) AS {a}_{b}" for a, b in (('r', 'chars'), ('r', 'tokens'), ('chars', 'tokens')))}
FROM items WHERE chars IS NOT NULL AND tokens IS NOT NULL GROUP BY model""")
def A08_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).filter("chars is not null and tokens is not null")
    pairs = (("r", "chars"), ("r", "tokens"), ("chars", "tokens"))
    return rounded(rows.groupBy("model").agg(*[stats.pearson(a, b).alias(f"{a}_{b}") for a, b in pairs]))


_TAU = f"""WITH {PAIRED}, signs AS (SELECT a.paired_id, a.evaluator, sign(a.phi - b.phi) AS p, sign(a.act - b.act) AS q
  FROM paired a JOIN paired b ON a.paired_id = b.paired_id AND a.lv < b.lv),
taus AS (SELECT paired_id, evaluator, sum(p * q) / nullif(sqrt(sum(p * p) * sum(q * q)), 0) AS tau FROM signs GROUP BY 1, 2)"""


@query(f"{_TAU} SELECT paired_id, evaluator, round(tau, 6) AS tau FROM taus")
def A09_kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.tau_b(paired(spark, sf_dir), ["paired_id", "evaluator"], "lv", "phi", "act"))


@query(f"""WITH {RATINGS}, two AS (SELECT model, lv, rank() OVER (PARTITION BY model ORDER BY r) + (count(*) OVER (PARTITION BY model, r) - 1) / 2.0 AS rk
  FROM ratings WHERE lv IN (1, 5) AND r IS NOT NULL), s AS (SELECT model, sum(CASE WHEN lv = 1 THEN rk END) AS w,
  count(*) FILTER (WHERE lv = 1) AS a, count(*) FILTER (WHERE lv = 5) AS b FROM two GROUP BY model)
SELECT model, a AS n_first, b AS n_last, round((w - a * (a + 1) / 2.0) / nullif(a * b, 0), 6) AS auc FROM s""")
def A11_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = ratings(spark, sf_dir).filter("lv in (1, 5) and r is not null")
    ranked = stats.midranks(two, ["model"], "r", "rk").groupBy("model")
    first = F.col("lv") == 1
    sums = ranked.agg(F.sum(F.when(first, F.col("rk"))).alias("w"), F.count_if(first).alias("n_first"), F.count_if(~first).alias("n_last"))
    auc = F.try_divide(F.col("w") - F.col("n_first") * (F.col("n_first") + 1) / 2, F.col("n_first") * F.col("n_last"))
    return rounded(sums.select("model", "n_first", "n_last", auc.alias("auc")))


_LEVELS = f"""WITH {RATINGS}, s AS (SELECT model, lv, count(r) AS n, avg(r) AS m, var_samp(r) AS v FROM ratings GROUP BY 1, 2)"""


@query(f"""{_LEVELS} SELECT a.model, a.lv, round((a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 0), 6) AS d
FROM s a JOIN s b ON a.model = b.model AND b.lv = a.lv + 1""")
def A12_cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ratings(spark, sf_dir).groupBy("model", "lv").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_samp("r").alias("v"))
    after = W.partitionBy("model").orderBy("lv")  # five rows
    nxt = {c: F.lead(c).over(after) for c in ("lv", "n", "m", "v")}
    pooled = F.sqrt(F.try_divide((F.col("n") - 1) * F.col("v") + (F.col("n2") - 1) * F.col("v2"), F.col("n") + F.col("n2") - 2))
    s = s.withColumns({f"{c}2": x for c, x in nxt.items()}).filter("lv2 = lv + 1")
    return rounded(s.select("model", "lv", F.try_divide(F.col("m") - F.col("m2"), pooled).alias("d")))


@query(f"""WITH {RATINGS}, g AS (SELECT model, lv, count(r) AS n, avg(r) AS m, var_pop(r) AS v FROM ratings WHERE r IS NOT NULL GROUP BY 1, 2),
t AS (SELECT model, sum(n * m) / sum(n) AS mm FROM g GROUP BY 1)
SELECT g.model, round(sum(n * (m - mm) * (m - mm)) / nullif(sum(n * (m - mm) * (m - mm)) + sum(n * v), 0), 6) AS eta2 FROM g JOIN t ON g.model = t.model GROUP BY g.model""")
def A13_eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ratings(spark, sf_dir).filter("r is not null").groupBy("model", "lv").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    g = g.withColumn("mm", F.sum(F.col("n") * F.col("m")).over(W.partitionBy("model")) / F.sum("n").over(W.partitionBy("model")))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mm"), 2))
    return rounded(g.groupBy("model").agg(F.try_divide(between, between + F.sum(F.col("n") * F.col("v"))).alias("eta2")))


_STEPS = f"""WITH {ITEMS}, steps AS (SELECT *, lead(r) OVER (PARTITION BY model, domain, id ORDER BY lv) AS nxt FROM items),
flags AS (SELECT model, domain, id, bool_and(nxt >= r) AS up, bool_and(nxt > r) AS sup, bool_and(nxt <= r) AS down,
  sum(CASE WHEN nxt > r THEN 1 ELSE 0 END) / 4.0 AS rising FROM steps WHERE nxt IS NOT NULL GROUP BY 1, 2, 3)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = W.partitionBy(*ITEM).orderBy("lv")  # five rows
    steps = items(spark, sf_dir).withColumn("nxt", F.lead("r").over(after)).filter("nxt is not null")
    return steps.groupBy(*ITEM).agg(
        F.bool_and(F.expr("nxt >= r")).alias("up"), F.bool_and(F.expr("nxt > r")).alias("sup"), F.bool_and(F.expr("nxt <= r")).alias("down"),
        (F.count_if(F.expr("nxt > r")) / 4).alias("rising"),
    )


@query(f"""{_STEPS} SELECT model, count(*) AS n_items, round(avg(CAST(up AS INTEGER)), 6) AS nondecreasing, round(avg(CAST(sup AS INTEGER)), 6) AS increasing,
round(avg(CAST(down AS INTEGER)), 6) AS nonincreasing, round(avg(rising), 6) AS rising_pairs FROM flags GROUP BY model""")
def A14_monotonic_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int"))
    out = _steps(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("n_items"), rate("up").alias("nondecreasing"), rate("sup").alias("increasing"), rate("down").alias("nonincreasing"), F.avg("rising").alias("rising_pairs")
    )
    return rounded(out)


@query(f"""WITH {ITEMS}, d AS (SELECT model, domain, id, max(CASE WHEN lv = 1 THEN r END) - max(CASE WHEN lv = 5 THEN r END) AS x FROM items GROUP BY 1, 2, 3),
k AS (SELECT model, x, rank() OVER (PARTITION BY model ORDER BY abs(x)) + (count(*) OVER (PARTITION BY model, abs(x)) - 1) / 2.0 AS rk FROM d WHERE x <> 0)
SELECT model, count(*) AS n, round(sum(CASE WHEN x > 0 THEN rk ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN x < 0 THEN rk ELSE 0 END), 6) AS w_minus FROM k GROUP BY model""")
def A15_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("lv") == k, F.col("r")))
    d = items(spark, sf_dir).groupBy(*ITEM).agg((at(1) - at(5)).alias("x")).filter("x <> 0").select("model", "x", F.abs("x").alias("size"))
    ranked = stats.midranks(d, ["model"], "size", "rk").groupBy("model")
    side = lambda c: F.sum(F.when(c, F.col("rk")).otherwise(0.0))
    return rounded(ranked.agg(F.count("*").alias("n"), side(F.col("x") > 0).alias("w_plus"), side(F.col("x") < 0).alias("w_minus")))


_ALPHA = """CASE WHEN count(*) < 2 THEN NULL ELSE 1 - (sum(({0} - {1}) * ({0} - {1})) / count(*)) / nullif(2 * (2 * count(*) * sum({0} * {0} + {1} * {1})
- sum({0} + {1}) * sum({0} + {1})) / (2.0 * count(*) * (2 * count(*) - 1)), 0) END"""


@query(f"WITH {PAIRED} SELECT evaluator, count(*) AS n, round({_ALPHA.format('phi', 'act')}, 6) AS alpha FROM paired GROUP BY evaluator")
def A16_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(spark, sf_dir).groupBy("evaluator").agg(F.count("*").alias("n"), stats.alpha("phi", "act").alias("alpha")))


@query(f"""WITH {PAIRED}, s AS (SELECT evaluator, model, count(*) AS n, {_R.format('phi', 'act')} AS r FROM paired GROUP BY 1, 2)
SELECT evaluator, model, n, round(1 - (1 - r) * (2.0 * n - 1) / (2.0 * n), 6) AS alpha_z FROM s""")
def A17_alpha_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = paired(spark, sf_dir).groupBy("evaluator", "model").agg(F.count("*").alias("n"), stats.pearson("phi", "act").alias("r"))
    return rounded(s.select("evaluator", "model", "n", stats.alpha_z(F.col("r"), F.col("n")).alias("alpha_z")))


@query(f"{_RANKED} SELECT evaluator, count(*) AS n, round({_ALPHA.format('rp', 'ra')}, 6) AS alpha_rank FROM ranked GROUP BY evaluator")
def A18_alpha_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).groupBy("evaluator").agg(F.count("*").alias("n"), stats.alpha("rp", "ra").alias("alpha_rank")))


@query(f"WITH {PAIRED} SELECT lv, count(*) AS n, round({_ALPHA.format('phi', 'act')}, 6) AS alpha FROM paired GROUP BY ROLLUP (lv)")
def A19_alpha_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(spark, sf_dir).rollup("lv").agg(F.count("*").alias("n"), stats.alpha("phi", "act").alias("alpha")))


_EVALUATORS = f"""WITH {PAIRED}, one AS (SELECT model, domain, id, lv, evaluator, avg(phi) AS phi, avg(act) AS act FROM paired GROUP BY 1, 2, 3, 4, 5),
two AS (SELECT a.model, a.domain, a.id, a.lv, a.phi AS p, b.phi AS q FROM one a JOIN one b ON a.model = b.model AND a.domain = b.domain AND a.id = b.id
  AND a.lv = b.lv AND a.evaluator < b.evaluator)"""


def _evaluators(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = paired(spark, sf_dir).groupBy(*ITEM, "lv", "evaluator").agg(F.avg("phi").alias("phi"))
    other = one.select(*ITEM, "lv", F.col("evaluator").alias("e2"), F.col("phi").alias("q"))
    return one.join(other, [*ITEM, "lv"]).filter("evaluator < e2").select(*ITEM, "lv", F.col("phi").alias("p"), "q")


@query(f"""{_EVALUATORS} SELECT model, domain, CAST(grouping(model) * 2 + grouping(domain) AS BIGINT) AS scope, count(*) AS n,
round({_ALPHA.format('p', 'q')}, 6) AS alpha FROM two GROUP BY GROUPING SETS ((), (model), (domain), (model, domain))""")
def A20_evaluator_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _evaluators(spark, sf_dir).cube("model", "domain").agg(F.grouping_id().cast("long").alias("scope"), F.count("*").alias("n"), stats.alpha("p", "q").alias("alpha"))
    return rounded(out)


_LABELLED = f"""WITH {ITEMS}, ranked AS (SELECT model, domain, id, lv, 6.0 - lv AS label,
  rank() OVER (PARTITION BY model, domain, id ORDER BY r) + (count(*) OVER (PARTITION BY model, domain, id, r) - 1) / 2.0 AS rk FROM items),
rhos AS (SELECT model, domain, id, {_R.format('rk', 'label')} AS rho FROM ranked GROUP BY 1, 2, 3)"""


def _item_rhos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.rank().over(W.partitionBy(*ITEM).orderBy("r")) + (F.count("*").over(W.partitionBy(*ITEM, "r")) - 1) / 2  # five rows
    ranked = items(spark, sf_dir).select(*ITEM, (6.0 - F.col("lv")).alias("label"), rank.alias("rk"))
    return ranked.groupBy(*ITEM).agg(stats.pearson("rk", "label").alias("rho"))


@query(f"{_LABELLED} SELECT model, count(rho) AS n, round(avg(rho), 6) AS mean_rho, count(*) FILTER (WHERE rho < -1e-9) AS negative FROM rhos GROUP BY model")
def A22_item_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _item_rhos(spark, sf_dir).groupBy("model")
    return rounded(out.agg(F.count("rho").alias("n"), F.avg("rho").alias("mean_rho"), F.count_if(F.col("rho") < -1e-9).alias("negative")))


@query(f"""WITH {RATINGS}, k AS (SELECT model, 6.0 - lv AS label, rank() OVER (PARTITION BY model ORDER BY r) + (count(*) OVER (PARTITION BY model, r) - 1) / 2.0 AS rk,
  rank() OVER (PARTITION BY model ORDER BY -lv) + (count(*) OVER (PARTITION BY model, lv) - 1) / 2.0 AS lk FROM ratings WHERE r IS NOT NULL)
SELECT model, count(*) AS n, round({_R.format('rk', 'lk')}, 6) AS rho, round({_ALPHA.format('rk', 'lk')}, 6) AS alpha_rank FROM k GROUP BY model""")
def A23_pooled_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).filter("r is not null").select("model", "r", (6.0 - F.col("lv")).alias("label"))
    ranked = stats.midranks(stats.midranks(rows, ["model"], "r", "rk"), ["model"], "label", "lk")
    return rounded(ranked.groupBy("model").agg(F.count("*").alias("n"), stats.pearson("rk", "lk").alias("rho"), stats.alpha("rk", "lk").alias("alpha_rank")))


@query(f"""{_EVALUATORS} SELECT lv, count(*) AS n, round({_R.format('p', 'q')}, 6) AS r, round({_ALPHA.format('p', 'q')}, 6) AS alpha, round(avg(q - p), 6) AS delta FROM two GROUP BY lv""")
def A24_retest_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _evaluators(spark, sf_dir).groupBy("lv")
    return rounded(out.agg(F.count("*").alias("n"), stats.pearson("p", "q").alias("r"), stats.alpha("p", "q").alias("alpha"), F.avg(F.expr("q - p")).alias("delta")))


@query(f"""WITH {RATINGS}, m AS (SELECT model, lv, avg(r) AS mean, count(r) AS n FROM ratings GROUP BY 1, 2),
s AS (SELECT *, lead(mean) OVER (PARTITION BY model ORDER BY lv) AS nxt FROM m)
SELECT model, bool_and(coalesce(nxt < mean, TRUE)) AS strictly_decreasing, round(max(mean) - min(mean), 6) AS span FROM s GROUP BY model""")
def A25_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ratings(spark, sf_dir).groupBy("model", "lv").agg(F.avg("r").alias("mean"))
    s = m.withColumn("nxt", F.lead("mean").over(W.partitionBy("model").orderBy("lv")))
    return rounded(s.groupBy("model").agg(F.bool_and(F.coalesce(F.expr("nxt < mean"), F.lit(True))).alias("strictly_decreasing"), (F.max("mean") - F.min("mean")).alias("span")))


_SCOPES = f"""WITH {PAIRED}, c AS (SELECT *, phi - avg(phi) OVER (PARTITION BY paired_id) AS cp, act - avg(act) OVER (PARTITION BY paired_id) AS ca FROM paired),
s AS (SELECT evaluator, 'pooled' AS scope, '' AS part, phi, act FROM c UNION ALL SELECT evaluator, 'level', CAST(lv AS VARCHAR), phi, act FROM c
  UNION ALL SELECT evaluator, 'domain', domain, phi, act FROM c UNION ALL SELECT evaluator, 'model', model, phi, act FROM c
  UNION ALL SELECT evaluator, 'centered', '', cp, ca FROM c),
a AS (SELECT evaluator, scope, part, count(*) AS n, {_R.format('phi', 'act')} AS r FROM s GROUP BY 1, 2, 3),
scopes AS (SELECT * FROM a UNION ALL SELECT evaluator, 'macro', '', min(n), CASE WHEN count(r) = 5 THEN avg(r) END FROM a WHERE scope = 'level' GROUP BY evaluator)"""


def agreement_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluator, scope, part, n, r: pooled, by level, domain and model, centered within items, and the macro mean of levels."""
    item = W.partitionBy("paired_id")  # five rows
    rows = paired(spark, sf_dir).withColumns({"cp": F.col("phi") - F.avg("phi").over(item), "ca": F.col("act") - F.avg("act").over(item)})
    entry = lambda scope, part, x="phi", y="act": F.struct(F.lit(scope).alias("scope"), part.alias("part"), F.col(x).alias("x"), F.col(y).alias("y"))
    scopes = F.array(
        entry("pooled", F.lit("")), entry("level", F.col("lv").cast("string")), entry("domain", F.col("domain")), entry("model", F.col("model")), entry("centered", F.lit(""), "cp", "ca")
    )
    long = rows.select("evaluator", F.explode(scopes).alias("s")).select("evaluator", "s.*")
    found = long.groupBy("evaluator", "scope", "part").agg(F.count("*").alias("n"), stats.pearson("x", "y").alias("r"))
    macro = found.filter("scope = 'level'").groupBy("evaluator").agg(F.min("n").alias("n"), F.when(F.count("r") == 5, F.avg("r")).alias("r"))
    return found.unionByName(macro.select("evaluator", F.lit("macro").alias("scope"), F.lit("").alias("part"), "n", "r"))


@query(f"{_SCOPES} SELECT evaluator, scope, part, n, round(r, 6) AS r FROM scopes")
def A26_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement_scopes(spark, sf_dir))


@query(f"""{_SCOPES} SELECT a.scope, a.part, round(a.r - b.r, 6) AS difference FROM scopes a JOIN scopes b ON a.scope = b.scope AND a.part = b.part AND a.evaluator < b.evaluator""")
def A27_scope_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = agreement_scopes(spark, sf_dir)
    other = s.select(F.col("evaluator").alias("e2"), "scope", "part", F.col("r").alias("r2"))
    return rounded(s.join(other, ["scope", "part"]).filter("evaluator < e2").select("scope", "part", (F.col("r") - F.col("r2")).alias("difference")))


@query(f"""{_LABELLED} SELECT domain, count(*) AS n_items, count(*) FILTER (WHERE rho > 1e-9) AS positive, count(*) FILTER (WHERE abs(rho) <= 1e-9) AS flat,
count(*) FILTER (WHERE rho < -1e-9) AS negative, round(avg(rho), 6) AS strength FROM rhos GROUP BY domain""")
def A30_gradient_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _item_rhos(spark, sf_dir).groupBy("domain")
    return rounded(out.agg(
        F.count("*").alias("n_items"), F.count_if(F.col("rho") > 1e-9).alias("positive"), F.count_if(F.abs("rho") <= 1e-9).alias("flat"),
        F.count_if(F.col("rho") < -1e-9).alias("negative"), F.avg("rho").alias("strength"),
    ))


@query(f"""{_EVALUATORS}, p AS (SELECT a.model, sign(a.p - b.p) * sign(a.q - b.q) AS s FROM two a JOIN two b ON a.model = b.model AND a.domain = b.domain AND a.id = b.id AND a.lv < b.lv)
SELECT model, count(*) FILTER (WHERE s > 0) AS concordant, count(*) FILTER (WHERE s < 0) AS discordant, count(*) FILTER (WHERE s = 0) AS tied FROM p GROUP BY model""")
def A31_evaluator_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _evaluators(spark, sf_dir)
    other = two.select(*ITEM, F.col("lv").alias("l2"), F.col("p").alias("p2"), F.col("q").alias("q2"))
    s = two.join(other, ITEM).filter("lv < l2").select("model", F.expr("signum(p - p2) * signum(q - q2)").alias("s"))
    return s.groupBy("model").agg(F.count_if(F.expr("s > 0")).alias("concordant"), F.count_if(F.expr("s < 0")).alias("discordant"), F.count_if(F.expr("s = 0")).alias("tied"))


@query(f"""{_EVALUATORS}, m AS (SELECT avg(p) AS mp, stddev_samp(p) AS sp, avg(q) AS mq, stddev_samp(q) AS sq FROM two)
SELECT model, domain, id, lv, round(((p - mp) / sp + (q - mq) / sq) / 2, 6) AS consensus, round(abs((p - mp) / sp - (q - mq) / sq), 6) AS disagreement FROM two, m""")
def A32_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _evaluators(spark, sf_dir)
    m = two.agg(F.avg("p").alias("mp"), F.stddev_samp("p").alias("sp"), F.avg("q").alias("mq"), F.stddev_samp("q").alias("sq"))
    z = two.join(F.broadcast(m)).withColumns({"zp": F.try_divide(F.expr("p - mp"), F.col("sp")), "zq": F.try_divide(F.expr("q - mq"), F.col("sq"))})  # one row
    return rounded(z.select(*ITEM, "lv", F.expr("(zp + zq) / 2").alias("consensus"), F.abs(F.expr("zp - zq")).alias("disagreement")))


@query("""WITH c AS (SELECT level, actual_ratio AS v, count(*) AS n FROM level_results WHERE actual_ratio IS NOT NULL GROUP BY GROUPING SETS ((level, actual_ratio), (actual_ratio)))
SELECT level, count(*) AS different, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS tied_share, max(n) AS largest FROM c GROUP BY level""")
def A33_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "level", "actual_ratio").filter("actual_ratio is not null")
    both = rows.select(F.explode(F.array("level", F.lit(None).cast("string"))).alias("level"), "actual_ratio")
    c = both.groupBy("level", "actual_ratio").agg(F.count("*").alias("n")).groupBy("level")
    return rounded(c.agg(F.count("*").alias("different"), F.sum("n").alias("n"), (F.sum(F.expr("if(n > 1, n, 0)")) / F.sum("n")).alias("tied_share"), F.max("n").alias("largest")).select("level", "different", "n", "tied_share", "largest"))


@query(f"{_TAU} SELECT evaluator, count(tau) AS n, round(avg(tau), 6) AS mean_tau FROM taus GROUP BY evaluator")
def A34_mean_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    taus = stats.tau_b(paired(spark, sf_dir), ["paired_id", "evaluator"], "lv", "phi", "act")
    return rounded(taus.groupBy("evaluator").agg(F.count("tau").alias("n"), F.avg("tau").alias("mean_tau")))


@query("""WITH w AS (SELECT generation_model AS model, actual_ratio AS v, output_tokens AS k FROM level_results WHERE actual_ratio IS NOT NULL AND output_tokens > 0)
SELECT model, round(quantile_cont(v, 0.5), 6) AS weighted_median FROM (SELECT w.model, w.v FROM w, range(0, 100000) AS g(i) WHERE g.i < w.k) GROUP BY model""")
def A35_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "actual_ratio", "output_tokens").filter("actual_ratio is not null and output_tokens > 0")
    return rounded(stats.quantiles(rows.withColumnRenamed("generation_model", "model"), ["model"], "actual_ratio", {"weighted_median": 0.5}, "output_tokens"))


@query("""WITH b AS (SELECT *, CASE WHEN output_tokens < 32 THEN 0 WHEN output_tokens < 64 THEN 1 WHEN output_tokens < 128 THEN 2 WHEN output_tokens < 192 THEN 3
  WHEN output_tokens < 256 THEN 4 ELSE 5 END AS bin FROM level_results WHERE output_tokens IS NOT NULL AND actual_ratio IS NOT NULL)
SELECT bin, count(*) AS n, round(avg(actual_ratio), 9) AS mean, round(median(actual_ratio), 9) AS median, round(stddev_pop(actual_ratio), 9) AS sd FROM b GROUP BY bin""")
def A37_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "output_tokens", "actual_ratio").dropna()
    t = F.col("output_tokens")
    bin_ = F.when(t < 32, 0).when(t < 64, 1).when(t < 128, 2).when(t < 192, 3).when(t < 256, 4).otherwise(5)
    found = stats.describe(rows.withColumn("bin", bin_), ["bin"], "actual_ratio", {"median": 0.5})
    return rounded(found.select("bin", "n", "mean", "median", "sd"), 9)


@query("""SELECT generation_model AS model, domain, count(*) AS pairs, count(actual_ratio) AS scored, round(count(actual_ratio) / CAST(count(*) AS DOUBLE), 6) AS coverage,
CASE WHEN count(actual_ratio) = count(*) THEN 'COMPLETE' ELSE 'INTERIM' END AS state FROM level_results GROUP BY CUBE (generation_model, domain)""")
def A38_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "actual_ratio").withColumnRenamed("generation_model", "model")
    done = F.count("actual_ratio")
    out = rows.cube("model", "domain").agg(
        F.count("*").alias("pairs"), done.alias("scored"), (done / F.count("*")).alias("coverage"), F.when(done == F.count("*"), "COMPLETE").otherwise("INTERIM").alias("state")
    )
    return rounded(out)


@query("""SELECT sha256(json_extract_string(raw_value, '$.protocol.cap') || chr(0) || json_extract_string(raw_value, '$.protocol.effort')) AS protocol_sha256, count(*) AS n
FROM jsonl_rows WHERE json_valid(raw_value) GROUP BY 1""")
def A40_protocol_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jsonl_rows", "raw_value")
    part = lambda name: F.get_json_object("raw_value", f"$.protocol.{name}")
    key = F.sha2(F.concat(part("cap"), F.lit("\0"), part("effort")), 256)
    return rows.filter(F.col("raw_value").isNotNull()).groupBy(key.alias("protocol_sha256")).agg(F.count("*").alias("n"))


@query(f"""WITH {RATINGS}, u AS (SELECT lv, 'ratio' AS measure, r AS v FROM ratings UNION ALL SELECT lv, 'chars', chars FROM ratings UNION ALL SELECT lv, 'tokens', tokens FROM ratings)
SELECT lv, measure, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM u GROUP BY 1, 2""")
def A43_level_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ratings(spark, sf_dir).withColumnRenamed("r", "ratio").unpivot(["lv"], ["ratio", "chars", "tokens"], "measure", "v")
    return rounded(u.groupBy("lv", "measure").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")))


@query(f"WITH {ITEMS} SELECT model, domain, id, lv, round(r - avg(r) OVER (PARTITION BY model, domain, id), 6) AS centered FROM items")
def W01_item_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(items(spark, sf_dir).select(*ITEM, "lv", (F.col("r") - F.avg("r").over(W.partitionBy(*ITEM))).alias("centered")))


@query(f"WITH {ITEMS} SELECT * FROM (SELECT model, domain, id, lv, round(lead(r) OVER (PARTITION BY model, domain, id ORDER BY lv) - r, 6) AS step FROM items) WHERE step IS NOT NULL")
def W02_level_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.lead("r").over(W.partitionBy(*ITEM).orderBy("lv")) - F.col("r")
    return rounded(items(spark, sf_dir).select(*ITEM, "lv", step.alias("step")).filter("step is not null"))


@query(f"WITH {ITEMS} SELECT model, domain, id, lv, round((r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0), 6) AS z FROM items WINDOW w AS (PARTITION BY model, lv)")
def W04_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    m = rows.groupBy("model", "lv").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    z = rows.join(F.broadcast(m), ["model", "lv"])  # a row for each model and level
    return rounded(z.select(*ITEM, "lv", F.try_divide(F.expr("r - m"), F.col("s")).alias("z")))


@query(f"""WITH {ITEMS} SELECT model, domain, id, round(avg(r) FILTER (WHERE k <= ceil(0.3 * n)), 9) AS first_part, round(avg(r) FILTER (WHERE k > n - ceil(0.3 * n)), 9) AS last_part
FROM (SELECT model, domain, id, r, row_number() OVER (PARTITION BY model, domain, id ORDER BY lv) AS k, count(*) OVER (PARTITION BY model, domain, id) AS n FROM items) GROUP BY 1, 2, 3""")
def W08_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = W.partitionBy(*ITEM)
    rows = items(spark, sf_dir).withColumns({"k": F.row_number().over(item.orderBy("lv")), "n": F.count("*").over(item)})
    part = lambda c: F.avg(F.when(F.expr(c), F.col("r")))
    return rounded(rows.groupBy(*ITEM).agg(part("k <= ceil(0.3 * n)").alias("first_part"), part("k > n - ceil(0.3 * n)").alias("last_part")), 9)


@query()
def A10_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r and Spearman's rho of both scores with their two-sided p-values by Student's t; null for fewer than three."""
    keys = ["evaluator", "model"]
    ranked = stats.midranks(stats.midranks(paired(spark, sf_dir), keys, "phi", "rp"), keys, "act", "ra")
    s = ranked.groupBy(*keys).agg(F.count("*").alias("n"), stats.pearson("phi", "act").alias("r"), stats.pearson("rp", "ra").alias("rho"))
    t = lambda c: F.when(F.col("n") > 2, F.try_divide(F.col(c) * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col(c) * F.col(c))))
    return rounded(s.withColumns({"p": stats.student_p(t("r"), F.col("n") - 2), "p_rho": stats.student_p(t("rho"), F.col("n") - 2)}))


@query()
def A15_signed_rank_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank test of first against last level by model: rank sums, tie-corrected z and two-sided p; zeros are dropped."""
    at = lambda k: F.max(F.when(F.col("lv") == k, F.col("r")))
    d = items(spark, sf_dir).groupBy(*ITEM).agg((at(1) - at(5)).alias("x")).filter("x <> 0").select("model", "x", F.abs("x").alias("size"))
    ranked = stats.midranks(d, ["model"], "size", "rk")
    ties = ranked.groupBy("model", "size").agg(F.count("*").alias("t"), F.sum(F.when(F.col("x") > 0, F.col("rk")).otherwise(0.0)).alias("w"))
    sums = ties.groupBy("model").agg(F.sum("t").alias("n"), F.sum("w").alias("w_plus"), F.sum(F.expr("cast(t * t * t - t as double)")).alias("_ties"))
    n = F.col("n").cast("double")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(spread))
    out = sums.withColumn("z", z)
    return rounded(out.select("model", "n", "w_plus", "z", stats.normal_p(F.col("z")).alias("p")))


@query(f"""WITH {RATINGS} SELECT domain, round(avg(CASE WHEN lv = 1 THEN r END), 6) AS first_level, round(avg(CASE WHEN lv = 5 THEN r END), 6) AS last_level,
round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM ratings WHERE r IS NOT NULL GROUP BY domain""")
def A41_quick_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.avg(F.when(F.col("lv") == k, F.col("r")))
    rows = ratings(spark, sf_dir).filter("r is not null").groupBy("domain")
    return rounded(rows.agg(at(1).alias("first_level"), at(5).alias("last_level"), F.avg((F.col("r") == 0).cast("double")).alias("zero_share")))


@query(f"""WITH {RATINGS}, l AS (SELECT model, r, (6.0 - lv) / 5 AS label FROM ratings WHERE r IS NOT NULL)
SELECT model, count(*) AS n, round({_ALPHA.format('label', 'r')}, 6) AS alpha FROM l GROUP BY model""")
def A42_label_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).filter("r is not null").select("model", "r", ((6.0 - F.col("lv")) / 5).alias("label"))
    return rounded(rows.groupBy("model").agg(F.count("*").alias("n"), stats.alpha("label", "r").alias("alpha")))


@query(f"""WITH {RATINGS}, c AS (SELECT model, domain, r, 6.0 - lv AS given, row_number() OVER (PARTITION BY model, domain ORDER BY r DESC, id, lv) - 1 AS k, count(*) OVER (PARTITION BY model, domain) AS n
FROM ratings WHERE r IS NOT NULL), l AS (SELECT *, 5.0 - CASE WHEN n < 5 THEN 4 ELSE least(floor(k / floor(n / 5)), 4) END AS derived FROM c)
SELECT domain, count(*) AS n, round({_R.format('r', 'given')}, 6) AS r_given, round({_R.format('r', 'derived')}, 6) AS r_derived, round(avg(CASE WHEN given = derived THEN 1.0 ELSE 0.0 END), 6) AS same FROM l GROUP BY domain""")
def A44_label_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts.stratify(ratings(spark, sf_dir).filter("r is not null"), ["model", "domain"], "r", ["id", "lv"])
    rows = rows.withColumns({"given": 6.0 - F.col("lv"), "derived": 6.0 - F.col("stratum")}).groupBy("domain")
    same = F.avg((F.col("given") == F.col("derived")).cast("double"))
    return rounded(rows.agg(F.count("*").alias("n"), stats.pearson("r", "given").alias("r_given"), stats.pearson("r", "derived").alias("r_derived"), same.alias("same")))


QUERIES, SQL = query.QUERIES, query.SQL
