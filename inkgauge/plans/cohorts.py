"""Cohorts, sampling, ordering (C), joins (J), filters and validation (F), ranks in cells (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.operators import cohorts
from inkgauge.plans.base import ITEMS, PAIRED, RATINGS, Register, items, paired, ratings, rounded
from inkgauge.sources.tables import table

query = Register()
ITEM = ["model", "domain", "id"]


@query("""WITH p AS (SELECT DISTINCT generation_model AS model, domain, id FROM level_results), k AS (SELECT count(DISTINCT model) AS k FROM p),
c AS (SELECT domain, id, count(*) AS n FROM p GROUP BY 1, 2)
SELECT domain, count(*) AS sources, count(*) FILTER (WHERE n >= 2) AS in_two, count(*) FILTER (WHERE n = k) AS in_all FROM c, k GROUP BY domain""")
def C01_model_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id")
    models = rows.agg(F.countDistinct("generation_model").alias("k"))  # one row
    c = rows.groupBy("domain", "id").agg(F.countDistinct("generation_model").alias("n")).join(F.broadcast(models))
    return c.groupBy("domain").agg(F.count("*").alias("sources"), F.count_if(F.expr("n >= 2")).alias("in_two"), F.count_if(F.expr("n = k")).alias("in_all"))


@query("""WITH c AS (SELECT domain, id FROM level_results WHERE domain IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT generation_model) >= 2),
x AS (SELECT DISTINCT lower(trim(domain)) AS domain, id FROM paired_items WHERE source_cluster_fingerprint = 'legacy-id-fallback'),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.domain ORDER BY sha256(concat_ws(chr(0), 'cohort', c.domain, c.id)), c.id) AS k FROM c ANTI JOIN x ON c.domain = x.domain AND c.id = x.id)
SELECT domain, id, k AS place FROM r WHERE k <= 200""")
def C02_hash_ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id").filter("domain is not null and id is not null")
    common = rows.groupBy("domain", "id").agg(F.countDistinct("generation_model").alias("n")).filter("n >= 2")
    legacy = table(spark, sf_dir, "paired_items", "domain", "id", "source_cluster_fingerprint")
    legacy = legacy.filter("source_cluster_fingerprint = 'legacy-id-fallback'").select(F.lower(F.trim("domain")).alias("domain"), "id")
    return cohorts.hash_top(common.join(legacy, ["domain", "id"], "left_anti"), ["domain"], "id", 200, "cohort", "place").select("domain", "id", "place")


@query("""WITH c AS (SELECT domain, id FROM level_results WHERE domain IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT generation_model) >= 2),
q AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM c GROUP BY domain)),
r AS (SELECT c.*, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat_ws(chr(0), 'core', domain, id)), id) AS k FROM c)
SELECT domain, id FROM r, q WHERE k <= n""")
def C03_balanced_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id").filter("domain is not null and id is not null")
    common = rows.groupBy("domain", "id").agg(F.countDistinct("generation_model").alias("n")).filter("n >= 2").select("domain", "id")
    quota = common.groupBy("domain").count().agg(F.coalesce(F.min("count"), F.lit(0))).first()[0]  # one number
    return cohorts.hash_top(common, ["domain"], "id", quota, "core", "place").select("domain", "id")


_BIN = "CAST(least(floor(output_tokens / 48), 5) AS INTEGER)"


@query(f"""WITH r AS (SELECT pair_id, {_BIN} AS bin, row_number() OVER (PARTITION BY {_BIN} ORDER BY sha256(concat_ws(chr(0), 'bin', {_BIN}, pair_id)), pair_id) AS k
FROM level_results WHERE output_tokens IS NOT NULL) SELECT bin, pair_id, k AS place FROM r WHERE k <= 100""")
def C04_sample_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", "output_tokens").filter("output_tokens is not null")
    rows = rows.select("pair_id", F.least(F.floor(F.col("output_tokens") / 48), F.lit(5)).cast("int").alias("bin"))
    return cohorts.hash_top(rows, ["bin"], "pair_id", 100, "bin", "place").select("bin", "pair_id", "place")


_STRATA = f"""WITH {RATINGS}, cell AS (SELECT model, domain, id, lv, r, row_number() OVER (PARTITION BY model, domain ORDER BY r DESC, id, lv) - 1 AS k,
  count(*) OVER (PARTITION BY model, domain) AS n FROM ratings WHERE r IS NOT NULL),
strata AS (SELECT *, CAST(CASE WHEN n < 5 THEN 5 ELSE least(floor(k / floor(n / 5)), 4) + 1 END AS INTEGER) AS stratum FROM cell)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.stratify(ratings(spark, sf_dir).filter("r is not null"), ["model", "domain"], "r", ["id", "lv"])


@query(f"{_STRATA} SELECT model, domain, id, lv, stratum FROM strata")
def C06_stratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).select(*ITEM, "lv", "stratum")


@query(f"""{_STRATA} SELECT lv, {', '.join(f"count(*) FILTER (WHERE stratum = {k}) AS to_{k}" for k in range(1, 6))} FROM strata GROUP BY lv""")
def C07_level_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("lv").agg(*[F.count_if(F.col("stratum") == k).alias(f"to_{k}") for k in range(1, 6)])


@query("""SELECT generation_model AS model, domain, id, level, count(*) AS copies, count(DISTINCT sha256(coalesce(output, ''))) AS contents,
CASE WHEN count(DISTINCT sha256(coalesce(output, ''))) > 1 THEN 'conflict' ELSE 'duplicate' END AS state
FROM level_results GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def C11_duplicates_and_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id", "level", "output").withColumnRenamed("generation_model", "model")
    out = rows.groupBy(*ITEM, "level").agg(F.count("*").alias("copies"), F.countDistinct(F.sha2(F.coalesce("output", F.lit("")), 256)).alias("contents"))
    return out.filter("copies > 1").withColumn("state", F.when(F.col("contents") > 1, "conflict").otherwise("duplicate"))


_CALIPERS = (1.1, 1.2, 1.3)


@query(f"""WITH {ITEMS}, s AS (SELECT model, domain, id, lv, chars, lead(chars) OVER (PARTITION BY model, domain, id ORDER BY lv) AS nxt FROM items WHERE chars > 0)
SELECT lv, {', '.join(f"count(*) FILTER (WHERE greatest(chars, nxt) / least(chars, nxt) <= {c}) AS within_{int(c * 100)}" for c in _CALIPERS)}, count(*) AS pairs
FROM s WHERE nxt IS NOT NULL GROUP BY lv""")
def C12_caliper_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = W.partitionBy(*ITEM).orderBy("lv")  # five rows
    s = items(spark, sf_dir).filter("chars > 0").withColumn("nxt", F.lead("chars").over(after)).filter("nxt is not null")
    ratio = F.greatest("chars", "nxt") / F.least("chars", "nxt")
    return s.groupBy("lv").agg(*[F.count_if(ratio <= c).alias(f"within_{int(c * 100)}") for c in _CALIPERS], F.count("*").alias("pairs"))


@query(f"""WITH {ITEMS} SELECT model, domain, id, arg_max(lv, (r, -lv)) AS strongest, round(max(r), 6) AS r FROM items GROUP BY 1, 2, 3""")
def C13_strongest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("lv", F.struct(F.col("r"), -F.col("lv")))
    return rounded(items(spark, sf_dir).groupBy(*ITEM).agg(best.alias("strongest"), F.max("r").alias("r")))


_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(f"""WITH ids AS (SELECT DISTINCT generation_model AS model, domain, sha256(id) AS h FROM level_results WHERE id IS NOT NULL)
SELECT model, domain, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_LANES})) AS digest FROM ids GROUP BY 1, 2""")
def C14_roster_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id").filter("id is not null")
    return cohorts.roster_digest(rows.withColumnRenamed("generation_model", "model"), ["model", "domain"], "id")


@query(f"""WITH {PAIRED}, j AS (SELECT model, domain, id, lv, max(CASE WHEN evaluator = 'lark-8b' THEN CASE WHEN phi >= 0.5 THEN 'high' ELSE 'low' END END) AS one,
max(CASE WHEN evaluator = 'mistle-8x7b' THEN CASE WHEN phi >= 0.5 THEN 'high' ELSE 'low' END END) AS two FROM paired GROUP BY 1, 2, 3, 4)
SELECT model, domain, id, lv, CASE WHEN one = two THEN one ELSE 'human' END AS label FROM j WHERE one IS NOT NULL AND two IS NOT NULL""")
def C16_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.when(F.col("phi") >= 0.5, "high").otherwise("low")
    slot = lambda e: F.max(F.when(F.col("evaluator") == e, vote))
    j = paired(spark, sf_dir).groupBy(*ITEM, "lv").agg(slot("lark-8b").alias("one"), slot("mistle-8x7b").alias("two")).dropna(subset=["one", "two"])
    return j.select(*ITEM, "lv", F.when(F.expr("one = two"), F.col("one")).otherwise("human").alias("label"))


@query(f"""WITH {RATINGS}, {PAIRED}, a AS (SELECT evaluator, model, domain, id, lv, avg(act) AS act, avg(phi) AS phi FROM paired GROUP BY 1, 2, 3, 4, 5)
SELECT a.evaluator, r.model, r.domain, r.id, r.lv, round(r.r, 9) AS r, round(a.act, 9) AS act, round(a.phi, 9) AS phi FROM ratings r JOIN a ON r.model = a.model AND r.domain = a.domain AND r.id = a.id AND r.lv = a.lv
WHERE r.r IS NOT NULL""")
def J01_source_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with the scores of every evaluator."""
    a = paired(spark, sf_dir).groupBy("evaluator", *ITEM, "lv").agg(F.avg("act").alias("act"), F.avg("phi").alias("phi"))
    return rounded(ratings(spark, sf_dir).filter("r is not null").join(a, [*ITEM, "lv"]).select("evaluator", *ITEM, "lv", "r", "act", "phi"), 9)


@query(f"""WITH {RATINGS}, {PAIRED}, s AS (SELECT DISTINCT model, domain, id, lv FROM ratings WHERE r IS NOT NULL), e AS (SELECT DISTINCT evaluator FROM paired),
a AS (SELECT DISTINCT evaluator, model, domain, id, lv FROM paired), w AS (SELECT e.evaluator, s.* FROM s, e)
SELECT evaluator, sum(missing) AS without_score, sum(unknown) AS without_source FROM (
  SELECT w.evaluator, 1 AS missing, 0 AS unknown FROM w ANTI JOIN a USING (evaluator, model, domain, id, lv) UNION ALL
  SELECT a.evaluator, 0, 1 FROM a ANTI JOIN s USING (model, domain, id, lv) UNION ALL SELECT evaluator, 0, 0 FROM e) GROUP BY 1""")
def J01_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluator the levels without a score and the scores without a level: full coverage has none of either."""
    s = ratings(spark, sf_dir).filter("r is not null").select(*ITEM, "lv").distinct()
    a = paired(spark, sf_dir).select("evaluator", *ITEM, "lv").distinct()
    names = a.select("evaluator").distinct()
    wanted = s.join(F.broadcast(names))  # as many names as evaluators
    missing = wanted.join(a, ["evaluator", *ITEM, "lv"], "left_anti").groupBy("evaluator").agg(F.count("*").alias("m"))
    unknown = a.join(s, [*ITEM, "lv"], "left_anti").groupBy("evaluator").agg(F.count("*").alias("u"))
    out = names.join(missing, "evaluator", "left").join(unknown, "evaluator", "left")
    return out.select("evaluator", F.coalesce("m", F.lit(0)).alias("without_score"), F.coalesce("u", F.lit(0)).alias("without_source"))


@query("""SELECT l.pair_id, r.adapter_kind, r.max_output_tokens, CAST(l.output_tokens >= r.max_output_tokens AS BOOLEAN) AS at_limit
FROM level_results l JOIN routes r ON r.model = l.generation_model WHERE l.output_tokens IS NOT NULL""")
def J02_routes_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", "generation_model", "output_tokens").filter("output_tokens is not null")
    routes = table(spark, sf_dir, "routes", "model", "adapter_kind", "max_output_tokens")
    joined = rows.join(routes, rows.generation_model == routes.model)
    return joined.select("pair_id", "adapter_kind", "max_output_tokens", F.expr("output_tokens >= max_output_tokens").alias("at_limit"))


@query("""WITH e AS (SELECT DISTINCT evaluator FROM paired_items), q AS (SELECT DISTINCT l.generation_model AS model, l.domain, l.id, e.evaluator FROM level_results l, e),
d AS (SELECT DISTINCT generation_model AS model, lower(trim(domain)) AS domain, id, evaluator FROM paired_items WHERE len(list_filter(whitebox_phi, lambda x: x IS NOT NULL)) = 5)
SELECT q.* FROM q ANTI JOIN d USING (model, domain, id, evaluator)""")
def J05_pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that an evaluator has not scored on all five levels yet: the queue of a resumed run."""
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id").withColumnRenamed("generation_model", "model").distinct()
    scored = table(spark, sf_dir, "paired_items", "generation_model", "domain", "id", "evaluator", "whitebox_phi")
    queue = rows.join(F.broadcast(scored.select("evaluator").distinct()))  # as many names as evaluators
    done = scored.filter(F.size(F.filter("whitebox_phi", lambda x: x.isNotNull())) == 5)
    return queue.join(done.select(F.col("generation_model").alias("model"), F.lower(F.trim("domain")).alias("domain"), "id", "evaluator"), [*ITEM, "evaluator"], "left_anti")


@query("""WITH k AS (SELECT paired_id, lower(trim(source_cluster_domain)) AS domain, trim(source_cluster_id) AS id,
  CASE WHEN source_cluster_fingerprint <> 'legacy-id-fallback' THEN lower(source_cluster_fingerprint) END AS fp FROM paired_items),
m AS (SELECT domain, id, min(fp) AS known, count(DISTINCT fp) AS n FROM k GROUP BY 1, 2)
SELECT k.paired_id, coalesce(k.fp, m.known, 'none') AS fingerprint, m.n > 1 AS conflict FROM k JOIN m ON k.domain = m.domain AND k.id = m.id""")
def J06_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_items", "paired_id", "source_cluster_domain", "source_cluster_id", "source_cluster_fingerprint")
    fp = F.when(F.col("source_cluster_fingerprint") != "legacy-id-fallback", F.lower("source_cluster_fingerprint"))
    k = rows.select("paired_id", F.lower(F.trim("source_cluster_domain")).alias("domain"), F.trim("source_cluster_id").alias("id"), fp.alias("fp"))
    m = k.groupBy("domain", "id").agg(F.min("fp").alias("known"), F.countDistinct("fp").alias("n"))
    return k.join(m, ["domain", "id"]).select("paired_id", F.coalesce("fp", "known", F.lit("none")).alias("fingerprint"), F.expr("n > 1").alias("conflict"))


@query("""WITH b AS (SELECT * FROM (VALUES (0, 0, 32), (1, 32, 64), (2, 64, 128), (3, 128, 192), (4, 192, 256), (5, 256, 320)) AS t(bin, lo, hi))
SELECT b.bin, count(*) AS pairs FROM level_results l JOIN b ON l.output_tokens >= b.lo AND l.output_tokens < b.hi GROUP BY b.bin""")
def J09_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spark.createDataFrame([(0, 0, 32), (1, 32, 64), (2, 64, 128), (3, 128, 192), (4, 192, 256), (5, 256, 320)], "bin int, lo int, hi int")
    rows = table(spark, sf_dir, "level_results", "output_tokens")
    inside = (rows.output_tokens >= bins.lo) & (rows.output_tokens < bins.hi)
    return rows.join(F.broadcast(bins), inside).groupBy("bin").agg(F.count("*").alias("pairs"))  # six bins


@query(f"""WITH {ITEMS} SELECT a.model, a.domain, count(*) AS pairs, round(avg(abs(a.r - b.r)), 6) AS mean_gap FROM items a JOIN items b
ON a.model = b.model AND a.domain = b.domain AND a.id = b.id AND a.lv < b.lv GROUP BY 1, 2""")
def J10_level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = items(spark, sf_dir)
    b = a.select(*ITEM, F.col("lv").alias("l2"), F.col("r").alias("r2"))
    both = a.join(b, ITEM).filter("lv < l2").groupBy("model", "domain")
    return rounded(both.agg(F.count("*").alias("pairs"), F.avg(F.abs(F.expr("r - r2"))).alias("mean_gap")))


@query("""SELECT pair_id, CASE WHEN output IS NULL THEN 'output missing' WHEN length(trim(output)) < 10 THEN 'output too short'
WHEN output_chars IS NULL OR output_chars <> length(output) THEN 'length differs' WHEN actual_ratio IS NULL THEN 'score missing'
WHEN actual_ratio < 0 OR actual_ratio > 1 THEN 'score out of range' ELSE 'valid' END AS reason FROM level_results""")
def F02_row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", "output", "output_chars", "actual_ratio")
    o, s = F.col("output"), F.col("actual_ratio")
    reason = (
        F.when(o.isNull(), "output missing").when(F.length(F.trim(o)) < 10, "output too short")
        .when(F.col("output_chars").isNull() | (F.col("output_chars") != F.length(o)), "length differs")
        .when(s.isNull(), "score missing").when((s < 0) | (s > 1), "score out of range").otherwise("valid")
    )
    return rows.select("pair_id", reason.alias("reason"))


@query("""SELECT generation_model AS model, domain, id, count(DISTINCT level) AS levels, count(DISTINCT source_cluster_fingerprint) AS fingerprints,
count(DISTINCT level) = 5 AND count(DISTINCT source_cluster_fingerprint) <= 1 AS complete FROM level_results GROUP BY 1, 2, 3""")
def F04_item_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id", "level", "source_cluster_fingerprint").withColumnRenamed("generation_model", "model")
    out = rows.groupBy(*ITEM).agg(F.countDistinct("level").alias("levels"), F.countDistinct("source_cluster_fingerprint").alias("fingerprints"))
    return out.withColumn("complete", F.expr("levels = 5 and fingerprints <= 1"))


@query("""SELECT pair_id, round(actual_ratio * output_chars, 6) AS gain, round(output_chars - actual_ratio * output_chars, 6) AS rest,
round(ln(1 + output_chars), 6) AS log_chars FROM level_results WHERE actual_ratio IS NOT NULL AND output_chars IS NOT NULL""")
def F06_gain_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", "actual_ratio", "output_chars").dropna()
    gain = F.col("actual_ratio") * F.col("output_chars")
    return rounded(rows.select("pair_id", gain.alias("gain"), (F.col("output_chars") - gain).alias("rest"), F.log1p(F.col("output_chars")).alias("log_chars")))


QUERIES, SQL = query.QUERIES, query.SQL
