"""Records and their contracts: further filters (F), joins (J), cohorts (C), windows (W), loaders (S) and quotas (X02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions import stats
from inkgauge.operators import cohorts
from inkgauge.plans.base import PAIRED, RATINGS, Register, paired, ratings, rounded
from inkgauge.sources.tables import table

query = Register()
ITEM = ["model", "domain", "id"]


@query(f"""WITH {RATINGS}, {PAIRED}, a AS (SELECT model, domain, id, lv, avg(act) AS act FROM paired GROUP BY 1, 2, 3, 4)
SELECT r.model, count(*) AS n, count(*) FILTER (WHERE abs(r.r - a.act) <= 1e-9) AS exact, count(*) FILTER (WHERE abs(r.r - a.act) <= 1e-4) AS near
FROM ratings r JOIN a ON r.model = a.model AND r.domain = a.domain AND r.id = a.id AND r.lv = a.lv WHERE r.r IS NOT NULL GROUP BY r.model""")
def F03_source_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = paired(spark, sf_dir).groupBy(*ITEM, "lv").agg(F.avg("act").alias("act"))
    gap = F.abs(F.col("r") - F.col("act"))
    both = ratings(spark, sf_dir).filter("r is not null").join(a, [*ITEM, "lv"]).groupBy("model")
    return both.agg(F.count("*").alias("n"), F.count_if(gap <= 1e-9).alias("exact"), F.count_if(gap <= 1e-4).alias("near"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT (generation_model, domain, id)) AS items, count(DISTINCT trim(source_cluster_id)) AS clusters,
count(DISTINCT generation_model) AS models, count(DISTINCT domain) AS domains FROM level_results""")
def F05_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "id", "source_cluster_id")
    return rows.agg(
        F.count("*").alias("n_rows"), F.countDistinct("generation_model", "domain", "id").alias("items"), F.countDistinct(F.trim("source_cluster_id")).alias("clusters"),
        F.countDistinct("generation_model").alias("models"), F.countDistinct("domain").alias("domains"),
    )


@query(f"WITH {PAIRED} SELECT paired_id, lv, phi, act, round(act - phi, 9) AS gap FROM paired")
def F07_level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(spark, sf_dir).select("paired_id", "lv", "phi", "act", F.expr("act - phi").alias("gap")), 9)


@query("""SELECT evaluator, count(*) AS n, count(*) FILTER (WHERE whitebox_phi IS NULL OR blackbox_actual IS NULL) AS missing,
count(*) FILTER (WHERE len(whitebox_phi) = 5 AND len(blackbox_actual) = 5 AND len(list_filter(whitebox_phi, lambda x: x IS NULL)) + len(list_filter(blackbox_actual, lambda x: x IS NULL)) = 0) AS whole
FROM paired_items GROUP BY evaluator""")
def F12_five_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_items", "evaluator", "whitebox_phi", "blackbox_actual")
    full = lambda c: (F.size(c) == 5) & ~F.exists(c, lambda x: x.isNull())
    missing = F.col("whitebox_phi").isNull() | F.col("blackbox_actual").isNull()
    return rows.groupBy("evaluator").agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"), F.count_if(full("whitebox_phi") & full("blackbox_actual")).alias("whole"))


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN whitebox_phi IS NULL THEN 'phi missing' END, CASE WHEN blackbox_actual IS NULL THEN 'actual missing' END,
CASE WHEN source_cluster_fingerprint IS NULL OR source_cluster_fingerprint = 'legacy-id-fallback' THEN 'no fingerprint' END,
CASE WHEN NOT regexp_full_match(scoring_input_sha256, '[0-9a-f]{64}') THEN 'hash spelling' END], lambda x: x IS NOT NULL)) AS reason FROM paired_items) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def F10_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_items", "whitebox_phi", "blackbox_actual", "source_cluster_fingerprint", "scoring_input_sha256")
    fp = F.col("source_cluster_fingerprint")
    rules = (
        ("phi missing", F.col("whitebox_phi").isNull()), ("actual missing", F.col("blackbox_actual").isNull()), ("no fingerprint", fp.isNull() | (fp == "legacy-id-fallback")),
        ("hash spelling", ~F.col("scoring_input_sha256").rlike("^[0-9a-f]{64}$")),
    )
    reasons = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRED}, a AS (SELECT model, domain, id, lv, avg(CASE WHEN evaluator = 'lark-8b' THEN phi END) AS lark, avg(CASE WHEN evaluator = 'mistle-8x7b' THEN phi END) AS mistle FROM paired GROUP BY 1, 2, 3, 4)
SELECT l.pair_id, r.adapter_kind, l.actual_ratio, round(a.lark, 9) AS lark, round(a.mistle, 9) AS mistle FROM level_results l LEFT JOIN routes r ON r.model = l.generation_model
LEFT JOIN a ON a.model = l.generation_model AND a.domain = l.domain AND a.id = l.id AND a.lv = CAST(substr(l.level, 2) AS INTEGER)""")
def J04_feature_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda e: F.avg(F.when(F.col("evaluator") == e, F.col("phi")))
    a = paired(spark, sf_dir).groupBy(*ITEM, "lv").agg(by("lark-8b").alias("lark"), by("mistle-8x7b").alias("mistle"))
    rows = table(spark, sf_dir, "level_results", "pair_id", "generation_model", "domain", "id", "level", "actual_ratio")
    rows = rows.withColumnRenamed("generation_model", "model").withColumn("lv", F.substring("level", 2, 8).cast("int"))
    joined = rows.join(table(spark, sf_dir, "routes", "model", "adapter_kind"), "model", "left").join(a, [*ITEM, "lv"], "left")
    return rounded(joined.select("pair_id", "adapter_kind", "actual_ratio", "lark", "mistle"), 9)


@query("""WITH o AS (SELECT pair_id, domain, count(*) OVER (PARTITION BY prompt_sha256) AS owners, actual_ratio, output FROM level_results),
t AS (SELECT domain, CASE WHEN output IS NULL THEN 'no output' WHEN actual_ratio IS NULL THEN 'no score' WHEN owners > 1 THEN 'shared prompt' ELSE 'eligible' END AS reason FROM o)
SELECT domain, reason, count(*) AS n FROM t GROUP BY 1, 2""")
def J07_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "domain", "prompt_sha256", "actual_ratio", "output")
    rows = rows.select("domain", "prompt_sha256", F.col("actual_ratio").isNull().alias("unscored"), F.col("output").isNull().alias("missing"))
    owners = rows.groupBy("prompt_sha256").agg(F.count("*").alias("owners"))
    joined = rows.join(owners, rows.prompt_sha256.eqNullSafe(owners.prompt_sha256))
    reason = F.when(F.col("missing"), "no output").when(F.col("unscored"), "no score").when(F.col("owners") > 1, "shared prompt").otherwise("eligible")
    return joined.groupBy("domain", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRED} SELECT model, domain, id, lv, round(avg(CASE WHEN evaluator = 'lark-8b' THEN phi END), 9) AS lark, round(avg(CASE WHEN evaluator = 'mistle-8x7b' THEN phi END), 9) AS mistle,
count(DISTINCT evaluator) AS evaluators FROM paired GROUP BY 1, 2, 3, 4""")
def J08_evaluator_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda e: F.avg(F.when(F.col("evaluator") == e, F.col("phi")))
    out = paired(spark, sf_dir).groupBy(*ITEM, "lv")
    return rounded(out.agg(by("lark-8b").alias("lark"), by("mistle-8x7b").alias("mistle"), F.countDistinct("evaluator").alias("evaluators")), 9)


@query("""WITH r AS (SELECT domain, pair_id, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat_ws(chr(0), 'category', domain, pair_id)), pair_id) AS place
FROM level_results WHERE domain IS NOT NULL) SELECT domain, pair_id, place FROM r WHERE place <= 50""")
def C05_sample_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "domain", "pair_id").filter("domain is not null")
    return cohorts.hash_top(rows, ["domain"], "pair_id", 50, "category", "place")


@query("""WITH u AS (SELECT 'levels' AS wave, id FROM (SELECT DISTINCT id FROM level_results) UNION ALL SELECT 'paired', id FROM (SELECT DISTINCT id FROM paired_items))
SELECT waves, count(*) AS ids FROM (SELECT id, count(*) AS waves FROM u GROUP BY id) GROUP BY waves""")
def C09_union_of_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = lambda name: table(spark, sf_dir, name, "id").distinct()
    both = wave("level_results").unionByName(wave("paired_items")).groupBy("id").agg(F.count("*").alias("waves"))
    return both.groupBy("waves").agg(F.count("*").alias("ids"))


@query(f"""WITH {RATINGS}, {PAIRED}, done AS (SELECT DISTINCT model, domain, id FROM paired), k AS (SELECT model, domain, id, count(r) AS scored, count(*) AS levels FROM ratings GROUP BY 1, 2, 3)
SELECT k.model, k.domain, k.id, CASE WHEN d.id IS NOT NULL THEN 'emitted' WHEN scored = 5 THEN 'new' WHEN scored > 0 THEN 'incomplete' ELSE 'not ready' END AS state
FROM k LEFT JOIN done d ON k.model = d.model AND k.domain = d.domain AND k.id = d.id""")
def C10_eligibility_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = paired(spark, sf_dir).select(*ITEM).distinct().withColumn("done", F.lit(True))
    k = ratings(spark, sf_dir).groupBy(*ITEM).agg(F.count("r").alias("scored")).join(done, ITEM, "left")
    state = F.when(F.col("done"), "emitted").when(F.col("scored") == 5, "new").when(F.col("scored") > 0, "incomplete").otherwise("not ready")
    return k.select(*ITEM, state.alias("state"))


@query(f"""WITH {RATINGS} SELECT model, domain, id, lv, row_number() OVER (PARTITION BY domain, lv ORDER BY r DESC, model, id) AS place FROM ratings WHERE r IS NOT NULL""")
def W03_rank_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).filter("r is not null")
    return stats.places(rows, ["domain", "lv"], [F.desc("r"), F.col("model"), F.col("id")], "place").select(*ITEM, "lv", "place")


@query(f"""WITH {RATINGS} SELECT model, domain, id, lv, round(coalesce(sum(tokens) OVER (PARTITION BY model, domain, id ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS history FROM ratings""")
def W05_running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = W.partitionBy(*ITEM).orderBy("lv").rowsBetween(W.unboundedPreceding, -1)
    return rounded(ratings(spark, sf_dir).select(*ITEM, "lv", F.coalesce(F.sum("tokens").over(before), F.lit(0.0)).alias("history")))


@query(f"""WITH {RATINGS} SELECT model, domain, id, lv, round(rank() OVER (PARTITION BY model, domain, id ORDER BY r) + (count(*) OVER (PARTITION BY model, domain, id, r) - 1) / 2.0, 1) AS midrank
FROM ratings WHERE r IS NOT NULL""")
def W07_ranks_in_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.rank().over(W.partitionBy(*ITEM).orderBy("r")) + (F.count("*").over(W.partitionBy(*ITEM, "r")) - 1) / 2
    return ratings(spark, sf_dir).filter("r is not null").select(*ITEM, "lv", rank.alias("midrank"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pair_id) - 1 AS n FROM level_results WHERE length(trim(prompt)) >= 10 AND domain IS NOT NULL)
SELECT pair_id, domain || '_' || printf('%06d', n) AS loader_id FROM k""")
def S05_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", "domain", "prompt").filter("length(trim(prompt)) >= 10 and domain is not null")
    placed = stats.places(rows.select("pair_id", "domain"), ["domain"], [F.col("pair_id")], "n")
    return placed.select("pair_id", F.concat("domain", F.lit("_"), F.format_string("%06d", F.col("n") - 1)).alias("loader_id"))


@query("""WITH k AS (SELECT delivery_id, stream, row_number() OVER (PARTITION BY stream ORDER BY received_at NULLS LAST, delivery_id) AS place FROM jsonl_rows)
SELECT delivery_id, stream, CASE WHEN place <= 100 THEN 'taken' ELSE 'refused' END AS state FROM k""")
def X02_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jsonl_rows", "delivery_id", "stream", "received_at")
    placed = stats.places(rows, ["stream"], [F.asc_nulls_last("received_at"), F.col("delivery_id")], "place")
    return placed.select("delivery_id", "stream", F.when(F.col("place") <= 100, "taken").otherwise("refused").alias("state"))


@query("""SELECT stream, batch_id, count(*) AS n_rows, min(line_number) AS first_line, max(line_number) AS last_line, CAST(sum(length(raw_value)) AS BIGINT) AS n_chars,
count(*) FILTER (WHERE row_sha256 IS NULL) AS unhashed FROM jsonl_rows GROUP BY 1, 2""")
def S17_batch_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jsonl_rows", "stream", "batch_id", "line_number", "raw_value", "row_sha256")
    return rows.groupBy("stream", "batch_id").agg(
        F.count("*").alias("n_rows"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.sum(F.length("raw_value")).alias("n_chars"),
        F.count_if(F.col("row_sha256").isNull()).alias("unhashed"),
    )


QUERIES, SQL = query.QUERIES, query.SQL
