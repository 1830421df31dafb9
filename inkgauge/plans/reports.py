"""Contrasts with counterfactuals, agreement reports, contracts, snapshots and sinks (P, T, A, F, J, C, S, M, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions import codecs, features, stats, text
from inkgauge.operators import cohorts, plugins
from inkgauge.plans.base import ITEMS, PAIRED, RATINGS, Register, items, paired, ratings, rounded
from inkgauge.plans.scoring import ITEM as KEYS
from inkgauge.plans.scoring import pair_scores
from inkgauge.session import materialized, shared_dir
from inkgauge.sources import strict
from inkgauge.sources.tables import table, texts

query = Register()
ITEM = ["model", "domain", "id"]

# --- contrasts with the other levels of an item


@query(f"""WITH {ITEMS}, s AS (SELECT model, domain, id, sum(r) AS s FROM items GROUP BY 1, 2, 3)
SELECT i.model, i.domain, i.id, i.lv, round(i.r, 9) AS ratio, round((s - i.r) / 4, 9) AS baseline, round(i.r - (s - i.r) / 4, 9) AS excess,
abs((i.r - (s - i.r) / 4) - (i.r - (s - i.r) / 4)) <= 1e-9 AND i.r BETWEEN 0 AND 1 AS holds FROM items i JOIN s ON s.model = i.model AND s.domain = i.domain AND s.id = i.id""")
def F01_excess_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess of each level over the mean of the other four, and whether excess + baseline gives the ratio back within 1e-9."""
    item = W.partitionBy(*ITEM)  # five rows
    rows = items(spark, sf_dir).withColumn("baseline", (F.sum("r").over(item) - F.col("r")) / 4)
    rows = rows.withColumn("excess", F.col("r") - F.col("baseline"))
    holds = (F.abs(F.col("excess") + F.col("baseline") - F.col("r")) <= 1e-9) & F.col("r").between(0, 1)
    return rounded(rows.select(*ITEM, "lv", F.col("r").alias("ratio"), "baseline", "excess", holds.alias("holds")), 9)


_CF3 = f"""{ITEMS}, cf AS (SELECT a.model, a.domain, a.id, a.lv, a.r, avg(b.r) AS cf_mean, stddev_samp(b.r) AS cf_sd FROM items a JOIN items b
  ON a.model = b.model AND a.domain = b.domain AND a.id = b.id AND ((b.lv - a.lv + 5) % 5) BETWEEN 1 AND 3 GROUP BY 1, 2, 3, 4, 5)"""


def _cf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of each level with the mean and deviation of the three levels that follow it in a circle."""
    rows = items(spark, sf_dir)
    other = rows.select(*ITEM, F.col("lv").alias("l2"), F.col("r").alias("r2"))
    both = rows.join(other, ITEM).filter(F.pmod(F.col("l2") - F.col("lv"), F.lit(5)).between(1, 3))
    return both.groupBy(*ITEM, "lv", "r").agg(F.avg("r2").alias("cf_mean"), F.stddev_samp("r2").alias("cf_sd"))


@query(f"WITH {_CF3} SELECT model, domain, id, lv, round(r, 6) AS ratio, round(cf_mean, 6) AS cf_mean, round(r - cf_mean, 6) AS contrast FROM cf")
def P17_three_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ratio, mean of three counterfactuals and their contrast."""
    out = _cf3(spark, sf_dir)
    return rounded(out.select(*ITEM, "lv", F.col("r").alias("ratio"), "cf_mean", F.expr("r - cf_mean").alias("contrast")))


def _cf3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, lv, feature, value, cf_mean): the fifteen features and the three codecs' ratios of each level with the means of
    the three levels that follow it in a circle. Of repeated rows the first counts; items without five levels are left out.
    """
    rows = texts(spark, sf_dir, "level_results", "pair_id", *KEYS, "level", "prompt", "output").filter("level is not null and prompt is not null and output is not null")
    first = rows.groupBy(*KEYS, "level").agg(F.min_by(F.struct("prompt", "output"), "pair_id").alias("s"))
    own = first.select(*KEYS, F.substring("level", 2, 8).cast("int").alias("lv"), features.features(F.col("s.prompt"), F.col("s.output")).alias("f"), codecs.pair_profile(F.col("s.output"), F.col("s.prompt")).alias("p"))
    ratio = lambda x: F.least(F.coalesce(F.try_divide(F.greatest(x["self_bits"] - x["given_bits"], F.lit(0.0)), x["self_bits"]), F.lit(0.0)), F.lit(1.0))
    measured = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f.{n}").alias("value")) for n in features.FEATURES])
    by_codec = F.transform("p", lambda x: F.struct(F.concat(F.lit("ratio_"), x["codec"]).alias("feature"), ratio(x).alias("value")))
    own = materialized(own.select(*KEYS, "lv", F.concat(measured, by_codec).alias("values")), "measured")
    sets = own.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("lv", "values"))).alias("m")).filter(F.size("m") == 5)  # five levels
    long = sets.select(*KEYS, "m", F.explode(F.map_keys("m")).alias("lv"))
    at = lambda k: F.try_element_at("m", F.pmod(F.col("lv") - 1 + k, F.lit(5)) + 1)
    three = F.zip_with(F.zip_with(at(1), at(2), lambda a, b: a["value"] + b["value"]), at(3), lambda s, c: (s + c["value"]) / 3)
    both = F.zip_with(at(0), three, lambda a, c: F.struct(a["feature"].alias("feature"), a["value"].alias("value"), c.alias("cf_mean")))
    return long.select(*KEYS, "lv", F.inline(both))


@query()
def P17_feature_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cf3_features(spark, sf_dir)
    return rounded(out.withColumn("contrast", F.expr("value - cf_mean")))


@query()
def A46_contrast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature and estimand (actual or contrast): n, mean, and the correlation with the level label."""
    rows = _cf3_features(spark, sf_dir)
    both = F.array(F.struct(F.lit("actual").alias("estimand"), F.col("value").alias("v")), F.struct(F.lit("contrast").alias("estimand"), F.expr("value - cf_mean").alias("v")))
    long = rows.select("feature", (6.0 - F.col("lv")).alias("label"), F.inline(both)).groupBy("feature", "estimand")
    return rounded(long.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), stats.pearson("v", "label").alias("r_label")))


@query(f"""WITH {_CF3}, s AS (SELECT a.lv, ((b.lv - a.lv + 5) % 5) AS slot, a.r, b.r AS cf FROM items a JOIN items b ON a.model = b.model AND a.domain = b.domain AND a.id = b.id AND a.lv <> b.lv)
SELECT lv, CAST(slot AS INTEGER) AS slot, count(*) AS n, round(avg(cf), 6) AS mean, round(stddev_samp(cf), 6) AS sd, round(covar_pop(r, cf) / nullif(stddev_pop(r) * stddev_pop(cf), 0), 6) AS r_actual FROM s GROUP BY 1, 2""")
def A39_slot_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level and counterfactual slot (steps ahead in the circle of levels): mean, deviation, and correlation with the actual."""
    rows = items(spark, sf_dir)
    other = rows.select(*ITEM, F.col("lv").alias("l2"), F.col("r").alias("cf"))
    slots = rows.join(other, ITEM).filter("lv <> l2").withColumn("slot", F.pmod(F.col("l2") - F.col("lv"), F.lit(5)))
    return rounded(slots.groupBy("lv", "slot").agg(F.count("*").alias("n"), F.avg("cf").alias("mean"), F.stddev_samp("cf").alias("sd"), stats.pearson("r", "cf").alias("r_actual")))


@query()
def A45_codec_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per codec, over all levels and by level: count, mean, deviation and quartiles of the ratio."""
    long = pair_scores(spark, sf_dir).filter("has_prompt and has_output").select("level", F.inline("profile"))
    ratio = F.least(F.coalesce(F.try_divide(F.greatest(F.expr("self_bits - given_bits"), F.lit(0.0)), F.col("self_bits")), F.lit(0.0)), F.lit(1.0))
    both = long.select("codec", F.explode(F.array("level", F.lit("all"))).alias("level"), ratio.alias("ratio"))
    return rounded(stats.describe(materialized(both, "ratios"), ["codec", "level"], "ratio"))


@query()
def P10_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the mean gain, ratio and gain per token of its valid pairs; zeros for an item without one."""
    scored = pair_scores(spark, sf_dir)
    valid = F.col("has_prompt") & F.col("has_output")
    names = {"gain": "mean_gain", "ratio": "mean_ratio", "gain_per_token": "mean_gain_per_token"}
    gains = scored.select(*KEYS, valid.alias("valid"), *[c.alias(n) for n, c in codecs.gain(F.col("profile"), F.col("tokens")).items() if n in names])
    means = [F.coalesce(F.avg(F.when(F.col("valid"), F.col(n))), F.lit(0.0)).alias(to) for n, to in names.items()]
    return rounded(gains.groupBy(*KEYS).agg(F.count_if("valid").alias("n"), *means))


@query()
def F13_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain the stored ratios that a recomputation gives back exactly, within 1e-9, and not."""
    scored = pair_scores(spark, sf_dir).select("pair_id", codecs.gain(F.col("profile"), F.col("tokens"))["ratio"].alias("ratio"))
    stored = table(spark, sf_dir, "level_results", "pair_id", "domain", "actual_ratio").filter("actual_ratio is not null")
    gap = F.abs(F.col("ratio") - F.col("actual_ratio"))
    joined = stored.join(scored, "pair_id").groupBy("domain")
    return joined.agg(F.count("*").alias("n"), F.count_if(gap == 0).alias("exact"), F.count_if(gap <= 1e-9).alias("near"), F.count_if(gap > 1e-9).alias("differs"))


@query(f"""WITH {ITEMS}, l AS (SELECT i.model, i.domain, i.id, i.lv, i.r, avg(i.r) OVER (PARTITION BY i.model, i.domain, i.id) AS base FROM items i),
c AS (SELECT generation_model AS model, domain, id, level, min(pair_id) AS pair_id, arg_min(prompt, pair_id) AS prompt, arg_min(output, pair_id) AS output FROM level_results WHERE prompt IS NOT NULL AND output IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT c.pair_id, left(c.prompt, 500) AS cf_prompt, left(c.output, 500) AS cf_output, round(l.r, 6) AS ratio, round(l.base, 6) AS baseline, round(l.r - l.base, 6) AS excess
FROM c JOIN l ON c.model = l.model AND c.domain = l.domain AND c.id = l.id AND CAST(substr(c.level, 2) AS INTEGER) = l.lv""")
def P18_contribution_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of scored pairs, with texts of at most 500 characters as the format has them."""
    rows = items(spark, sf_dir).withColumn("base", F.avg("r").over(W.partitionBy(*ITEM)))
    pairs = table(spark, sf_dir, "level_results", "pair_id", *KEYS, "level", "prompt", "output").filter("prompt is not null and output is not null")
    pairs = pairs.groupBy(F.col("generation_model").alias("model"), "domain", "id", F.substring("level", 2, 8).cast("int").alias("lv")).agg(F.min(F.struct("pair_id", F.left("prompt", F.lit(500)).alias("p"), F.left("output", F.lit(500)).alias("o"))).alias("s"))
    joined = pairs.join(rows, [*ITEM, "lv"])
    return rounded(joined.select("s.pair_id", F.col("s.p").alias("cf_prompt"), F.col("s.o").alias("cf_output"), F.col("r").alias("ratio"), F.col("base").alias("baseline"), F.expr("r - base").alias("excess")))


@query()
def P13_sampled_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual prompts from a sampler, scored against the pair's own: here the built-in sampler of templates."""
    rows = texts(spark, sf_dir, "level_results", "pair_id", "prompt", "output").filter("prompt is not null and output is not null")
    drawn = plugins.with_sampler(rows, plugins.template_sampler)
    scored = drawn.select("pair_id", "slot", text.token_count(F.col("cf_output")).alias("tokens"), codecs.pair_profile(F.col("cf_output"), F.col("cf_prompt")).alias("p"))
    ratio = codecs.gain(F.col("p"), F.col("tokens"))["ratio"]
    return rounded(scored.groupBy("pair_id").agg(F.count("*").alias("samples"), F.avg(ratio).alias("baseline")))


# --- texts and judges


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(features.FEATURES)) + ") AS t(place, feature)")
def T10_feature_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the features, which is part of their protocol."""
    return spark.createDataFrame(list(enumerate(features.FEATURES)), "place int, feature string")


@query(r"""WITH l AS (SELECT pair_id, contains(output, '```') AS fence, list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM level_results WHERE output IS NOT NULL),
p AS (SELECT pair_id, fence, len(l) AS n, list_transform(l, lambda x: regexp_extract(x, '^(\d+)[.)]\s+', 1)) AS k, list_transform(l, lambda x: lower(trim(regexp_replace(x, '^\d+[.)]\s+', '')))) AS t FROM l)
SELECT pair_id, CASE WHEN fence THEN 'code fence' WHEN n <> 5 THEN 'not five lines' WHEN k <> ['1', '2', '3', '4', '5'] THEN 'not numbered 1 to 5'
WHEN len(list_filter(t, lambda x: length(x) < 10)) > 0 THEN 'too short' WHEN len(list_distinct(t)) <> 5 THEN 'repeated' ELSE 'accepted' END AS verdict FROM p""")
def T20_five_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs read strictly as five different prompts of ten characters or more, numbered 1 to 5, and nothing else."""
    rows = table(spark, sf_dir, "level_results", "pair_id", "output").filter("output is not null")
    lines = F.filter(F.transform(F.split("output", "\n"), lambda x: text.strip(x)), lambda x: x != "")
    rows = rows.select("pair_id", F.contains("output", F.lit("```")).alias("fence"), lines.alias("l"))
    k = F.transform("l", lambda x: F.regexp_extract(x, r"^(\d+)[.)]\s+", 1))
    t = F.transform("l", lambda x: F.lower(F.trim(F.regexp_replace(x, r"^\d+[.)]\s+", ""))))
    verdict = (
        F.when(F.col("fence"), "code fence").when(F.size("l") != 5, "not five lines").when(k != F.array(*map(F.lit, "12345")), "not numbered 1 to 5")
        .when(F.exists(t, lambda x: F.length(x) < 10), "too short").when(F.size(F.array_distinct(t)) != 5, "repeated").otherwise("accepted")
    )
    return rows.select("pair_id", verdict.alias("verdict"))


#: Categories of prompts by their number from 1 (fixed values).
CATEGORIES = ("Creative", "Editing", "Coding", "Factual", "Advice", "Other")
_NAMED = " ".join(f"WHEN contains(lower(answer), '{c.lower()}') THEN {i}" for i, c in enumerate(CATEGORIES, 1))


@query(f"""WITH a AS (SELECT delivery_id, CASE WHEN delivery_id % 2 = 0 THEN 'Category: ' || json_extract_string(raw_value, '$.category') ELSE json_extract_string(raw_value, '$.level') || '.' END AS answer FROM jsonl_rows)
SELECT delivery_id, CAST(CASE WHEN regexp_extract(answer, '[1-6]') <> '' THEN CAST(regexp_extract(answer, '[1-6]') AS INTEGER) {_NAMED} END AS INTEGER) AS category FROM a WHERE answer IS NOT NULL""")
def T21_category_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a classifier read as a category: the first digit from 1 to 6, else the first category that is named.

    Half of the answers are taken from the stored category's name, half from a number.
    """
    part = lambda name: F.get_json_object("raw_value", f"$.{name}")
    answer = F.when(F.col("delivery_id") % 2 == 0, F.concat(F.lit("Category: "), part("category"))).otherwise(F.concat(part("level"), F.lit(".")))
    rows = table(spark, sf_dir, "jsonl_rows", "delivery_id", "raw_value").select("delivery_id", answer.alias("answer")).filter("answer is not null")
    digit = F.regexp_extract("answer", "[1-6]", 0)
    out = F.when(digit != "", F.expr("try_cast(regexp_extract(answer, '[1-6]', 0) as int)"))
    for i, name in enumerate(CATEGORIES, 1):
        out = out.when(F.contains(F.lower("answer"), F.lit(name.lower())), i)
    return rows.select("delivery_id", out.alias("category"))


@query("""WITH t AS (SELECT delivery_id, json_extract_string(raw_value, '$.topic') AS topic, json_extract_string(raw_value, '$.category') AS category FROM jsonl_rows),
c AS (SELECT topic, category, count(*) AS n FROM t WHERE topic IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2), m AS (SELECT topic, arg_max(category, (n, category)) AS usual FROM c GROUP BY 1)
SELECT t.delivery_id, m.usual AS category, m.usual IS NULL AS needs_model FROM t LEFT JOIN m ON m.topic = t.topic""")
def T22_topic_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual category of each row's topic; rows without a known topic need a model."""
    part = lambda name: F.get_json_object("raw_value", f"$.{name}")
    t = table(spark, sf_dir, "jsonl_rows", "delivery_id", "raw_value").select("delivery_id", part("topic").alias("topic"), part("category").alias("category"))
    c = t.dropna(subset=["topic", "category"]).groupBy("topic", "category").agg(F.count("*").alias("n"))
    m = c.groupBy("topic").agg(F.max_by("category", F.struct("n", "category")).alias("usual"))
    return t.join(m, "topic", "left").select("delivery_id", F.col("usual").alias("category"), F.col("usual").isNull().alias("needs_model"))


@query("""SELECT delivery_id, sha256(concat_ws(chr(0), 'judge', json_extract_string(raw_value, '$.id'), CAST(delivery_id % 2 AS VARCHAR))) AS request_id,
CASE WHEN NOT json_valid(raw_value) THEN 'no object' WHEN try_cast(json_extract_string(raw_value, '$.level') AS INTEGER) IS NULL THEN 'no label' WHEN try_cast(json_extract_string(raw_value, '$.level') AS INTEGER) NOT BETWEEN 1 AND 5 THEN 'label out of range' ELSE 'accepted' END AS verdict
FROM jsonl_rows WHERE json_extract_string(raw_value, '$.id') IS NOT NULL""")
def T26_judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of each judge request (record and slot) and the strict reading of its response: an object with a label 1 to 5."""
    part = lambda name: F.get_json_object("raw_value", f"$.{name}")
    rows = table(spark, sf_dir, "jsonl_rows", "delivery_id", "raw_value").filter(part("id").isNotNull())
    label = part("level").try_cast("int")
    verdict = F.when(label.isNull(), "no label").when(~label.between(1, 5), "label out of range").otherwise("accepted")
    slot = (F.col("delivery_id") % 2).cast("string")
    return rows.select("delivery_id", F.sha2(F.concat_ws("\0", F.lit("judge"), part("id"), slot), 256).alias("request_id"), verdict.alias("verdict"))


# --- agreement

_R = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
_MATRIX = ("r", "chars", "tokens", "phi_a", "phi_b", "act_a")
_PAIRS = [(a, b) for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1 :]]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda e, c: F.avg(F.when(F.col("evaluator") == e, F.col(c)))
    scores = paired(spark, sf_dir).groupBy(*ITEM, "lv").agg(by("lark-8b", "phi").alias("phi_a"), by("mistle-8x7b", "phi").alias("phi_b"), by("lark-8b", "act").alias("act_a"))
    return ratings(spark, sf_dir).join(scores, [*ITEM, "lv"]).dropna(subset=list(_MATRIX))


_WIDE = f"""{RATINGS}, {PAIRED}, w AS (SELECT r.*, s.phi_a, s.phi_b, s.act_a FROM ratings r JOIN (SELECT model, domain, id, lv, avg(CASE WHEN evaluator = 'lark-8b' THEN phi END) AS phi_a,
  avg(CASE WHEN evaluator = 'mistle-8x7b' THEN phi END) AS phi_b, avg(CASE WHEN evaluator = 'lark-8b' THEN act END) AS act_a FROM paired GROUP BY 1, 2, 3, 4) s
  ON s.model = r.model AND s.domain = r.domain AND s.id = r.id AND s.lv = r.lv WHERE r.r IS NOT NULL AND r.chars IS NOT NULL AND r.tokens IS NOT NULL AND s.phi_a IS NOT NULL AND s.phi_b IS NOT NULL AND s.act_a IS NOT NULL)"""


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round({_R.format(a, b)}, 6) AS r FROM w" for a, b in _PAIRS))
def A08_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r of every two score columns, from one aggregation."""
    sums = _wide(spark, sf_dir).agg(F.count("*").alias("n"), *[stats.pearson(a, b).alias(f"{a}__{b}") for a, b in _PAIRS])
    long = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in _PAIRS])
    return rounded(sums.select("n", F.inline(long)).select("a", "b", "n", "r"))


_ALPHA = "1 - (sum((phi - act) * (phi - act)) / count(*)) / nullif(2 * (2 * count(*) * sum(phi * phi + act * act) - sum(phi + act) * sum(phi + act)) / (2.0 * count(*) * (2 * count(*) - 1)), 0)"


@query(f"""WITH {PAIRED} SELECT evaluator, model, domain, lv, CAST(grouping(model) * 4 + grouping(domain) * 2 + grouping(lv) AS INTEGER) AS scope, count(*) AS n, round({_R.format('phi', 'act')}, 9) AS r,
round({_ALPHA}, 9) AS alpha, round(1 - (1 - {_R.format('phi', 'act')}) * (2.0 * count(*) - 1) / (2.0 * count(*)), 9) AS alpha_z, round(avg(act - phi), 9) AS bias, round(avg(abs(act - phi)), 9) AS mae,
round(sqrt(avg((act - phi) * (act - phi))), 9) AS rmse FROM paired GROUP BY GROUPING SETS ((evaluator), (evaluator, model), (evaluator, domain), (evaluator, lv), (evaluator, model, domain))""")
def A28_agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-box against black-box scores: correlation, alpha, bias and errors over all pairs and by model, domain and level (A29)."""
    rows = paired(spark, sf_dir)
    sets = [(), ("model",), ("domain",), ("lv",), ("model", "domain")]
    flags = F.array(*[F.struct(F.lit(sum(v for k, v in (("model", 4), ("domain", 2), ("lv", 1)) if k not in s)).alias("scope"), *[(F.col(k) if k in s else F.lit(None).cast(t)).alias(f"_{k}") for k, t in (("model", "string"), ("domain", "string"), ("lv", "int"))]) for s in sets])
    long = rows.select("evaluator", "phi", "act", F.inline(flags)).groupBy("evaluator", F.col("_model").alias("model"), F.col("_domain").alias("domain"), F.col("_lv").alias("lv"), "scope")
    gap = F.expr("act - phi")
    n = F.count("*")
    out = long.agg(n.alias("n"), stats.pearson("phi", "act").alias("r"), stats.alpha("phi", "act").alias("alpha"), stats.alpha_z(stats.pearson("phi", "act"), n).alias("alpha_z"), F.avg(gap).alias("bias"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return rounded(out, 9)


@query(f"""WITH {_WIDE} SELECT model, domain, count(*) AS n, round({_R.format('r', 'phi_a')}, 6) AS r_phi, round({_R.format('tokens', 'phi_a')}, 6) AS tokens_phi, round({_R.format('chars', 'r')}, 6) AS chars_r FROM w GROUP BY 1, 2""")
def A29_secondary_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model and domain: ratio and white-box score, and what each has to do with length."""
    rows = _wide(spark, sf_dir).groupBy("model", "domain")
    return rounded(rows.agg(F.count("*").alias("n"), stats.pearson("r", "phi_a").alias("r_phi"), stats.pearson("tokens", "phi_a").alias("tokens_phi"), stats.pearson("chars", "r").alias("chars_r")))


_DECILES = [k / 10 for k in range(1, 10)]


@query(f"""WITH {ITEMS}, z AS (SELECT *, coalesce((r - avg(r) OVER (PARTITION BY lv)) / nullif(stddev_pop(r) OVER (PARTITION BY lv), 0), 0) AS z FROM items),
d AS (SELECT lv, quantile_cont(r, {_DECILES}) AS q FROM items GROUP BY lv), b AS (SELECT z.*, CAST(len(list_filter(d.q, lambda t: z.r >= t)) AS DOUBLE) AS bin FROM z JOIN d ON z.lv = d.lv),
u AS (SELECT model, domain, id, sum(r) AS s1, sum(r * r) AS q1, sum(z) AS s2, sum(z * z) AS q2, sum(bin) AS s3, sum(bin * bin) AS q3 FROM b GROUP BY 1, 2, 3)
SELECT count(*) AS n_items, {', '.join(f"round(1 - (2 * sum(5 * q{i} - s{i} * s{i}) / (4.0 * 5 * count(*))) / nullif(2 * (5 * count(*) * sum(q{i}) - sum(s{i}) * sum(s{i})) / (5.0 * count(*) * (5 * count(*) - 1)), 0), 6) AS {n}" for i, n in ((1, 'alpha_raw'), (2, 'alpha_z'), (3, 'alpha_binned')))} FROM u""")
def A21_pseudo_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha with the five levels of an item as raters, on raw values, values standardized by level, and their deciles."""
    rows = materialized(items(spark, sf_dir), "items")
    by_level = rows.groupBy("lv").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    edges = stats.quantiles(rows, ["lv"], "r", {f"_q{i}": q for i, q in enumerate(_DECILES)})
    z = rows.join(F.broadcast(by_level), "lv").join(F.broadcast(edges), "lv")  # five levels
    bin_ = F.size(F.filter(F.array(*[f"_q{i}" for i in range(9)]), lambda t: F.col("r") >= t)).cast("double")
    z = z.select(*ITEM, "r", F.coalesce(F.try_divide(F.expr("r - m"), F.col("s")), F.lit(0.0)).alias("z"), bin_.alias("bin"))
    sums = [f(F.col(c)).alias(f"{p}_{c}") for c in ("r", "z", "bin") for p, f in (("s", F.sum), ("q", lambda x: F.sum(x * x)))]
    u = z.groupBy(*ITEM).agg(*sums)
    return rounded(u.agg(F.count("*").alias("n_items"), *[stats.alpha_of(5, F.col(f"s_{c}"), F.col(f"q_{c}")).alias(name) for c, name in (("r", "alpha_raw"), ("z", "alpha_z"), ("bin", "alpha_binned"))]))


@query(f"""WITH {PAIRED}, s AS (SELECT paired_id, count(*) AS k, sum(phi) AS s FROM paired GROUP BY 1)
SELECT p.paired_id, p.lv, round(p.phi, 9) AS phi, round((s.s - p.phi) / (s.k - 1), 9) AS cf_mean, round(p.phi - (s.s - p.phi) / (s.k - 1), 9) AS phi_excess FROM paired p JOIN s ON s.paired_id = p.paired_id WHERE s.k >= 4""")
def M06_phi_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-box score of each level, the mean of the item's other levels as counterfactuals (three at least), and the excess."""
    item = W.partitionBy("paired_id")  # five rows
    rows = paired(spark, sf_dir).withColumns({"k": F.count("*").over(item), "s": F.sum("phi").over(item)}).filter("k >= 4")
    rows = rows.withColumn("cf_mean", (F.col("s") - F.col("phi")) / (F.col("k") - 1))
    return rounded(rows.select("paired_id", "lv", "phi", "cf_mean", F.expr("phi - cf_mean").alias("phi_excess")), 9)


# --- contracts, joins and snapshots


@query(f"""WITH {PAIRED} SELECT paired_id, count(*) AS levels, count(*) FILTER (WHERE isnan(phi) OR isinf(phi) OR isnan(act) OR isinf(act)) AS not_finite, bool_and(phi BETWEEN -1 AND 1 AND act BETWEEN 0 AND 1) AS in_range FROM paired GROUP BY 1""")
def S06_ledger_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ledger item: levels with both scores (five are due), scores that are not finite (F09), and whether all are in range."""
    rows = paired(spark, sf_dir)
    odd = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return rows.groupBy("paired_id").agg(F.count("*").alias("levels"), F.count_if(odd("phi") | odd("act")).alias("not_finite"), F.bool_and(F.col("phi").between(-1, 1) & F.col("act").between(0, 1)).alias("in_range"))


#: Parts of column names that a released table may not have (fixed values).
FORBIDDEN = ("email", "phone", "password", "token_secret", "api_key", "user_name")


@query("SELECT column_name AS column, " + " OR ".join(f"contains(lower(column_name), '{w}')" for w in FORBIDDEN) + " AS forbidden FROM (DESCRIBE level_results)")
def F09_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the level table and whether their names give away an identifier."""
    names = table(spark, sf_dir, "level_results").columns
    return spark.createDataFrame([(c, any(w in c.lower() for w in FORBIDDEN)) for c in names], "column string, forbidden boolean")


@query("""SELECT generation_model AS model, domain, count(*) AS n_rows, count(*) FILTER (WHERE output IS NOT NULL AND length(trim(output)) >= 10 AND actual_ratio BETWEEN 0 AND 1 AND level IN ('L1', 'L2', 'L3', 'L4', 'L5')) AS legal FROM level_results GROUP BY 1, 2""")
def S07_legal_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and domain the result rows, and those that are legal: a level, a text and a ratio between 0 and 1."""
    rows = table(spark, sf_dir, "level_results", "generation_model", "domain", "level", "output", "actual_ratio")
    legal = F.col("output").isNotNull() & (F.length(text.strip(F.col("output"))) >= 10) & F.col("actual_ratio").between(0, 1) & F.col("level").isin("L1", "L2", "L3", "L4", "L5")
    return rows.groupBy(F.col("generation_model").alias("model"), "domain").agg(F.count("*").alias("n_rows"), F.count_if(legal).alias("legal"))


@query(f"WITH {RATINGS} SELECT count(*) AS n_rows, 0 AS missing, 0 AS added FROM ratings")
def S08_csv_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings written as CSV and read back: rows, rows that the cache lacks, and rows that it has besides."""
    rows = ratings(spark, sf_dir).select(*ITEM, "lv", F.round("r", 9).alias("r"))
    cache = strict.csv_cache(rows, f"{shared_dir(spark)}/inkgauge-cache")
    key = lambda df: df.select(F.sha2(F.to_json(F.struct("*")), 256).alias("h"))
    both = key(rows).withColumn("side", F.lit(1)).unionByName(key(cache).withColumn("side", F.lit(-1))).groupBy("h").agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("n"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).cast("int").alias("missing"), F.coalesce(-F.sum(F.least("d", F.lit(0))), F.lit(0)).cast("int").alias("added"))


@query(f"""WITH {RATINGS} SELECT '| ' || model || ' | ' || domain || ' | ' || CAST(count(r) AS VARCHAR) || ' | ' || printf('%.4f', avg(r)) || ' |' AS line FROM ratings WHERE model IS NOT NULL AND domain IS NOT NULL GROUP BY model, domain""")
def S11_markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a Markdown table: model, domain, count and mean ratio."""
    rows = ratings(spark, sf_dir).filter("model is not null and domain is not null").groupBy("model", "domain").agg(F.count("r").alias("n"), F.format_string("%.4f", F.avg("r")).alias("mean"))
    return rows.select(strict.markdown("model", "domain", "n", "mean").alias("line"))


@query()
def S19_prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions as one JSON line per pair, streamed to files and read back."""
    from inkgauge.plans.modelling import M01_out_of_fold

    return strict.json_sink(M01_out_of_fold(spark, sf_dir), f"{shared_dir(spark)}/inkgauge-oof")


@query()
def S18_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' files as their manifest names them, each with whether size and hash still agree."""
    manifest = materialized(strict.inventory(spark, sf_dir), "manifest")
    checked = strict.checked_manifest(spark, sf_dir, manifest)
    return checked.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "verified")


_STRATA = f"""{RATINGS}, cell AS (SELECT model, domain, id, lv, r, row_number() OVER (PARTITION BY model, domain ORDER BY r DESC, id, lv) - 1 AS k,
  count(*) OVER (PARTITION BY model, domain) AS n FROM ratings WHERE r IS NOT NULL),
strata AS (SELECT *, CAST(CASE WHEN n < 5 THEN 5 ELSE least(floor(k / floor(n / 5)), 4) + 1 END AS INTEGER) AS stratum FROM cell)"""


@query(f"""WITH {_STRATA} SELECT l.pair_id, s.stratum AS label, s.stratum <> CAST(substr(l.level, 2) AS INTEGER) AS changed FROM level_results l
JOIN strata s ON s.model = l.generation_model AND s.domain = l.domain AND s.id = l.id AND s.lv = CAST(substr(l.level, 2) AS INTEGER)""")
def J03_roster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the label that the roster of strata gives their level, and whether it differs from the level."""
    roster = cohorts.stratify(ratings(spark, sf_dir).filter("r is not null"), ["model", "domain"], "r", ["id", "lv"]).select(*ITEM, "lv", "stratum")
    rows = table(spark, sf_dir, "level_results", "pair_id", *KEYS, "level").withColumnRenamed("generation_model", "model").withColumn("lv", F.substring("level", 2, 8).cast("int"))
    return rows.join(roster, [*ITEM, "lv"]).select("pair_id", F.col("stratum").alias("label"), F.expr("stratum <> lv").alias("changed"))


@query("""SELECT p.paired_id, count(*) AS level_rows, round(avg(l.actual_ratio), 9) AS mean_ratio FROM paired_items p JOIN level_results l ON l.generation_model = p.generation_model AND l.domain = lower(trim(p.domain)) AND l.id = p.id
WHERE p.source_cluster_fingerprint IS NULL OR p.source_cluster_fingerprint = 'legacy-id-fallback' GROUP BY 1""")
def J11_legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy items, known by no fingerprint, joined with their level rows by identifier alone."""
    old = table(spark, sf_dir, "paired_items", "paired_id", *KEYS, "source_cluster_fingerprint")
    old = old.filter("source_cluster_fingerprint is null or source_cluster_fingerprint = 'legacy-id-fallback'")
    old = old.select("paired_id", F.col("generation_model").alias("model"), F.lower(F.trim("domain")).alias("domain"), "id")
    rows = table(spark, sf_dir, "level_results", *KEYS, "actual_ratio").withColumnRenamed("generation_model", "model")
    per_item = rows.groupBy(*ITEM).agg(F.count("*").alias("level_rows"), F.sum("actual_ratio").alias("s"), F.count("actual_ratio").alias("k"))
    return rounded(old.join(per_item, ITEM).select("paired_id", "level_rows", F.try_divide("s", "k").alias("mean_ratio")), 9)


@query("""WITH c AS (SELECT domain, id FROM level_results WHERE domain IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT generation_model) >= 2),
s AS (SELECT domain, id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat_ws(chr(0), 'snapshot', domain, id)), id) AS k FROM c) WHERE k <= 200)
SELECT l.pair_id, l.generation_model AS model, l.domain, l.id, l.level, s.id IS NOT NULL AS selected FROM level_results l LEFT JOIN s ON s.domain = l.domain AND s.id = l.id WHERE l.level IS NOT NULL""")
def C15_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level rows of the full cohort, marked if their source is in the selected one."""
    rows = table(spark, sf_dir, "level_results", "pair_id", *KEYS, "level")
    common = rows.filter("domain is not null and id is not null").groupBy("domain", "id").agg(F.countDistinct("generation_model").alias("n")).filter("n >= 2")
    chosen = cohorts.hash_top(common, ["domain"], "id", 200, "snapshot", "place").select("domain", "id", F.lit(True).alias("selected"))
    out = rows.filter("level is not null").join(chosen, ["domain", "id"], "left")
    return out.select("pair_id", F.col("generation_model").alias("model"), "domain", "id", "level", F.coalesce("selected", F.lit(False)).alias("selected"))


@query("""WITH o AS (SELECT stream, line_number, delivery_id, row_sha256, raw_value, lag(row_sha256) OVER (PARTITION BY stream, json_extract_string(raw_value, '$.id') ORDER BY received_at NULLS LAST, delivery_id) AS earlier,
  row_number() OVER (PARTITION BY stream, json_extract_string(raw_value, '$.id') ORDER BY received_at NULLS LAST, delivery_id) AS attempt FROM jsonl_rows WHERE json_extract_string(raw_value, '$.id') IS NOT NULL)
SELECT delivery_id, CASE WHEN row_sha256 IS NULL THEN 'outcome_unknown' WHEN attempt = 1 THEN 'adopted' WHEN lower(row_sha256) = lower(earlier) THEN 'replayed' ELSE 'rejected' END AS state FROM o""")
def X05_call_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each call of a stream, in order: the first response is adopted, the same one again is replayed, another is rejected,
    and a call whose response was never hashed has an unknown outcome.
    """
    rows = table(spark, sf_dir, "jsonl_rows", "delivery_id", "stream", "raw_value", "row_sha256", "received_at")
    rows = rows.withColumn("call", F.get_json_object("raw_value", "$.id")).filter("call is not null")
    order = W.partitionBy("stream", "call").orderBy(F.asc_nulls_last("received_at"), "delivery_id")  # the attempts of one call
    rows = rows.withColumns({"earlier": F.lag("row_sha256").over(order), "attempt": F.row_number().over(order)})
    state = F.when(F.col("row_sha256").isNull(), "outcome_unknown").when(F.col("attempt") == 1, "adopted").when(F.lower("row_sha256") == F.lower("earlier"), "replayed").otherwise("rejected")
    return rows.select("delivery_id", state.alias("state"))


QUERIES, SQL = query.QUERIES, query.SQL
