"""Compression scores (P), geometry (G) of the five levels of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions import codecs, text
from inkgauge.operators import geometry
from inkgauge.plans.base import RATINGS, Register, ratings, rounded
from inkgauge.session import materialized, spread
from inkgauge.sources.tables import table, texts

query = Register()
ITEM = ["generation_model", "domain", "id"]


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, item and level, tokens and the codec profile of every pair, written once."""
    rows = texts(spark, sf_dir, "level_results", "pair_id", *ITEM, "level", "prompt", "output")
    scored = rows.select(
        "pair_id", *ITEM, "level", text.token_count(F.coalesce("output", F.lit(""))).alias("tokens"),
        (F.trim(F.coalesce("prompt", F.lit(""))) != "").alias("has_prompt"), (F.trim(F.coalesce("output", F.lit(""))) != "").alias("has_output"),
        codecs.pair_profile(F.col("output"), F.col("prompt")).alias("profile"),
    )
    return materialized(scored, "profiles")


@query()
def P06_pair_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(spark, sf_dir).select("pair_id", F.inline("profile"))


@query()
def P07_information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pair_scores(spark, sf_dir)
    return rounded(scored.select("pair_id", "tokens", *[c.alias(n) for n, c in codecs.gain(F.col("profile"), F.col("tokens")).items()]))


@query()
def P08_codec_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = pair_scores(spark, sf_dir).select("pair_id", F.inline("profile"))
    ratio = F.coalesce(F.try_divide(F.greatest(F.expr("self_bits - given_bits"), F.lit(0.0)), F.col("self_bits")), F.lit(0.0))
    return rounded(long.select("pair_id", "codec", F.least(ratio, F.lit(1.0)).alias("ratio")))


@query()
def P09_level_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two levels of an item. Rows that repeat the text of their level are one, known by the least pair_id; different
    texts of one level are all compared with those of the other levels. Rows without a level or an output have no distance.
    """
    rows = table(spark, sf_dir, "level_results", *ITEM, "level", "pair_id", "output").filter("level is not null and output is not null")
    first = rows.groupBy(*ITEM, "level", "output").agg(F.min("pair_id").alias("pair_id"))
    sets = first.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("level", "pair_id", "output"))).alias("s"))
    far = codecs.distances_within(F.transform("s", lambda x: x["level"]), F.transform("s", lambda x: x["output"]))
    out = spread(sets).select(*ITEM, F.transform("s", lambda x: F.struct(x["level"].alias("level"), x["pair_id"].alias("pair_id"))).alias("s"), F.explode(far).alias("d"))
    at = lambda i: F.get("s", F.col(f"d.{i}"))
    ends = [at("a")["level"].alias("lv"), at("b")["level"].alias("l2"), at("a")["pair_id"].alias("pair_id"), at("b")["pair_id"].alias("other_id")]
    return rounded(out.select(*ITEM, *ends, F.col("d.distance").alias("distance")))


@query()
def P11_session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair against the mean of the other levels of its item as counterfactuals with a prompt and an output."""
    scored = pair_scores(spark, sf_dir)
    gains = scored.select("pair_id", *ITEM, "level", "has_prompt", "has_output", *[c.alias(n) for n, c in codecs.gain(F.col("profile"), F.col("tokens")).items()])
    valid = gains.filter("has_prompt and has_output").groupBy(*ITEM, "level").agg(F.avg("ratio").alias("cf"))
    sums = valid.groupBy(*ITEM).agg(F.sum("cf").alias("s"), F.count("*").alias("n"))
    joined = gains.join(sums, ITEM, "left").join(valid, [*ITEM, "level"], "left")
    n = F.coalesce("n", F.lit(0)) - F.col("cf").isNotNull().cast("int")
    base = F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)) - F.coalesce("cf", F.lit(0.0)), n), F.lit(0.0))
    excess = F.col("ratio") - F.col("baseline")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    out = joined.select("pair_id", *ITEM, "ratio", n.cast("long").alias("counterfactuals"), base.alias("baseline")).withColumn("excess", excess)
    # The last term is the trajectory of the item's outputs or, if that is less, how the prompts guide them.
    paths = materialized(_paths(spark, sf_dir), "paths")
    same = [out[c].eqNullSafe(paths[c]) for c in ITEM]
    out = out.join(paths, same, "left").select("pair_id", "ratio", "counterfactuals", "baseline", "excess", F.coalesce("path", F.lit(0.0)).alias("path"))
    total = 0.45 * F.col("ratio") + 0.45 * clamp(F.col("excess")) + 0.10 * clamp(F.col("path"))
    return rounded(out.withColumn("composite", clamp(total)))


@query(f"""WITH {RATINGS}, b AS (SELECT model, domain, id, avg(r) AS base, count(r) AS n FROM ratings WHERE r IS NOT NULL GROUP BY 1, 2, 3)
SELECT r.model, r.domain, r.id, r.lv, b.n AS counterfactuals, round(b.base, 9) AS baseline, round(r.r - b.base, 9) AS excess FROM ratings r JOIN b ON r.model = b.model AND r.domain = b.domain AND r.id = b.id WHERE r.r IS NOT NULL""")
def P12_shared_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).filter("r is not null")
    base = rows.groupBy("model", "domain", "id").agg(F.avg("r").alias("baseline"), F.count("r").alias("counterfactuals"))
    joined = rows.join(base, ["model", "domain", "id"])
    return rounded(joined.select("model", "domain", "id", "lv", "counterfactuals", "baseline", F.expr("r - baseline").alias("excess")), 9)


@query(r"""SELECT pair_id, CASE WHEN length(trim(prompt)) >= 20 THEN prompt ELSE 'Write about: ' || array_to_string(list_slice(regexp_extract_all(output, '[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+'), 1, 50), ' ') END AS counterfactual_prompt FROM level_results""")
def P19_counterfactual_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt if it has 20 characters or more, else a template around the first 50 words of the output, in any script;
    null where that is null too.
    """
    rows = table(spark, sf_dir, "level_results", "pair_id", "prompt", "output")
    head = F.array_join(F.slice(text.unicode_split(F.col("output")), 1, 50), " ")
    return rows.select("pair_id", F.when(F.length(F.trim("prompt")) >= 20, F.col("prompt")).otherwise(F.concat(F.lit("Write about: "), head)).alias("counterfactual_prompt"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the texts of its levels in order; of repeated rows the first. At most one per level."""
    rows = table(spark, sf_dir, "level_results", *ITEM, "level", "pair_id", "prompt", "output").filter("level is not null")
    first = rows.groupBy(*ITEM, "level").agg(F.min(F.struct("pair_id", "prompt", "output")).alias("s"))
    out = first.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("level", "s.prompt", "s.output"))).alias("s"))
    out = out.select(*ITEM, F.transform("s", lambda x: x["prompt"]).alias("prompts"), F.transform("s", lambda x: x["output"]).alias("outputs"))
    return spread(out)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the greater of its trajectory's composite and its guidance; the former counts from two texts on."""
    return _sequences(spark, sf_dir).select(*ITEM, geometry.with_path(F.col("prompts"), F.col("outputs")).alias("path"))


@query()
def G01_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sequences(spark, sf_dir).select(*ITEM, geometry.with_trajectory(F.col("outputs")).alias("t"))
    return rounded(out.select(*ITEM, "t.*"))


@query()
def G06_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sequences(spark, sf_dir).select(*ITEM, geometry.with_guidance(F.col("prompts"), F.col("outputs")).alias("guidance")))


@query()
def G08_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "level_results", "pair_id", "prompt", "output").filter("prompt is not null and output is not null")
    v = rows.select("pair_id", geometry.text_vector(F.col("prompt")).alias("p"), geometry.text_vector(F.col("output")).alias("o"))
    return rounded(v.select("pair_id", F.greatest(geometry.cosine(F.col("p"), F.col("o")), F.lit(0.0)).alias("alignment")))


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, range(1, 4096) AS t(i) WHERE i <= len(embedding) GROUP BY 1, 2),
d AS (SELECT e.vec_id, e.label, sum(CAST(e.embedding[m.i] AS DOUBLE) * m.c) AS dot, sqrt(sum(CAST(e.embedding[m.i] AS DOUBLE) * e.embedding[m.i])) AS a, sqrt(sum(m.c * m.c)) AS b
FROM embeddings e JOIN m ON e.label = m.label GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(dot / nullif(a * b, 0)), 6) AS coherence FROM d GROUP BY label""")
def G11_centroid_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"])  # one vector per label
    centres = parts.groupBy("label").agg(ordered.alias("centre"))
    near = rows.join(centres, "label").select("label", geometry.cosine(F.col("embedding").cast("array<double>"), F.col("centre")).alias("s"))
    return rounded(near.groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("coherence")))


@query()
def P04_self_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "level_results", "pair_id", "output")
    return rounded(rows.select("pair_id", codecs.text_bits(F.col("output")).alias("self_bits")))


@query()
def P10_codec_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item and codec the mean ratio of the pairs that have a prompt and an output."""
    long = pair_scores(spark, sf_dir).filter("has_prompt and has_output").select(*ITEM, F.inline("profile"))
    ratio = F.least(F.coalesce(F.try_divide(F.greatest(F.expr("self_bits - given_bits"), F.lit(0.0)), F.col("self_bits")), F.lit(0.0)), F.lit(1.0))
    return rounded(long.groupBy(*ITEM, "codec").agg(F.avg(ratio).alias("baseline"), F.count("*").alias("n")))


@query()
def P16_stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ratio beside the recomputed one."""
    scored = pair_scores(spark, sf_dir)
    stored = table(spark, sf_dir, "level_results", "pair_id", "actual_ratio")
    fresh = scored.select("pair_id", codecs.gain(F.col("profile"), F.col("tokens"))["ratio"].alias("ratio"))
    return rounded(stored.join(fresh, "pair_id").withColumn("gap", F.expr("ratio - actual_ratio")))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the trajectory of the vectors of its outputs and the mean alignment of prompts and outputs."""
    return _sequences(spark, sf_dir).select(*ITEM, geometry.with_vector_trajectory(F.col("outputs")).alias("t"), geometry.with_alignment(F.col("prompts"), F.col("outputs")).alias("alignment"))


@query()
def G07_vector_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_embedded(spark, sf_dir).select(*ITEM, "t.*"))


@query()
def G09_hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.55 ratio + 0.20 alignment of the pair + 0.15 alignment of the item's exchanges + 0.10 its vector trajectory.

    What is not known counts as 0; weights stay as they are.
    """
    scored = pair_scores(spark, sf_dir).select("pair_id", *ITEM, codecs.gain(F.col("profile"), F.col("tokens"))["ratio"].alias("ratio"))
    own = G08_alignment(spark, sf_dir)
    item = materialized(_embedded(spark, sf_dir).select(*ITEM, F.when(F.col("t.turn_count") >= 2, F.col("t.composite")).alias("trajectory"), F.col("alignment").alias("guidance")), "embedded")
    same = [scored[c].eqNullSafe(item[c]) for c in ITEM]
    joined = scored.join(item, same, "left").select("pair_id", "ratio", "trajectory", "guidance").join(own, "pair_id", "left").fillna(0.0, ["alignment", "guidance", "trajectory"])
    hybrid = 0.55 * F.col("ratio") + 0.20 * F.col("alignment") + 0.15 * F.col("guidance") + 0.10 * F.col("trajectory")
    return rounded(joined.withColumn("hybrid", F.least(F.greatest(hybrid, F.lit(0.0)), F.lit(1.0))))


QUERIES, SQL = query.QUERIES, query.SQL
