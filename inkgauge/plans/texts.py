"""Text functions and surface features (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.functions import features, text
from inkgauge.functions.unicode import folded, surface
from inkgauge.operators import delivery
from inkgauge.plans.base import Register, rounded
from inkgauge.sources.tables import table, texts

query = Register()


def _pairs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return texts(spark, sf_dir, "level_results", "pair_id", "prompt", "output", *more)


#: White space beyond RE2's own \\s, for the SQL.
_SPACE = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"


@query(rf"""SELECT pair_id, CAST(len(regexp_extract_all(output, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]')) AS INTEGER) AS tokens FROM level_results""")
def T01_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every output, in any script; null for null."""
    return _pairs(spark, sf_dir).select("pair_id", text.token_count(F.col("output")).alias("tokens"))


_form = lambda c: rf"trim(regexp_replace(replace(lower(nfc_normalize(coalesce({c}, ''))), 'ß', 'ss'), '[{_SPACE}]+', ' ', 'g'))"


@query(f"SELECT pair_id, CASE WHEN output IS NOT NULL THEN sha256({_form('output')}) END AS surface_sha256 FROM level_results")
def T02_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair_id", F.sha2(surface(F.col("output")), 256).alias("surface_sha256"))


_W = r"regexp_extract_all(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


@query(f"""WITH w AS (SELECT pair_id, {_W.format('prompt')} AS p, {_W.format('output')} AS o FROM level_results WHERE prompt IS NOT NULL AND output IS NOT NULL)
SELECT pair_id, CAST(len(o) AS INTEGER) AS words, CASE WHEN len(o) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct(o), list_distinct(p))) / CAST(len(list_distinct(o)) AS DOUBLE), 6) END AS coverage,
CASE WHEN len(o) = 0 THEN 0.0 ELSE round(len(list_distinct(o)) / CAST(len(o) AS DOUBLE), 6) END AS type_token_ratio FROM w""")
def T07_word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).filter("prompt is not null and output is not null")
    w = rows.select("pair_id", text.words(F.col("prompt")).alias("p"), text.words(F.col("output")).alias("o"))
    out = w.select(
        "pair_id", F.size("o").alias("words"), text.type_containment(F.col("o"), F.col("p")).alias("coverage"), text.type_token_ratio(F.col("o")).alias("type_token_ratio")
    )
    return rounded(out)


@query(f"""WITH w AS (SELECT pair_id, {_W.format('output')} AS o FROM level_results WHERE output IS NOT NULL),
g AS (SELECT pair_id, list_transform(range(1, greatest(len(o), 1)), lambda i: o[i] || ' ' || o[i + 1]) AS g FROM w)
SELECT pair_id, CAST(len(g) AS INTEGER) AS bigrams, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(g)) / CAST(len(g) AS DOUBLE), 6) END AS repeated FROM g""")
def T04_bigram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _pairs(spark, sf_dir).filter("output is not null").select("pair_id", text.words(F.col("output")).alias("o"))
    g = w.select("pair_id", text.ngrams(F.col("o"), 2).alias("g"))
    share = F.when(F.size("g") > 0, 1 - F.size(F.array_distinct("g")) / F.size("g")).otherwise(0.0)
    return rounded(g.select("pair_id", F.size("g").alias("bigrams"), share.alias("repeated")))


def _char_sql(n: int) -> str:
    grams = lambda c: f"SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest(list_transform(range(1, greatest(length({c}) - {n - 2}, 1)), lambda i: substr({c}, i, {n}))) AS g FROM f) GROUP BY 1, 2"
    return f"""o{n} AS ({grams("o")}), p{n} AS ({grams("p")}), c{n} AS (SELECT o{n}.pair_id, sum(least(o{n}.n, coalesce(p{n}.n, 0))) / CAST(sum(o{n}.n) AS DOUBLE) AS c
  FROM o{n} LEFT JOIN p{n} ON o{n}.pair_id = p{n}.pair_id AND o{n}.g = p{n}.g GROUP BY 1)"""


@query(rf"""WITH f AS (SELECT pair_id, {_form("prompt")} AS p, {_form("output")} AS o FROM level_results), {", ".join(map(_char_sql, features.LENGTHS))}
SELECT f.pair_id, {", ".join(f"round(coalesce(c{n}.c, 0), 6) AS char{n}" for n in features.LENGTHS)} FROM f {" ".join(f"LEFT JOIN c{n} ON c{n}.pair_id = f.pair_id" for n in features.LENGTHS)}""")
def T05_char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the character runs of the output's surface form, with repeats, that the prompt's has; 0 for no run."""
    return rounded(_pairs(spark, sf_dir).select("pair_id", features.char_coverage(F.col("prompt"), F.col("output")).alias("c")).select("pair_id", "c.*"))


_EXPLODED = rf"""WITH p AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest({_W.format('prompt')}) AS w FROM level_results) GROUP BY 1, 2),
o AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest({_W.format('output')}) AS w FROM level_results) GROUP BY 1, 2)"""


@query(f"""{_EXPLODED}, c AS (SELECT o.pair_id, sum(o.n) AS words, sum(least(o.n, coalesce(p.n, 0))) / CAST(sum(o.n) AS DOUBLE) AS token_coverage
FROM o LEFT JOIN p ON o.pair_id = p.pair_id AND o.w = p.w GROUP BY o.pair_id)
SELECT l.pair_id, CAST(coalesce(c.words, 0) AS BIGINT) AS words, round(coalesce(c.token_coverage, 0), 6) AS token_coverage FROM level_results l LEFT JOIN c ON c.pair_id = l.pair_id""")
def T06_multiset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the output's words, with repeats, that the prompt has as often; 0 for no words. A null text has none."""
    rows = _pairs(spark, sf_dir).select("pair_id", features.coverage(F.col("prompt"), F.col("output")).alias("c"))
    return rounded(rows.select("pair_id", "c.words", "c.token_coverage"))


@query()
def T09_surface_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("pair_id", features.features(F.col("prompt"), F.col("output")).alias("f"))
    return rounded(rows.select("pair_id", "f.*"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"""WITH w AS (SELECT domain, w, count(*) AS n FROM (SELECT domain, unnest({_W.format('output')}) AS w FROM level_results) WHERE length(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT domain, w AS keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, w) AS k FROM w) WHERE k <= 20""")
def T13_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "domain", "output")
    w = rows.select("domain", F.explode(text.words(F.col("output"))).alias("keyword")).filter((F.length("keyword") >= 3) & ~F.col("keyword").isin(text.STOPWORDS))
    counts = w.groupBy("domain", "keyword").agg(F.count("*").alias("n"))
    order = W.partitionBy("domain").orderBy(F.desc("n"), "keyword")
    return counts.withColumn("k", F.row_number().over(order)).filter("k <= 20").drop("k")


_strip = lambda c: rf"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


@query(rf"""WITH s AS (SELECT pair_id, CASE WHEN regexp_extract(output, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) = '' THEN {_strip('output')} ELSE regexp_extract(output, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) END AS w FROM level_results)
SELECT pair_id, CASE WHEN length(w) > 180 THEN rtrim(left(w, 177)) || '...' ELSE w END AS sentence FROM s""")
def T14_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair_id", text.first_sentence(F.col("output")).alias("sentence"))


@query(r"""WITH k AS (SELECT pair_id, prompt, regexp_extract_all(prompt, '\p{Lu}\p{L}{2,}') AS f FROM level_results),
u AS (SELECT pair_id, prompt, list_filter(f, lambda w, i: list_position(list_transform(f, lambda v: lower(v)), lower(w)) = i) AS f FROM k)
SELECT pair_id, array_to_string(list_slice(CASE WHEN len(f) > 0 THEN f ELSE list_filter(regexp_split_to_array(trim(prompt), '\s+'), lambda w: w <> '') END, 1, 3), ', ') AS keywords FROM u""")
def T15_prompt_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair_id", F.array_join(text.capitalized_keywords(F.col("prompt")), ", ").alias("keywords"))


@query(r"""WITH w AS (SELECT pair_id, output, list_filter(regexp_split_to_array(lower(trim(output)), '\s+'), lambda x: x <> '') AS w FROM level_results)
SELECT pair_id, coalesce(length(trim(output)) >= 10 AND NOT (starts_with(lower(trim(output)), '[error') OR starts_with(lower(trim(output)), 'error:') OR starts_with(lower(trim(output)), 'http error')
OR starts_with(lower(trim(output)), 'exception:') OR starts_with(lower(trim(output)), 'traceback')) AND NOT (len(w) > 20 AND len(list_distinct(w)) < 5), FALSE) AS valid,
coalesce(regexp_matches(output, '[\p{L}\p{N}]'), FALSE) AS linguistic FROM w""")
def T16_output_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("output")
    return _pairs(spark, sf_dir).select("pair_id", text.is_valid_output(o).alias("valid"), text.is_linguistic(o).alias("linguistic"))


@query()
def T18_repetitive_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair_id", text.is_repetitive(F.col("output")).alias("repetitive"))


@query()
def T19_generated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each output is rejected: the rules of text.rejection(), then the same text as an earlier one of its item in NFKC
    form, letter case and white space aside. Earlier is a smaller pair_id; accepted outputs have no reason.
    """
    rows = _pairs(spark, sf_dir, "generation_model", "domain", "id")
    item = ["generation_model", "domain", "id"]
    read = rows.select("pair_id", *item, F.sha2(folded(F.col("output")), 256).alias("form"), text.rejection(F.col("output")).alias("reason"))
    first = read.filter("reason is null").groupBy(*item, "form").agg(F.min("pair_id").alias("first"))
    same = [read[c].eqNullSafe(first[c]) for c in (*item, "form")]
    joined = read.join(first, same, "left").select("pair_id", F.coalesce("reason", F.when(F.col("first") < F.col("pair_id"), "duplicate")).alias("reason"))
    return joined


@query(r"""SELECT pair_id, list_transform(list_filter(string_split(output, chr(10)), lambda x: regexp_matches(x, '^\s*\d+[.)]\s+\S')), lambda x: trim(regexp_replace(x, '^\s*\d+[.)]\s+', ''))) AS items
FROM level_results WHERE regexp_matches(output, '(^|\n)\s*1[.)]\s+\S')""")
def T20_numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).filter(F.col("output").rlike(r"(^|\n)\s*1[.)]\s+\S"))
    return rows.select("pair_id", text.numbered_items(F.col("output")).alias("items"))


_CLASSES = " ".join(f"WHEN regexp_matches(lower(raw_value), '{pattern}') THEN '{name}'" for name, pattern in text.ERRORS)


@query(f"""SELECT delivery_id, CASE WHEN raw_value IS NULL THEN NULL {_CLASSES} ELSE 'other' END AS error_class FROM jsonl_rows""")
def T23_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jsonl_rows", "delivery_id", "raw_value").select("delivery_id", text.error_class(F.col("raw_value")).alias("error_class"))


@query(r"""SELECT delivery_id, sha256(regexp_replace(regexp_replace(regexp_replace(raw_value, 'bearer\s+[A-Za-z0-9._~+/-]+=*', 'bearer [redacted]', 'gi'), '((?:api[_-]?key|token|secret)\s*[=:]\s*)\S+', '\1[redacted]', 'gi'), '\b[0-9a-f]{32,}\b', '[redacted]', 'g')) AS redacted_sha256 FROM jsonl_rows""")
def T23_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jsonl_rows", "delivery_id", "raw_value").select("delivery_id", F.sha2(text.redacted(F.col("raw_value")), 256).alias("redacted_sha256"))


@query()
def T25_canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jsonl_rows", "delivery_id", "item_id", "raw_value", "received_at", "row_sha256")
    known = delivery.messages(rows).select("delivery_id", "digest").join(rows.select("delivery_id", "row_sha256"), "delivery_id")
    given = F.lower(F.regexp_replace(F.trim("row_sha256"), "^sha256:", ""))
    return known.select("delivery_id", F.col("digest").alias("row_sha256"), (given == F.col("digest")).alias("matches"))


@query(f"""{_EXPLODED}, w AS (SELECT o.pair_id, sum(o.n * coalesce(p.n, 0)) AS dot FROM o LEFT JOIN p ON o.pair_id = p.pair_id AND o.w = p.w GROUP BY 1),
a AS (SELECT pair_id, sqrt(sum(n * n)) AS s FROM o GROUP BY 1), b AS (SELECT pair_id, sqrt(sum(n * n)) AS s FROM p GROUP BY 1)
SELECT l.pair_id, round(coalesce(w.dot / nullif(a.s * b.s, 0), 0), 6) AS cosine FROM level_results l LEFT JOIN w ON w.pair_id = l.pair_id LEFT JOIN a ON a.pair_id = l.pair_id LEFT JOIN b ON b.pair_id = l.pair_id""")
def T12_bag_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the word counts of prompt and output; 0 where either has no words."""
    rows = _pairs(spark, sf_dir).select("pair_id", features.coverage(F.col("prompt"), F.col("output")).alias("c"))
    return rounded(rows.select("pair_id", "c.cosine"))


@query("""SELECT pair_id, sha256(concat_ws(chr(0), generation_model, domain, id, level, prompt_sha256)) AS path_id FROM level_results
WHERE generation_model IS NOT NULL AND domain IS NOT NULL AND id IS NOT NULL AND level IS NOT NULL AND prompt_sha256 IS NOT NULL""")
def T26_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["generation_model", "domain", "id", "level", "prompt_sha256"]
    rows = table(spark, sf_dir, "level_results", "pair_id", *parts).dropna(subset=parts)
    return rows.select("pair_id", F.sha2(F.concat_ws("\0", *parts), 256).alias("path_id"))


@query(rf"""WITH c AS (SELECT pair_id, prompt, ltrim(CASE WHEN pair_id % 3 = 0 THEN output ELSE '{text.MARKER}' || output END) AS given FROM level_results),
r AS (SELECT *, substr(given, {len(text.MARKER) + 1}) AS rest FROM c),
n AS (SELECT *, left(trim(regexp_replace(lower(coalesce(prompt, '')), '[{_SPACE}]+', ' ', 'g')), 80) AS head, left(trim(regexp_replace(lower(rest), '[{_SPACE}]+', ' ', 'g')), 500) AS tail FROM r)
SELECT pair_id, sha256(CASE WHEN starts_with(given, '{text.MARKER}') AND {_strip('rest')} <> '' AND NOT (length(head) >= 80 AND contains(tail, head)) THEN coalesce(prompt, '') || rest END) AS merged_sha256 FROM n""")
def T24_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs as continuations of their prompts; every third comes without the marker and is rejected."""
    marked = F.when(F.col("pair_id") % 3 == 0, F.col("output")).otherwise(F.concat(F.lit(text.MARKER), F.col("output")))
    return _pairs(spark, sf_dir).select("pair_id", F.sha2(text.merged_continuation(F.col("prompt"), marked), 256).alias("merged_sha256"))


QUERIES, SQL = query.QUERIES, query.SQL
