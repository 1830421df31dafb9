"""Queries of the problems on text for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import answers, ending, groups, mixing, packing, shape, spans, tokens
from inkgauge.llm.words import COMMON
from inkgauge.sources.tables import table, texts

_CLUSTER = ("source_cluster_domain", "source_cluster_id", "source_cluster_fingerprint")


_PAIR = ("pair_id", "generation_model", "prompt", "output", "output_tokens")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.shapes(texts(spark, sf_dir, "level_results", "pair_id", "prompt", "output"))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.with_shape(texts(spark, sf_dir, "level_results", "pair_id", "output"), "output").drop("output")


def p1_word_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of words and lines that SQL has too."""
    names = ("n_words", "mean_word_length", "longest_word", "digit_share", "common_share", "distinct_share", "n_lines", "mean_line_chars")
    known = shape.with_statistics(texts(spark, sf_dir, "level_results", "pair_id", "output"), "output")
    return known.select("pair_id", *[F.round(n, 6).alias(n) for n in names])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.defects(texts(spark, sf_dir, "level_results", *_PAIR), table(spark, sf_dir, "routes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ending.truncated(texts(spark, sf_dir, "level_results", *_PAIR), table(spark, sf_dir, "routes")).select("pair_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ending.rates(texts(spark, sf_dir, "level_results", *_PAIR), table(spark, sf_dir, "routes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = groups.related(table(spark, sf_dir, "paired_items", "paired_id", *_CLUSTER), "paired_id")
    return related.filter("n_sources > 1").select("paired_id", "group_key")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_items", "paired_id", *_CLUSTER)
    return groups.assign_splits(rows, "paired_id", table(spark, sf_dir, "split_targets"))


def p4_level_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "level_results", "pair_id", *_CLUSTER)
    return groups.assign_splits(rows, "pair_id", table(spark, sf_dir, "split_targets"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sized_documents(texts(spark, sf_dir, "documents", "doc_id", "source", "text"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "container_specs")
    return packing.fill(packing.pack(_sizes(spark, sf_dir), specs), specs)


def p6_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.proportions(packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "container_specs")))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets").select(F.lower(F.trim("source")).alias("source"), F.col("target_share").alias("share"))
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "container_specs"), targets)


def p6_mixed_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers whose windows hold the sources in the proportions of mix_targets as long as they last."""
    return _mixed(spark, sf_dir)


def p6_mixed_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.proportions(_mixed(spark, sf_dir))


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p7_refilled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares where what capped sources cannot give is handed on to the others."""
    return mixing.draw(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), refill=True)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(texts(spark, sf_dir, "documents", "doc_id", "text"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir, "documents", "doc_id", "text")
    return spans.shared_share(documents, spans.shared_spans(documents)).withColumn("shared_share", F.round("shared_share", 9))


QUERIES = {
    "p1_found": p1_found, "p1_statistics": p1_statistics, "p1_word_statistics": p1_word_statistics, "p2_found": p2_found, "p5_found": p5_found, "p5_rates": p5_rates,
    "p4_found": p4_found, "p4_splits": p4_splits, "p4_level_splits": p4_level_splits,
    "p6_containers": p6_containers, "p6_unused": p6_unused, "p6_proportions": p6_proportions,
    "p6_mixed_containers": p6_mixed_containers, "p6_mixed_proportions": p6_mixed_proportions,
    "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_refilled_shares": p7_refilled_shares, "p8_found": p8_found, "p8_share": p8_share,
}
_STRIP = r"regexp_replace(nfc_normalize({0}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

#: Components by a closure over the sources that share a fingerprint.
_P4_FOUND = f"""WITH RECURSIVE c AS (SELECT paired_id, lower({_STRIP.format("coalesce(source_cluster_domain, '')")}) AS d, {_STRIP.format("source_cluster_id")} AS i,
  lower(trim(source_cluster_fingerprint)) AS f FROM paired_items),
k AS (SELECT paired_id, CASE WHEN i <> '' THEN d || ':' || i END AS source, CASE WHEN f <> '' AND f <> '{groups.NO_FINGERPRINT}' THEN f END AS fp FROM c),
p AS (SELECT DISTINCT source, fp FROM k WHERE source IS NOT NULL), e AS (SELECT DISTINCT a.source AS a, b.source AS b FROM p a JOIN p b ON a.fp = b.fp AND a.source <> b.source),
r AS (SELECT DISTINCT source, source AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.source),
g AS (SELECT source, min(root) AS group_key, count(*) AS n FROM r GROUP BY 1), h AS (SELECT p.fp, min(g.group_key) AS group_key, max(g.n) AS n FROM p JOIN g ON g.source = p.source WHERE p.fp IS NOT NULL GROUP BY 1)
SELECT k.paired_id, coalesce(g.group_key, h.group_key) AS group_key FROM k LEFT JOIN g ON g.source = k.source LEFT JOIN h ON k.source IS NULL AND h.fp = k.fp WHERE coalesce(g.n, h.n) > 1"""

#: Every stretch of 200 characters of every text, compared as it is.
_SHARED = """w AS (SELECT doc_id, unnest(range(0, length(text) - 199)) AS p, text FROM documents WHERE length(text) >= 200), s AS (SELECT doc_id, p, hash(substr(text, p + 1, 200)) AS h FROM w),
t AS (SELECT h FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)), x AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 200 THEN 0 ELSE 1 END AS new FROM s SEMI JOIN t ON s.h = t.h WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
y AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM x), shared AS (SELECT doc_id, min(p) AS start_char, max(p) + 200 AS end_char FROM y GROUP BY doc_id, run)"""

_COMMON = ", ".join("'" + w + "'" for w in dict.fromkeys(w for words in COMMON.values() for w in words))
_P1_LINES = rf"""WITH t AS (SELECT pair_id, coalesce(output, '') AS t FROM level_results), l AS (SELECT pair_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ ]')) AS l FROM t)
SELECT pair_id, CAST(len(w) AS DOUBLE) AS n_words, round(coalesce(length(array_to_string(w, '')) / nullif(CAST(len(w) AS DOUBLE), 0), 0), 6) AS mean_word_length,
CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS longest_word, round(coalesce(len(regexp_extract_all(t, '[0-9]')) / nullif(CAST(length(t) AS DOUBLE), 0), 0), 6) AS digit_share,
round(coalesce(len(list_intersect(list_distinct(w), [{_COMMON}])) / nullif(CAST(len(list_distinct(w)) AS DOUBLE), 0), 0), 6) AS common_share, round(coalesce(len(list_distinct(w)) / nullif(CAST(len(w) AS DOUBLE), 0), 0), 6) AS distinct_share,
CAST(len(l) AS DOUBLE) AS n_lines, round(coalesce(length(array_to_string(l, '')) / nullif(CAST(len(l) AS DOUBLE), 0), 0), 6) AS mean_line_chars FROM l"""

SQL: dict[str, str] = {
    "p4_found": _P4_FOUND,
    "p8_found": f"WITH {_SHARED} SELECT * FROM shared",
    "p8_share": f"""WITH {_SHARED}, f AS (SELECT doc_id, sum(end_char - start_char) AS c FROM shared GROUP BY 1)
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, CAST(coalesce(f.c, 0) AS BIGINT) AS shared_chars, round(coalesce(f.c / nullif(CAST(length(d.text) AS DOUBLE), 0), 0), 9) AS shared_share FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
    "p1_word_statistics": _P1_LINES,
}
