"""Problem 1: text statistics per document, and the shape that learned rules read from them.

Statistics are built-in SQL expressions. Rules are learned on the labelled documents of labelled.py, whose statistics the
same expressions compute, and come back as one CASE expression.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import labelled
from inkgauge.llm.rules import Rule, learn, to_sql
from inkgauge.llm.words import COMMON

#: A line that is marked as an item of a list.
_MARKED = r"^\s*([-–—•*·]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S"
#: A short line of up to five words that ends without punctuation.
_BARE = r"^\s*(\S+\s+){0,4}\S*[^\s.!?…,;:]\s*$"
#: A line of cells: tabs, bars, ampersands, wide gaps, commas without spaces, or a rule between rows.
_CELLS = r"\S\t+\S|^\s*\|.*\|\s*$|\S \| \S|\S & \S|\S {3,}\S|^[^\s,]+,[^\s,]+,\S*$|^[-+|:= ]{5,}$|^\s*\\(begin|end)\{"
#: A line that ends as a sentence does.
_ENDED = r"[.!?…][\"'”’»)\]*_]*\s*$"
#: The end of a sentence.
_STOP = r"[.!?…][\"'”’»)\]*_]*(\s|$)"

FEATURES = (
    "n_words", "mean_word_length", "longest_word", "symbol_share", "digit_share", "common_share", "distinct_share",
    "n_lines", "mean_line_chars", "mean_sentence_words", "ended_share", "item_share", "cell_share",
)

_CACHE: dict[tuple, list[Rule]] = {}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """rows with the columns of FEATURES for the column text; null counts as an empty text, whose statistics are all 0.

    n_words; mean_word_length and longest_word in characters; symbol_share and digit_share of the characters;
    common_share, the share of different words that are common ones; distinct_share of the words; n_lines with text and
    their mean_line_chars; mean_sentence_words, words over lines and sentence ends; ended_share of lines ending in sentence
    punctuation; item_share and cell_share, the shares of characters in lines that are items of a list and rows of cells.
    """
    common = F.array(*[F.lit(w) for w in dict.fromkeys(w for words in COMMON.values() for w in words)])
    body = F.coalesce(F.col(text), F.lit(""))
    names = rows.columns
    rows = rows.withColumns(
        {
            "_text": body,
            "_words": F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
            "_lines": F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""),
        }
    )
    rows = rows.withColumns(
        {
            "_types": F.array_distinct("_words"),
            "_letters": F.length(F.array_join("_words", "")),
            "_solid": F.length(F.translate("_text", " \n\t\r", "")),
            "_cells": F.filter("_lines", lambda x: x.rlike(_CELLS)),
            "_size": F.length(F.array_join("_lines", "")),
        }
    )
    items = F.filter("_lines", lambda x: (x.rlike(_MARKED) | x.rlike(_BARE)) & ~x.rlike(_CELLS))
    out = {
        "n_words": F.size("_words").cast("double"),
        "mean_word_length": _share(F.col("_letters"), F.size("_words")),
        "longest_word": F.coalesce(F.array_max(F.transform("_words", lambda w: F.length(w))), F.lit(0)).cast("double"),
        "symbol_share": _share(F.col("_solid") - F.col("_letters"), F.length("_text")),
        "digit_share": _share(F.length("_text") - F.length(F.translate("_text", "0123456789", "")), F.length("_text")),
        "common_share": _share(F.size(F.array_intersect("_types", common)), F.size("_types")),
        "distinct_share": _share(F.size("_types"), F.size("_words")),
        "n_lines": F.size("_lines").cast("double"),
        "mean_line_chars": _share(F.col("_size"), F.size("_lines")),
        "mean_sentence_words": _share(F.size("_words"), F.size("_lines") + F.regexp_count("_text", F.lit(_STOP))),
        "ended_share": _share(F.size(F.filter("_lines", lambda x: x.rlike(_ENDED))), F.size("_lines")),
        "item_share": _share(F.length(F.array_join(items, "")), F.col("_size")),
        "cell_share": _share(F.length(F.array_join("_cells", "")), F.col("_size")),
    }
    # A generator keeps the optimizer from writing each statistic out anew wherever a rule asks for it.
    values = F.inline(F.array(F.struct(*[c.alias(name) for name, c in out.items()])))
    return rows.select(*names, values)


def learned_rules(spark: SparkSession, n: int = labelled.TRAINING_DOCUMENTS, seed: int = 7) -> list[Rule]:
    """Rules for table, junk and list, in this order, learned on n labelled documents."""
    if (n, seed) not in _CACHE:
        texts, labels = zip(*labelled.documents(n, seed))
        made = spark.createDataFrame(pa.table({"text": texts, "label": labels}))
        known = with_statistics(made, "text").select("label", *FEATURES).toPandas()  # n rows
        columns = {f: known[f].to_numpy() for f in FEATURES}
        _CACHE[n, seed] = learn(columns, known["label"].to_numpy(), ("table", "junk", "list"))
    return _CACHE[n, seed]


def shape_sql(spark: SparkSession) -> str:
    """CASE expression over FEATURES: table, junk, list or null for prose and verse."""
    return to_sql(learned_rules(spark))


def with_shape(rows: DataFrame, text: str) -> DataFrame:
    """rows with FEATURES and shape."""
    return with_statistics(rows, text).withColumn("shape", F.expr(shape_sql(rows.sparkSession)))
