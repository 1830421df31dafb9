"""Problem 5: text cut off by field limits.

A stack automaton reads the structure of an output: quotes, brackets, fences, environments and markup that are opened must
be closed, and escapes and multi-byte characters must be whole. Then the last line must end as its kind does: a sentence
with its terminator, a row of cells with as many cells as the others, an item of a list with a whole word. Whether a word
is whole is asked of all outputs: a word that none of them has before its end is a fragment. What an ending is worth is
measured against its source: limits are the token limit of the route and the lengths at which unended outputs pile up, and
a source that mostly leaves out terminators is not blamed for a missing one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.types import row
from inkgauge.llm.blank import is_empty
from inkgauge.llm.copies import copied, words_of
from inkgauge.llm.shape import with_shape
from inkgauge.llm.words import COMMON
from inkgauge.session import materialized

#: A proper end: a terminator and what may close after it.
ENDED = r"[.!?…。！？][\"'”’»›)\]*_`]*\s*$"
#: Lengths are limits where this many unended outputs lie, and this many times what lies on lengths around.
PILE, PILE_RATIO, AROUND = 8, 4.0, 12
#: Characters at the end of an output in which its terminator, what closes after it, and residues are looked for.
TAIL = 60
#: Words that are asked as a set in a filter; more are joined as a table.
LITERAL = 20_000
#: A source that leaves out the terminator of more than this share of its prose has no such habit to break.
HABIT = 0.5

_STRUCTURE = re.compile(r"```|\*\*|\\begin\{\w+\}|\\end\{\w+\}|\\\[|\\\]|\$\$|</?[a-zA-Z][^<>\n]*>|[(){}\[\]“”„«»]")
_PAIRS = {")": "(", "}": "{", "]": "[", "”": "“", "»": "«", r"\]": r"\["}
_TOGGLES = {"```", "**", "$$"}
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_RESIDUE = re.compile(r"�|(\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9A-F]?|&[a-zA-Z]{1,8}|&#\d*|\\|<[a-zA-Z/][^<>]*|[ÃÂâ]€?)$")
#: A residue, before any white space.
_LOOSE = r"�|(\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9A-F]?|&[a-zA-Z]{1,8}|&#\d*|\\|<[a-zA-Z/][^<>]*|[ÃÂâ]€?)\s*$"
_MARK = re.compile(r"^\s*([-–—•*·]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(\s+|$)(.*)$")
_SIGNED = re.compile(r"^\s*(—|–|--)\s*[^\W\d_].{0,80}$")
_WORD = re.compile(r"\w+")
_GAP = re.compile(r" {3,}(?=\S)")
_DELIMITERS = (re.compile(r"\t"), re.compile(r"\|"), re.compile(r" & "), _GAP, re.compile(r","))
_FUNCTION = frozenset(w for words in COMMON.values() for w in words)


def open_structure(text: str) -> list[str]:
    """What is opened in text and never closed, outermost first.

    A closing mark takes back the nearest opening one of its kind and all that was opened after it; one without an opening
    mark is passed over. Marks that are their own closing ones toggle. Inside a fence only the fence is read.
    """
    stack: list[str] = []
    for m in _STRUCTURE.finditer(text):
        mark = m.group()
        if "```" in stack and mark != "```":
            continue
        if mark in _TOGGLES:
            opened = mark
            closing = mark in stack
        elif mark.startswith("\\begin"):
            opened, closing = "\\begin", False
        elif mark.startswith("\\end"):
            opened, closing = "\\begin", True
        elif mark[0] == "<" and len(mark) > 2:
            name = re.match(r"</?(\w+)", mark)
            if name is None or name.group(1).lower() in _VOID or mark.endswith("/>"):
                continue
            opened, closing = "<" + name.group(1), mark[1] == "/"
        elif mark in _PAIRS:
            opened, closing = _PAIRS[mark], True
        else:
            opened, closing = ("“" if mark == "„" else mark), False
        if not closing:
            # German quotes end with the sign that opens English ones.
            if mark == "“" and "“" in stack and text[: m.start()].count("„") > text[: m.start()].count("“"):
                stack.remove("“")
                continue
            stack.append(opened)
        elif opened in stack:
            while stack.pop() != opened:
                pass
    return stack


def is_title(text: str) -> bool:
    """One line of up to 14 words without a terminator, whose longer words begin with capitals."""
    if "\n" in text.strip():
        return False
    words = [w for w in _WORD.findall(text) if not w.isdigit()]
    long = [w for w in words if w.lower() not in _FUNCTION]
    return 2 <= len(words) <= 14 and bool(long) and sum(w[0].isupper() for w in long) >= 0.8 * len(long) and len(long) >= 2


def _reaches_last_column(rows: list[str], tail: str, usual: int) -> bool:
    """True if the last cell of tail begins at the last column of the aligned rows or after; a wide cell may hide a gap."""
    begins = [list(_GAP.finditer(x.strip()))[-1].end() for x in rows if _cells(x, _GAP) == usual]
    gaps = list(_GAP.finditer(tail.strip()))
    return bool(gaps) and gaps[-1].end() >= max(set(begins), key=begins.count)


def _cells(line: str, delimiter: re.Pattern) -> int:
    return len(delimiter.findall(line.strip()))


def ending(output: str, shape: str | None) -> tuple[str, str | None]:
    """(state, last word) of an output: whole, cut, unended (prose without its terminator) or doubt (item or cell)."""
    text = output.rstrip()
    words = _WORD.findall(text[-200:])
    last = words[-1].lower() if words else None
    if not text:
        return "whole", None
    if _RESIDUE.search(text[-TAIL:]):
        return "cut", last
    ended = re.search(ENDED, text[-TAIL:])
    open_marks = open_structure(text)
    if ended:
        return ("cut" if any(m in _HARD for m in open_marks) else "whole"), last
    lines = [x for x in text.split("\n") if x.strip()]
    tail = lines[-1]
    if re.search(r"(\\\]|\$\$|```|\\end\{\w+\})$", text) and not open_marks:
        return "whole", last
    if len(lines) > 1 and _SIGNED.match(tail) and not (len(lines) > 2 and _SIGNED.match(lines[-2])):
        return "whole", last
    if is_title(text):
        return "whole", last
    if any(m in ("```", "\\begin", "\\[", "$$", "**", "(", "[", "{", "“", "«") for m in open_marks):
        return "cut", last
    for delimiter in _DELIMITERS:
        spaced = delimiter.pattern == ","
        rows = [x for x in lines[:-1] if _cells(x, delimiter) and not (spaced and ", " in x)]
        if len(rows) >= min(2, len(lines) - 1) and 2 * len(rows) >= len(lines) - 1 and rows and shape in ("table", None) and (shape == "table" or not spaced):
            counts = [_cells(x, delimiter) for x in rows]
            usual = max(set(counts), key=counts.count)
            if counts.count(usual) * 2 <= len(counts):
                continue
            if delimiter is _GAP and _reaches_last_column(rows, tail, usual):
                return "doubt", last
            if _cells(tail, delimiter) < usual or rows[-1].rstrip().endswith("|") and not tail.rstrip().endswith("|"):
                return "cut", last
            return ("whole" if tail.rstrip().endswith("|") else "doubt"), last
    item = _MARK.match(tail)
    listed = item and sum(bool(_MARK.match(x)) for x in lines) >= 2
    if listed or shape == "list":
        body = (item.group(3) if item else tail).strip()
        if not body or body[-1] in ",;:/-(" or last in _FUNCTION and len(_WORD.findall(body)) > 1:
            return "cut", last
        return "doubt", last
    if shape == "table":
        return "doubt", last
    return "unended", last


_ENDING = row(pair_id="long", generation_model="string", output_tokens="int", n_chars="int", state="string", last_word="string")


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The endings that are not whole, without copies of the prompt and outputs that are no answer at all."""
    for batch in batches:
        found = []
        columns = (batch[c] for c in ("pair_id", "generation_model", "output_tokens", "n_chars", "prompt", "output", "shape"))
        for *known, prompt, output, shape in zip(*columns):
            if is_empty(output):
                continue
            state, last = ending(output, shape if isinstance(shape, str) else None)
            if state != "whole" and not (isinstance(prompt, str) and copied(prompt, words_of(output))):
                found.append((*known, state, last))
        out = pd.DataFrame(found, columns=_ENDING.names)
        out["output_tokens"] = out["output_tokens"].astype("Int32")
        yield out


#: Marks that an output with a proper end must close; the automaton reads every output that has one.
_HARD = ("```", "\\begin", "\\[", "$$", "{")


def suspects(rows: DataFrame) -> DataFrame:
    """The rows whose output the automaton may not pass as whole: all without a proper end, with residue or a hard mark.

    Only what ending() finds whole at once is left out: texts with a terminator and neither residue nor a hard mark.
    """
    out = F.col("output")
    tail = F.substring(out, -TAIL, TAIL)
    hard = reduce(Column.__or__, [out.contains(mark) for mark in _HARD])
    return rows.filter(F.trim(out) != "").filter(~tail.rlike(ENDED) | tail.rlike(_LOOSE) | hard)


def limits(rows: DataFrame) -> DataFrame:
    """(n_chars): lengths at which outputs without a proper end pile up, over all rows (output)."""
    lengths = rows.filter(F.trim("output") != "").select(
        F.length("output").alias("n_chars"), (~F.substring("output", -TAIL, TAIL).rlike(ENDED)).cast("int").alias("open")
    )
    counts = materialized(lengths.groupBy("n_chars").agg(F.sum("open").alias("open")).filter("open > 0"), "lengths")
    near = counts.withColumn("n_chars", F.explode(F.sequence(F.col("n_chars") - AROUND, F.col("n_chars") + AROUND)))
    near = near.groupBy("n_chars").agg(F.sum("open").alias("around"))
    piled = counts.join(near, "n_chars").withColumn("usual", (F.col("around") - F.col("open")) / (2 * AROUND))
    return piled.filter((F.col("open") >= PILE) & (F.col("open") > PILE_RATIO * F.col("usual"))).select("n_chars")


def known_words(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(last_word) of asked that at least two outputs of rows (pair_id, output) have before their last word.

    Up to LITERAL asked words are a set in the filter; more are joined. Only asked words are counted.
    """
    asked = materialized(asked.select("last_word").filter("last_word is not null").distinct(), "asked")
    words = F.regexp_extract_all(F.lower("output"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    every = rows.select("pair_id", F.explode(words).alias("last_word"))
    few = [r[0] for r in asked.limit(LITERAL + 1).collect()]
    every = every.filter(F.col("last_word").isin(few)) if len(few) <= LITERAL else every.join(asked, "last_word", "left_semi")
    # Two different outputs are enough, so no list of outputs is kept for a word.
    seen = every.groupBy("last_word").agg(F.min("pair_id").alias("a"), F.max("pair_id").alias("b"))
    return seen.filter("a <> b").select("last_word")


def truncated(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """(pair_id, generation_model) of the outputs that stop before their end.

    rows: pair_id, generation_model, prompt, output, output_tokens; routes: model, max_output_tokens; other columns are
    ignored. Outputs that are no answer at all, junk, copies of the prompt and titles are none. A missing prompt is no copy, a missing
    model or count no limit.
    """
    rows = rows.select("pair_id", "generation_model", "prompt", "output", "output_tokens")
    shaped = with_shape(suspects(rows), "output").filter("shape is null or shape <> 'junk'")
    read = shaped.select("pair_id", "generation_model", "output_tokens", F.length("output").alias("n_chars"), "prompt", "output", "shape")
    read = materialized(read.mapInPandas(_endings, _ENDING), "endings")
    most = routes.groupBy(F.col("model").alias("generation_model")).agg(F.max("max_output_tokens").alias("most"))
    everything = rows.filter(F.trim("output") != "").groupBy("generation_model").agg(F.count("*").alias("n"))
    habit = read.filter("state = 'unended'").groupBy("generation_model").agg(F.count("*").alias("open")).join(everything, "generation_model")
    habit = habit.select("generation_model", (F.col("open") / F.col("n") > HABIT).alias("habit"))
    sure = F.col("state") == "cut"
    doubted = read.filter(~sure)
    whole_words = known_words(rows.select("pair_id", "output"), doubted).withColumn("_known", F.lit(True))
    piles = limits(rows.select("output")).withColumn("_pile", F.lit(True))
    judged = doubted.join(whole_words, "last_word", "left").join(piles, "n_chars", "left")
    judged = judged.join(most, "generation_model", "left").join(habit, "generation_model", "left")
    at_limit = F.coalesce(F.col("output_tokens") >= F.col("most"), F.lit(False)) | F.coalesce("_pile", F.lit(False))
    fragment = F.col("last_word").isNotNull() & F.col("_known").isNull()
    unended = (F.col("state") == "unended") & ~F.coalesce("habit", F.lit(False))
    found = judged.filter(unended | at_limit | fragment).select("pair_id", "generation_model")
    return read.filter(sure).select("pair_id", "generation_model").unionByName(found)


def rates(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Per generation_model: pairs, outputs that are cut, their share, and unended_share, the baseline of the source: the
    share of its outputs with text that have no proper end, cut or not.
    """
    cut = truncated(rows, routes).groupBy("generation_model").agg(F.count("*").alias("cut"))
    some = F.trim("output") != ""
    unended = F.avg(F.when(some, (~F.substring("output", -TAIL, TAIL).rlike(ENDED)).cast("double")))
    pairs = rows.groupBy("generation_model").agg(F.count("*").alias("pairs"), F.coalesce(unended, F.lit(0.0)).alias("unended_share"))
    out = pairs.join(cut, pairs.generation_model.eqNullSafe(cut.generation_model), "left").drop(cut.generation_model)
    share = F.coalesce("cut", F.lit(0)) / F.col("pairs")
    return out.select("generation_model", "pairs", F.coalesce("cut", F.lit(0)).alias("cut"), share.alias("share"), "unended_share")
