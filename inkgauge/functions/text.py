"""Text functions as built-in SQL expressions."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.functions.unicode import fold, folded
from inkgauge.functions.unicode import surface as surface_form

#: Letters, digits and the underscore, as the measure's tokens are defined.
WORD = r"[\p{L}\p{N}_]+"
#: White space as Python's re has it: Unicode's, which \s of Java and RE2 leaves out beyond ASCII, and four control characters.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
#: Tokens of the measure, Python's \w+|[^\w\s].
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
_WORDS = re.compile(r"\w+")
#: Words that say little (fixed values).
STOPWORDS = "a an the and or but of to in on at for with by from as is are was were be been it its this that these those not no".split()
#: Prefixes by which a failed call is known (fixed values).
ERROR_PREFIXES = ("[error", "error:", "http error", "exception:", "traceback")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def strip(text: Column) -> Column:
    """text without outer white space, Unicode's too."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def unicode_split(text: Column) -> Column:
    """Runs of text without white space, as Python's str.split() gives them."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def surface(text: Column) -> Column:
    """unicode.surface(); ASCII text, whose form needs no tables, stays within the JVM."""
    plain = ~text.rlike(r"[^\x00-\x7f]")
    folded = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    return F.when(plain, folded).otherwise(surface_form(F.when(plain, None).otherwise(text)))


def words(text: Column) -> Column:
    """Words of the surface form: NFC, case folded."""
    return F.regexp_extract_all(surface(text), F.lit(WORD), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """Arrays of n neighbours; none if there are fewer items."""
    if n <= 0:
        raise ValueError("n must be positive")
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(n)), " "))


def type_containment(target: Column, source: Column) -> Column:
    """Share of different items of target that source has; 0 for no target."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(target, source)), F.size(F.array_distinct(target))), F.lit(0.0))


def type_token_ratio(items: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_distinct(items)), F.size(items)), F.lit(0.0))


def first_sentence(text: Column, limit: int = 180) -> Column:
    """Up to the first terminator before white space; cut to limit characters and marked with dots if longer."""
    first = F.regexp_extract(text, r"^(?s)\s*(.*?[.!?])(\s|$)", 1)
    whole = F.when(first == "", strip(text)).otherwise(first)
    return F.when(F.length(whole) > limit, F.concat(F.rtrim(F.left(whole, F.lit(limit - 3))), F.lit("..."))).otherwise(whole)


def capitalized_keywords(text: Column, n: int = 3) -> Column:
    """The first n different capitalized words of three letters or more, letter case aside; else the first three words."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{Lu}][\p{L}]{2,}"), F.lit(0))
    firsts = F.filter(found, lambda w, i: F.array_position(F.transform(found, lambda v: F.lower(v)), F.lower(w)) == i + 1)
    plain = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), 1, 3)
    return F.when(F.size(firsts) > 0, F.slice(firsts, 1, n)).otherwise(plain)


def is_valid_output(text: Column, least: int = 10) -> Column:
    """Long enough, no error message, and not fewer than 5 different words among more than 20; false for null."""
    w = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda x: x != "")
    failed = F.lit(False)
    for prefix in ERROR_PREFIXES:
        failed = failed | F.startswith(F.lower(F.trim(text)), F.lit(prefix))
    monotone = (F.size(w) > 20) & (F.size(F.array_distinct(w)) < 5)
    return F.coalesce((F.length(F.trim(text)) >= least) & ~failed & ~monotone, F.lit(False))


def is_linguistic(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def repeats_itself(text: str | None) -> bool:
    """True for text that repeats itself, in its NFKC form, case-folded, with single spaces; also for an empty one and null.

    Up to 3 different characters in 30 or more; fewer than 5 different words in 20 or more; and in 12 words or more, a word 8
    times in a row or three words in a row 6 times.
    """
    form = fold(text or "")
    words = _WORDS.findall(form)
    if not form or len(form) >= 30 and len(set(form)) <= 3 or len(words) >= 20 and len(set(words)) < 5:
        return True
    if len(words) < 12:
        return False
    runs = max(sum(1 for _ in run) for _, run in groupby(words))
    return runs >= 8 or max(Counter(zip(words, words[1:], words[2:])).values()) >= 6


@F.pandas_udf(T.BooleanType())
def _repeats(values: pd.Series) -> pd.Series:
    return values.map(repeats_itself)


def is_repetitive(text: Column) -> Column:
    """repeats_itself() of a column."""
    return _repeats(text)


#: How a refusal begins (fixed values).
REFUSALS = (
    r"^(?:i(?:'|’)m|i am)\s+sorry\b.{0,120}\b(?:can(?:not|'t)|unable to)\s+(?:assist|help|comply|provide)\b",
    r"^(?:sorry[,;:]?\s+)?(?:i\s+)?(?:can(?:not|'t)|am unable to|cannot)\s+(?:assist|help|comply|provide)\b",
    r"^(?:for safety reasons|due to (?:safety|policy) restrictions|under (?:my|the) safety policy)\b.{0,120}\b(?:cannot|can't|unable to|won't)\b",
)


def rejection(text: Column, least: int = 30) -> Column:
    """Why a generated text is rejected, the first rule that holds; null for one that is accepted."""
    value = F.trim(text)
    refused = F.lit(False)
    for pattern in REFUSALS:
        refused = refused | F.lower(folded(text)).rlike(pattern)
    failed = F.lit(False)
    for prefix in ERROR_PREFIXES:
        failed = failed | F.startswith(F.lower(value), F.lit(prefix))
    return (
        F.when(text.isNull(), "no text").when(F.length(value) < least, "too short").when(~value.rlike(r"[\p{L}\p{N}]"), "no letter or digit")
        .when(failed, "error").when(refused, "refusal").when(is_repetitive(text), "repetitive")
    )


#: Classes of error texts: pattern of the lower-case text, in the order in which they are asked (fixed values).
ERRORS = (
    ("rate_limited", r"\b429\b|too many requests|rate limit"),
    ("overloaded", r"\b529\b|overloaded"),
    ("auth_or_config", r"\b(400|401|403|404|405|409|413|415|422)\b"),
    ("server_5xx", r"\b(500|502|503|504)\b"),
    ("protocol_or_quality", r"model mismatch|stop_reason|finish_reason|incomplete|content.filter|no visible text|no output_text|invalid json|invalid output|short output"),
    ("local_capacity", r"slot.*(timeout|capacity|acquire)|(timeout|capacity|acquire).*slot"),
    ("transport", r"connection (refused|reset|aborted)|remote end closed|(network|host) is unreachable|getaddrinfo failed|dns lookup failed|unexpected eof|fetch failed"),
    ("indeterminate_timeout", r"\b(408|425)\b|timed out|timeout expired|(subprocess|read) timeout"),
)


def error_class(text: Column) -> Column:
    """Class of an error text by ERRORS, in order; null text has none."""
    t = F.lower(text)
    out = F.when(text.isNull(), None)
    for name, pattern in ERRORS:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("other")


def redacted(text: Column) -> Column:
    """text with keys, bearer tokens and long hexadecimal strings replaced."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "bearer [redacted]")
    out = F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|secret)\s*[=:]\s*)\S+", "$1[redacted]")
    return F.regexp_replace(out, r"\b[0-9a-f]{32,}\b", "[redacted]")


def numbered_items(text: Column) -> Column:
    """Texts of the lines numbered 1. or 1), in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s+\S"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.)]\s+", "")))


#: How a continuation must begin (a fixed value of the measure's records).
MARKER = "<<<HC_CONTINUATION_7F3A>>>"


def merged_continuation(first: Column, more: Column, marker: str = MARKER) -> Column:
    """first and what follows marker in more; null, rejected, without a marker, with nothing after it, or for a restart.

    A restart holds the first 80 characters of first within its own first 500, letter case and white space aside; texts of
    fewer than 80 characters have none. A null first counts as empty.
    """
    given = F.ltrim(more)
    rest = F.substr(given, F.lit(len(marker) + 1))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), rf"[{SPACE}]+", " "))
    head = F.left(plain(F.coalesce(first, F.lit(""))), F.lit(80))
    restart = (F.length(head) >= 80) & F.contains(F.left(plain(rest), F.lit(500)), head)
    return F.when(F.startswith(given, F.lit(marker)) & (strip(rest) != "") & ~restart, F.concat(F.coalesce(first, F.lit("")), rest))
