"""Fifteen surface features of a prompt and its output."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions.codecs import CODECS, bits
from inkgauge.functions.types import row

FEATURES = (
    "prompt_bytes", "output_bytes", "prompt_words", "output_words", "prompt_to_output_byte_ratio", "word_type_coverage",
    "word_token_coverage", "word_bigram_coverage", "char3_coverage", "char5_coverage", "char8_coverage", "rouge_l_recall",
    "output_type_token_ratio", "output_bigram_repeat_fraction", "output_self_bits_per_byte",
)

_WORD = re.compile(r"\w+")


def surface_form(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def grams(items, n: int) -> list:
    """Runs of n neighbours: texts of a text, tuples of a list."""
    if isinstance(items, str):
        return [items[i : i + n] for i in range(len(items) - n + 1)]
    return list(zip(*(items[i:] for i in range(n))))


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def multiset_share(target: list, source: list) -> float:
    """Share of target, counted with repeats, that source holds as often; 0 for no target."""
    return _share(sum((Counter(target) & Counter(source)).values()), len(target))


def common_subsequence(left: list, right: list) -> int:
    """Length of the longest common subsequence, by rows of bits: a bit of row is 0 where the length grows at that item."""
    places: dict = {}
    for i, item in enumerate(right):
        places[item] = places.get(item, 0) | 1 << i
    row = full = (1 << len(right)) - 1
    for item in left:
        met = row & places.get(item, 0)
        row = (row + met | row - met) & full
    return len(right) - row.bit_count()


def surface_features(prompt: str | None, output: str | None) -> tuple[float, ...]:
    """Values of FEATURES; null counts as empty, and whatever would divide by zero is 0."""
    prompt, output = prompt or "", output or ""
    a, b = surface_form(prompt), surface_form(output)
    given, made = _WORD.findall(a), _WORD.findall(b)
    given2, made2 = grams(given, 2), grams(made, 2)
    n_in, n_out = len(prompt.encode("utf-8", "replace")), len(output.encode("utf-8", "replace"))
    types = set(made)
    self_bits = sum(bits(output.encode("utf-8", "replace"), c) for c in CODECS) / len(CODECS)
    return (
        float(n_in), float(n_out), float(len(given)), float(len(made)), _share(n_in, n_out),
        _share(len(types & set(given)), len(types)), multiset_share(made, given), multiset_share(made2, given2),
        *(multiset_share(grams(b, n), grams(a, n)) for n in (3, 5, 8)),
        _share(common_subsequence(made, given), len(made)), _share(len(types), len(made)),
        1.0 - len(set(made2)) / len(made2) if made2 else 0.0, _share(self_bits, n_out),
    )


_ROW = row(**dict.fromkeys(FEATURES, "double"))


@F.pandas_udf(_ROW)
def _features(prompts: pd.Series, outputs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([surface_features(p, o) for p, o in zip(prompts, outputs)], columns=list(FEATURES))


def features(prompt: Column, output: Column) -> Column:
    """struct of FEATURES."""
    return _features(prompt, output)


def word_coverage(prompt: str | None, output: str | None) -> tuple[int, float, float]:
    """Words of the output, the share of them that the prompt has as often, and the cosine of both word counts."""
    given, made = (Counter(_WORD.findall(surface_form(t or ""))) for t in (prompt, output))
    n = made.total()
    size = math.sqrt(sum(v * v for v in made.values())) * math.sqrt(sum(v * v for v in given.values()))
    return n, _share((made & given).total(), n), _share(sum(v * given[w] for w, v in made.items()), size)


_COVERAGE = row(words="long", token_coverage="double", cosine="double")
#: Lengths of the character runs whose coverage is measured.
LENGTHS = (3, 5, 8)
_CHARS = row(**{f"char{n}": "double" for n in LENGTHS})


@F.pandas_udf(_COVERAGE)
def _word_coverage(prompts: pd.Series, outputs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_coverage(p, o) for p, o in zip(prompts, outputs)], columns=_COVERAGE.names)


@F.pandas_udf(_CHARS)
def _char_coverage(prompts: pd.Series, outputs: pd.Series) -> pd.DataFrame:
    forms = ((surface_form(o or ""), surface_form(p or "")) for p, o in zip(prompts, outputs))
    return pd.DataFrame([[multiset_share(grams(o, n), grams(p, n)) for n in LENGTHS] for o, p in forms], columns=_CHARS.names)


def coverage(prompt: Column, output: Column) -> Column:
    """struct of word_coverage(); null counts as empty."""
    return _word_coverage(prompt, output)


def char_coverage(prompt: Column, output: Column) -> Column:
    """struct of the shares of the output's character runs, counted with repeats, that the prompt has; null counts as empty."""
    return _char_coverage(prompt, output)
