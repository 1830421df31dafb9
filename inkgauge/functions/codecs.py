"""Code lengths of texts under general-purpose compressors, and the scores made of them."""

from __future__ import annotations

import bz2
import ctypes
import lzma
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("zlib", "bz2", "lzma")
#: What stands between context and target (a fixed value of the measure).
SEPARATOR = b"\n<<<HC_CONTEXT_TARGET_SEPARATOR>>>\n"

#: What malloc may keep of freed memory, and the size from which it maps memory apart (32 MB is the most that it takes).
KEPT, APART = 64 << 20, 32 << 20
#: Bytes that fit the least block of bz2 (100,000 less 19) though its coding of runs makes five bytes of four.
ONE_BLOCK = 79_000


@lru_cache(1)
def _keep_memory() -> None:
    """Memory that codecs free stays with the process: else the system hands out and clears the same MB for every text, which
    takes longer than the codecs. Where malloc is not glibc's nothing is set.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-1, KEPT)
        mallopt(-3, APART)


def code_length(data: bytes, codec: str) -> int:
    """Bytes of data under a codec at its highest level.

    The LZMA dictionary is sized to the input, which gives the length of preset 9 without its 64 MB of memory. The level of
    bz2 is the size of its blocks; what fits the least block has the length of level 9 at less memory.
    """
    _keep_memory()
    if codec == "zlib":
        return len(zlib.compress(data, 9))
    if codec == "bz2":
        return len(bz2.compress(data, 1 if len(data) <= ONE_BLOCK else 9))
    if codec == "lzma":
        size = max(1 << 16, 1 << max(0, len(data) - 1).bit_length())
        return len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9, "dict_size": min(size, 1 << 26)}]))
    raise ValueError(f"no such codec: {codec}")


_EMPTY = {c: code_length(b"", c) for c in CODECS}


def bits(data: bytes, codec: str) -> float:
    """Bits of data beyond those of an empty stream; 0 for no data."""
    return max(0.0, 8.0 * (code_length(data, codec) - _EMPTY[codec])) if data else 0.0


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def given_bits(data: bytes, context: bytes, codec: str) -> float:
    """Bits of data after context, as in pair_bits()."""
    prefix = context + SEPARATOR
    return max(0.0, bits(prefix + data, codec) - bits(prefix, codec))


def pair_bits(target: str | None, context: str | None, seen: dict | None = None) -> list[tuple[str, float, float]]:
    """(codec, bits of target, bits of target after context) for each codec; null counts as empty.

    seen keeps the bits of contexts that come again.
    """
    data, prefix = _utf8(target), _utf8(context) + SEPARATOR
    if not data:
        return [(c, 0.0, 0.0) for c in CODECS]
    out = []
    for codec in CODECS:
        before = seen.get((codec, prefix)) if seen is not None else None
        if before is None:
            before = bits(prefix, codec)
            if seen is not None:
                seen[codec, prefix] = before
        out.append((codec, bits(data, codec), max(0.0, bits(prefix + data, codec) - before)))
    return out


PROFILE = T.ArrayType(
    T.StructType([T.StructField("codec", T.StringType()), T.StructField("self_bits", T.DoubleType()), T.StructField("given_bits", T.DoubleType())])
)


@F.pandas_udf(PROFILE)
def _pair_profile(targets: pd.Series, contexts: pd.Series) -> pd.Series:
    seen: dict = {}
    known: dict = {}
    out = []
    for pair in zip(targets, contexts):
        if pair not in known:
            known[pair] = [dict(zip(("codec", "self_bits", "given_bits"), row)) for row in pair_bits(*pair, seen)]
        out.append(known[pair])
    return pd.Series(out)


def pair_profile(target: Column, context: Column) -> Column:
    """array of (codec, self_bits, given_bits) of target and of target after context."""
    return _pair_profile(target, context)


@F.pandas_udf(T.DoubleType())
def _text_bits(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else sum(bits(_utf8(t), c) for c in CODECS) / len(CODECS))


def text_bits(text: Column) -> Column:
    """Mean bits of text over the codecs; 0 for an empty one, null for null."""
    return _text_bits(text)


def distance(left: str, right: str, seen: dict | None = None) -> float:
    """Normalized compression distance over the mean of the codecs, between 0 and 1; 0 if both are empty.

    seen keeps the bits of texts that come again.
    """
    known = {} if seen is None else seen

    def mean(data: bytes) -> float:
        if data not in known:
            known[data] = sum(bits(data, c) for c in CODECS) / len(CODECS)
        return known[data]

    a, b = _utf8(left), _utf8(right)
    one, other, both = mean(a), mean(b), mean(a + SEPARATOR + b)
    return min(1.0, max(0.0, (both - min(one, other)) / max(one, other))) if max(one, other) > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def _distances(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(left, right)], dtype="Float64")


def compression_distance(left: Column, right: Column) -> Column:
    """Normalized compression distance; null if either text is null."""
    return _distances(left, right)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("distance", T.DoubleType())])))
def _distances_within(groups: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for g, t in zip(groups, texts):
        seen: dict = {}
        out.append([{"a": i, "b": j, "distance": distance(t[i], t[j], seen)} for i in range(len(t)) for j in range(i + 1, len(t)) if g[i] != g[j]])
    return pd.Series(out)


def distances_within(groups: Column, texts: Column) -> Column:
    """array of (a, b, distance): every two of texts (none null), by their places a < b, that are not in the same group."""
    return _distances_within(groups, texts)


def gain(profile: Column, tokens: Column) -> dict[str, Column]:
    """self_bits, given_bits, gain, ratio and gain_per_token of a pair_profile: means over the codecs come first."""
    mean = lambda name: F.aggregate(profile, F.lit(0.0), lambda s, x: s + x[name]) / F.size(profile)
    own, given = mean("self_bits"), mean("given_bits")
    won = F.greatest(own - given, F.lit(0.0))
    return {
        "self_bits": own,
        "given_bits": given,
        "gain": won,
        "ratio": F.least(F.coalesce(F.try_divide(won, own), F.lit(0.0)), F.lit(1.0)),
        "gain_per_token": F.coalesce(F.try_divide(won, tokens.cast("double")), F.lit(0.0)),
    }
