"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.session import materialized

#: Where the vocabulary lies unless a caller names another file; it is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenization pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for texts of these characters only, where the standard library's engine is faster.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
_OTHER = re.compile("[^\t\n\r -~ -ɏ‐-‧‰-⁞]")
_FAST = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
)
#: Pieces whose size a task remembers; more only costs time.
_REMEMBER = 300_000


class Counter:
    """Counts tokens of texts; pieces that come again are looked up."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        if len(self.sizes) > _REMEMBER:
            self.sizes.clear()
        size = self.sizes[piece] = len(self.encoding.encode_ordinary(piece))
        return size

    def count(self, text: str) -> int:
        if _OTHER.search(text):
            return len(self.encoding.encode_ordinary(text))
        known, missing = self.sizes.get, self.piece
        return sum([known(p) or missing(p) for p in _FAST.findall(text)])


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of text: 0 for an empty one, null for null. Special tokens' strings count as ordinary text."""

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary)
        for texts in batches:
            yield texts.map(lambda t: counter.count(t) if isinstance(t, str) else None).astype("Int64")

    return F.pandas_udf(sizes, T.LongType())(text)


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, lower case, null if empty) and tokens of every document, written once."""
    source = F.lower(F.trim("source"))
    sized = documents.select("doc_id", F.when(source != "", source).alias("source"), token_count(F.col("text"), vocabulary).alias("tokens"))
    return materialized(sized.withColumn("tokens", F.coalesce("tokens", F.lit(0))), "sizes")
