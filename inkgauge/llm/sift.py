"""A filter before a join: most rows whose key the other side lacks are dropped before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each key, and at most, a table of 2^20 rows of 16 bytes.
BITS_PER_KEY, MOST_BITS = 16, 1 << 26


def sifted(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows that may have their columns among those of keys: all that do, and few others. The join is still to come; it
    must be an inner one, as the optimizer moves a semi join before this filter.

    A bit stands for a part of the hashes of the columns. The bits lie in a table of 64-bit words that is broadcast, of at
    most MOST_BITS / 64 rows whatever keys holds; with more keys more rows pass, and beyond MOST_BITS keys all do, unread.
    """
    n = keys.count()
    if n > MOST_BITS:
        return rows
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_PER_KEY * n).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    words = keys.select(place.alias("_place")).selectExpr("_place div 64 AS _word", "shiftleft(1L, cast(_place % 64 AS int)) AS _bit")
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    asked = rows.withColumn("_place", place).withColumn("_word", F.expr("_place div 64"))
    met = asked.join(F.broadcast(words), "_word").filter(F.expr("shiftright(_bits, cast(_place % 64 AS int)) & 1L <> 0"))
    return met.select(*rows.columns)
