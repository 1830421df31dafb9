"""Problem 8: long exact spans shared between records.

Every stretch of SPAN characters contains SPAN - BLOCK + 1 blocks of BLOCK characters. The block with the least rolling
hash is its anchor, the same one wherever the stretch occurs. Anchors of neighbouring stretches are mostly the same, so
about two in SPAN - BLOCK characters are kept, and only they are shuffled.

1. One pass over the texts gives, per anchor, the section of text that its stretches cover, as a hash.
2. Anchors of one document are dropped. A section that two documents hold is shared as a whole: the inside of long
   repeats is settled by aggregation.
3. An anchor that comes with different sections is where a repeat begins or ends. For one copy of each such section every
   stretch of SPAN characters is looked up by the hashes of the anchor and of the stretch itself. What is found holds for
   each place where its document has the section.
4. Shared sections and stretches are joined to maximal ones per document.

Copies are never paired: each step asks whether a hash has more than one document, which is a minimum and a maximum. Keys
are two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgauge.functions.types import row
from inkgauge.llm.sift import sifted
from inkgauge.session import materialized

#: Least length of a shared run, in characters (fixed by the task), and the length of a block.
SPAN, BLOCK = 200, 64
#: Characters that are hashed at once; longer texts are taken in overlapping parts of this length, shorter ones together.
CHUNK = 1 << 19
#: Rows that one Arrow batch may hold when sections are written.
_ROWS = 50_000

_SECTIONS = row(anchor="long", section="long", doc_id="long", low="int", more="int", back="int")
_STRETCHES = row(anchor="long", stretch="long", doc_id="long", other="long", low="int", start="int")
_U = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASE)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0..n of a multiplier or of its inverse modulo 2^64."""
    key = (which, int(inverse))
    if key not in _powers or len(_powers[key]) <= n:
        base = np.full(max(n, CHUNK + 4 * SPAN), (_INVERSE if inverse else _BASE)[which], dtype=_U)
        _powers[key] = np.concatenate([np.ones(1, dtype=_U), np.multiply.accumulate(base)])
    return _powers[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rolling(codes: np.ndarray, width: int, which: int) -> np.ndarray:
    """A 64-bit hash of every window of width characters."""
    n = len(codes)
    values = _mix(codes.astype(_U) + _U(1) + _U(which << 40))
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(values * _power(which, False, n)[:n], out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * _power(which, True, n)[: n - width + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each block, position of the anchor of each stretch)."""
    blocks = _rolling(codes, BLOCK, 0)
    # The order of blocks is the upper 44 bits of the hash, then the position: the leftmost of equal blocks is taken.
    packed = (blocks & ~_U((1 << 20) - 1)) | np.arange(len(blocks), dtype=_U)
    return blocks, (_sliding_min(packed, SPAN - BLOCK + 1) & _U((1 << 20) - 1)).astype(np.int64)


def _parts(ids, texts) -> Iterator[tuple[list, list[str], list[int]]]:
    """Texts together up to CHUNK characters; a longer text in parts that overlap by SPAN - 1 characters."""
    batch: tuple[list, list[str], list[int]] = ([], [], [])
    size = 0
    for doc, text in zip(ids, texts):
        if not isinstance(text, str) or len(text) < SPAN or doc is None:
            continue
        for offset in range(0, len(text) - SPAN + 1, CHUNK - SPAN + 1):
            part = text if len(text) <= CHUNK else text[offset : offset + CHUNK]
            if size + len(part) > CHUNK and size:
                yield batch
                batch, size = ([], [], []), 0
            batch[0].append(doc)
            batch[1].append(part)
            batch[2].append(offset)
            size += len(part)
            if len(text) <= CHUNK:
                break
    if size:
        yield batch


def _sections_of(docs: list, parts: list[str], offsets: list[int]) -> dict[str, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    joined = "".join(parts)
    codes = _codes(joined)
    blocks, anchor = _anchors(codes)
    # Stretch i is inside one part unless it crosses a border.
    part_of = np.repeat(np.arange(len(parts)), lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) + SPAN <= ends[part_of]
    change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part_of) != 0) | (np.diff(inside.astype(np.int8)) != 0)) + 1
    low = np.concatenate([[0], change])
    high = np.concatenate([change, [len(anchor)]]) - 1
    keep = inside[low]
    low, high = low[keep], high[keep]
    at, part = anchor[low], part_of[low]
    raw = codes.tobytes()
    digest = xxhash.xxh3_64_intdigest
    section = np.array([digest(raw[4 * a : 4 * (b + SPAN)]) for a, b in zip(low.tolist(), high.tolist())], dtype=_U)
    shift = np.array(offsets)[part] - starts[part]
    return {
        "anchor": blocks[at].view(np.int64), "section": section.view(np.int64), "doc_id": np.array(docs, dtype=np.int64)[part],
        "low": (low + shift).astype(np.int32), "more": (high - low).astype(np.int32), "back": (at - low).astype(np.int32),
    }


def _arrow(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for i in range(0, n, _ROWS):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + _ROWS]) for k, v in columns.items()})


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            yield from _arrow(_sections_of(*part))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every stretch of each section (low, more, back, other) of each text."""
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {k: [] for k in _STRETCHES.names}
        size = 0
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            for s in spans:
                low, more, back = s["low"], s["more"], s["back"]
                codes = _codes(text[low : low + more + SPAN])
                hashes = _rolling(codes, SPAN, 1)
                block = _rolling(codes[back : back + BLOCK], BLOCK, 0)
                n = len(hashes)
                columns = (np.repeat(block.view(np.int64), n), hashes.view(np.int64), np.full(n, doc), np.full(n, s["other"]), np.full(n, low, dtype=np.int32))
                for name, values in zip(_STRETCHES.names, (*columns, np.arange(low, low + n, dtype=np.int32))):
                    found[name].append(values)
                size += n
                if size >= _ROWS:
                    yield from _arrow({k: np.concatenate(v) for k, v in found.items()})
                    found, size = {k: [] for k in _STRETCHES.names}, 0
        if size:
            yield from _arrow({k: np.concatenate(v) for k, v in found.items()})


def joined_stretches(parts: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of the unions of parts (doc_id, low, high) that overlap or touch; high is exclusive."""
    order = W.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("low") > reach, F.lit(True)).cast("long")
    runs = parts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy("doc_id", "_run").agg(F.min("low").alias("start_char"), F.max("high").alias("end_char"))
    return runs.select("doc_id", F.col("start_char").cast("long"), F.col("end_char").cast("long"))


def shared_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): the maximal shared stretches of each document.

    documents: doc_id (unique, not null), text; other columns are ignored. A character is shared if it lies in a run of
    SPAN characters or more that occurs verbatim in another document. Null and shorter texts share nothing; repeats within
    one document alone do not count; an empty table gives no rows.
    """
    texts = documents.select("doc_id", "text")
    sections = materialized(texts.mapInArrow(_sections, _SECTIONS), "sections")
    # Most anchors are of one document; their sections are sifted out before the join.
    repeated = sections.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b")
    repeated = materialized(repeated.select("anchor"), "anchors")
    known = materialized(sifted(sections, ["anchor"], repeated).join(repeated, "anchor"), "known")
    mixed_anchors = known.groupBy("anchor").agg(F.min("section").alias("c"), F.max("section").alias("d")).filter("c <> d")
    mixed_anchors = materialized(mixed_anchors.select("anchor", F.lit(True).alias("mixed")), "mixed")
    known = known.join(mixed_anchors, "anchor", "left").withColumn("single", F.col("mixed").isNull()).drop("mixed")
    mixed = known.filter("not single")
    speakers = mixed.groupBy("anchor", "section").agg(
        F.min(F.struct("doc_id", "low", "more", "back")).alias("s"), F.max("doc_id").alias("other"), F.count("*").alias("places")
    )
    speakers = materialized(speakers.select("anchor", "section", "s.*", "other", "places"), "speakers")
    # Sections of several documents are shared as they are, but others may match a part of them: one copy speaks for all.
    several = speakers.filter("doc_id <> other").select("anchor", "section")
    whole = known.filter("single").unionByName(mixed.join(several, ["anchor", "section"], "left_semi"))
    spans = speakers.groupBy("doc_id").agg(F.collect_list(F.struct("low", "more", "back", "other")).alias("spans"))
    spans = materialized(spans, "spans")
    stretches = materialized(sifted(texts, ["doc_id"], spans).join(spans, "doc_id").mapInArrow(_stretches, _STRETCHES), "stretches")
    twice = stretches.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("a"), F.max("other").alias("b"))
    twice = materialized(twice.filter("a <> b").select("anchor", "stretch"), "twice")
    hits = sifted(stretches.filter("doc_id = other"), ["anchor", "stretch"], twice).join(twice, ["anchor", "stretch"])
    hits = materialized(hits.select("anchor", "doc_id", "low", "start"), "hits")
    # The same section at other places of its one document.
    again = speakers.filter("doc_id = other and places > 1").select("anchor", "section", F.col("low").alias("spoken"))
    again = mixed.join(again, ["anchor", "section"]).filter("low <> spoken")
    again = again.select("anchor", "doc_id", F.col("spoken").alias("low"), (F.col("low") - F.col("spoken")).alias("shift"))
    again = materialized(again, "again")
    moved = sifted(hits, ["anchor", "doc_id", "low"], again).join(again, ["anchor", "doc_id", "low"]).select("doc_id", (F.col("start") + F.col("shift")).alias("start"))
    starts = hits.select("doc_id", "start").unionByName(moved)
    parts = whole.select("doc_id", "low", (F.col("low") + F.col("more") + SPAN).alias("high"))
    return joined_stretches(parts.unionByName(starts.select("doc_id", F.col("start").alias("low"), (F.col("start") + SPAN).alias("high"))))


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document; null and empty texts have length 0 and share 0."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    found = spans.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    out = documents.select("doc_id", size.alias("n_chars")).join(found, "doc_id", "left")
    out = out.withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("shared_share", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)))
