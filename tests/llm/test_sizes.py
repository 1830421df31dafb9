import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import mixing, packing, tokens

TEXTS = ["", " ", "Hello, world!", "it's   a\n\n test's  ", "été – 12½ kg²", "don't we'll 3.14 \t x", "漢字かな مرحبا", "a" * 5000, "\x1c\x85​x", "<|endoftext|> ok", "naïve £5 §7 “q” …"]


def test_token_counts_are_the_tokenizers(spark):
    counter = tokens.Counter()
    r = random.Random(1)
    made = ["".join(r.choice(" \n'.,;abcéß²½9-–A") for _ in range(200)) for _ in range(100)]
    for text in TEXTS + made:
        assert counter.count(text) == len(counter.encoding.encode_ordinary(text)), text
    df = spark.createDataFrame([(i, t, "Src ", 1) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, source string, tokens int")
    got = {r.doc_id: r for r in tokens.sized_documents(df).collect()}
    assert got[0].tokens == got[len(TEXTS)].tokens == 0 and got[2].tokens == counter.count(TEXTS[2]) and got[2].source == "src"


SIZED = "doc_id bigint, source string, tokens bigint"
SPECS = "container string, capacity_tokens int, used string"


def sized(spark, n=1500, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "a", "a", "b", "b", None, f"t{i % 9}"]), int(r.lognormvariate(4, 1.5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, SIZED)


def test_best_fit():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randrange(0, 11) for _ in range(r.randrange(1, 40))]
        bins = packing.best_fit(sizes, 10)
        load = Counter()
        for s, b in zip(sizes, bins):
            load[b] += s
        assert max(load.values()) <= 10 and len(load) <= 2 * -(-sum(sizes) // 10) + 1


def test_every_document_is_packed_once_and_nothing_overflows(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 4000)
    rows, df = sized(spark)
    specs = spark.createDataFrame([("small", 64, "x"), ("large", 1000, "x"), ("none", None, "x")], SPECS)
    got = packing.pack(df, specs).collect()
    for container, capacity in (("small", 64), ("large", 1000)):
        mine = [r for r in got if r.container == container]
        whole = Counter()
        for r in mine:
            whole[r.doc_id] += r.tokens
            assert r.start_token == r.piece * capacity and (r.tokens == capacity or (r.piece + 1) * capacity >= rows[r.doc_id][2])
        assert dict(whole) == {i: n for i, _, n in rows}
        load = Counter()
        for r in mine:
            load[r.window, r.bin] += r.tokens
        assert max(load.values()) <= capacity
    assert not [r for r in got if r.container == "none"]
    report = {r.container: r for r in packing.fill(packing.pack(df, specs), specs).collect()}
    assert report["large"].unused_share < 0.05 and report["small"].unused_share < 0.1
    assert packing.pack(df.limit(0), specs).count() == 0


def test_empty_documents_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "EMPTY_ITEMS", 100)
    df = spark.createDataFrame([(i, "void", 0) for i in range(1000)] + [(1000, "a", 5)], SIZED)
    got = packing.pack(df, spark.createDataFrame([("c", 10, "x")], SPECS)).collect()
    assert len({r.window for r in got}) == 10 and len(got) == 1001


def test_windows_hold_the_proportions(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 20_000)
    rows = [(i, "big" if i % 3 else "small", 50 + i % 17) for i in range(6000)]
    specs = spark.createDataFrame([("c", 200, "x")], SPECS)
    monkeypatch.setattr(packing, "CELL_TOKENS", 10_000)
    got = {r.source: r for r in packing.proportions(packing.pack(spark.createDataFrame(rows, SIZED), specs)).collect()}
    assert got["small"].least == pytest.approx(got["small"].share, abs=0.01) and got["big"].most == pytest.approx(got["big"].share, abs=0.01)


def test_draw_meets_budgets_within_one_document(spark):
    rows, df = sized(spark, 3000)
    targets = spark.createDataFrame([(" A", 0.5, 2), ("b", 0.3, 2), ("t1", 0.1, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.draw(df, targets, 60_000)
    used = {r.doc_id: r for r in uses.collect()}
    assert len(used) == 3000
    longest = max(n for _, _, n in rows)
    for r in shares.collect():
        drawn = sum(u.uses * u.tokens for u in used.values() if u.source == r.source)
        budget = min(r.asked, r.available * r.max_repeats)
        assert drawn == r.drawn and budget - longest <= drawn <= budget and r.most_uses <= r.max_repeats
        assert r.capped == (r.asked > budget)
    assert all(u.uses == 0 for u in used.values() if u.source not in ("a", "b", "t1"))
    more = {r.doc_id: r.uses for r in mixing.draw(df, targets, 61_000)[0].collect()}
    assert all(more[i] >= u.uses for i, u in used.items())  # thresholds are nested


def test_draw_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), (None, None, None)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.draw(spark.createDataFrame([], SIZED), targets)
    assert uses.count() == 0 and {r.drawn for r in shares.collect()} == {0}
    same = spark.createDataFrame([(1, "a", 0), (2, "a", 0)], SIZED)
    assert {r.uses for r in mixing.draw(same, targets)[0].collect()} == {0}
    assert mixing.draw(same, targets.limit(0))[0].agg(F.sum("uses")).first()[0] == 0


def test_windows_hold_the_target_proportions(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 4000)
    monkeypatch.setattr(packing, "WINDOW", 1)
    r = random.Random(4)
    rows = [(i, s, r.randrange(1, 60)) for i, s in enumerate(["a"] * 3000 + ["b"] * 1000 + ["c"] * 200 + ["zero"] * 3000 + ["unnamed"] * 500 + [None] * 50)]
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("b", 0.1), ("c", 0.1), ("zero", 0.0), ("absent", 0.4), ("null", None)], "source string, share double")
    got = packing.pack(spark.createDataFrame(rows, SIZED), spark.createDataFrame([("k", 64, "x")], SPECS), shares).collect()
    assert sorted((g.doc_id, g.tokens) for g in got) == sorted((i, n) for i, _, n in rows)
    load, sent, last = Counter(), Counter(), {}
    for g in got:
        load[g.window] += g.tokens
        sent[g.source, g.window] += g.tokens
        last[g.source] = max(last.get(g.source, 0), g.window)
    assert max(load.values()) <= 4000 + 3 * 60
    # Queues end in the order of what they hold over their share; until then each is within one item of its part.
    have = Counter()
    for _, s, n in rows:
        have[s] += n
    turn = {s: have[s] / w for s, w in (("a", 0.5), ("b", 0.4), ("c", 0.1))}
    total = Counter()
    for window in range(max(last["a"], last["b"], last["c"])):
        upto = 4000 * (window + 1)
        low, high = 0.0, max(turn.values())
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(have[s], w * mid) for s, w in (("a", 0.5), ("b", 0.4), ("c", 0.1))) <= upto else (low, mid)
        for s, w in (("a", 0.5), ("b", 0.4), ("c", 0.1)):
            total[s] += sent[s, window]
            assert min(have[s], w * low) - 60 <= total[s] <= min(have[s], w * low) + 1e-3
    first = min(g.window for g in got if g.source in ("zero", "unnamed", None))
    assert first > max(last["a"], last["b"], last["c"]) and len({g.window for g in got}) <= sum(have.values()) // 4000 + 3


def test_what_capped_sources_miss_is_handed_on(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 9 else "a", 10) for i in range(900)], SIZED)
    have = {r.source: r.t for r in df.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.6, 1), ("c", 0.3, 5), ("none", 0.5, 3), ("zero", 0.0, 3)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.draw(df, targets, 9000, refill=True)[1].collect()}
    left = 9000 - have["b"]
    a = min(have["a"], left * 0.1 / 0.4)
    assert got["b"].drawn == have["b"] and abs(got["a"].drawn - a) <= 10 and abs(got["c"].drawn - (left - a)) <= 20 and got["none"].drawn == got["zero"].drawn == 0
    short = {r.source: r.drawn for r in mixing.draw(df, targets, 10**9, refill=True)[1].collect()}
    assert short["a"] == have["a"] and short["b"] == have["b"] and short["c"] == 5 * have["c"]
