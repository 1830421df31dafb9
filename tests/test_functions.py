import bz2
import lzma
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.functions import codecs, features, stats, text
from inkgauge.operators import geometry, models, resample


def test_code_lengths_are_those_of_the_highest_level():
    r = random.Random(1)
    for n in (0, 1, 10, 1000, 70_000, 300_000):
        data = bytes(r.choice(b"abcdefgh ") for _ in range(n))
        assert codecs.code_length(data, "zlib") == len(zlib.compress(data, 9))
        assert codecs.code_length(data, "bz2") == len(bz2.compress(data, 9))
        assert codecs.code_length(data, "lzma") == len(lzma.compress(data, preset=9))
    with pytest.raises(ValueError):
        codecs.code_length(b"", "none")


def test_bz2_lengths_where_runs_grow():
    for n in (codecs.ONE_BLOCK - 1, codecs.ONE_BLOCK, codecs.ONE_BLOCK + 1, 100_000):
        data = b"".join(bytes([i % 251]) * 4 for i in range(n // 4 + 1))[:n]
        assert codecs.code_length(data, "bz2") == len(bz2.compress(data, 9))


def test_pair_bits_and_gain(spark):
    same = "the quick brown fox jumps over the lazy dog " * 5
    df = spark.createDataFrame([(1, same, same), (2, same, ""), (3, "", same), (4, None, None)], "i int, o string, p string")
    df = df.select("i", codecs.pair_profile(F.col("o"), F.col("p")).alias("x"))
    got = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in codecs.gain(F.col("x"), F.lit(10)).items()]).collect()}
    assert got[1].ratio > got[2].ratio >= 0 and got[1].gain_per_token == got[1].gain / 10
    assert got[3].self_bits == got[3].ratio == 0 and got[4].ratio == 0


def test_distance_is_bounded_and_symmetric_enough():
    assert codecs.distance("", "") == 0
    r = random.Random(2)
    one, other = (" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)) for _ in range(2))
    assert codecs.distance(one, one) < 0.3 < codecs.distance(one, other) <= 1


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_subsequence_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        assert features.common_subsequence(a, b) == brute_lcs(a, b)


def test_features_of_empty_and_null():
    assert set(features.surface_features(None, "")) == {0.0}
    got = dict(zip(features.FEATURES, features.surface_features("a b c", "A b d b")))
    assert got["word_token_coverage"] == 0.5 and got["word_type_coverage"] == 2 / 3 and got["rouge_l_recall"] == 0.5


def test_midranks_and_correlations_against_numpy(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), float(r.randrange(6)), float(r.randrange(6))) for _ in range(300)] + [("c", 1.0, 2.0), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    ranked = stats.midranks(df, ["g"], "x", "rk").collect()
    for g in "abc":
        xs = [v for k, v, _ in rows if k == g]
        for row in ranked:
            if row.g == g:
                less, equal = sum(v < row.x for v in xs), sum(v == row.x for v in xs)
                assert row.rk == less + (equal + 1) / 2
    got = {r.g: r for r in df.dropna().groupBy("g").agg(stats.pearson("x", "y").alias("r"), stats.alpha("x", "y").alias("a")).collect()}
    for g in "ab":
        x, y = (np.array([v[i] for v in rows if v[0] == g]) for i in (1, 2))
        assert math.isclose(got[g].r, np.corrcoef(x, y)[0, 1], abs_tol=1e-9)
        values = np.concatenate([x, y])
        expected = np.mean((values[:, None] - values[None, :]) ** 2) * len(values) / (len(values) - 1)
        assert math.isclose(got[g].a, 1 - np.mean((x - y) ** 2) / expected, abs_tol=1e-9)
    assert got["c"].r is None and got["c"].a is None


def test_text_functions(spark):
    df = spark.createDataFrame([("One two. Three",), ("",), (None,), ("no no no no no no no no",), ("Straße ÉTÉ x_1",)], "t string")
    out = df.withColumn("ws", text.words(F.col("t"))).select(
        text.first_sentence(F.col("t")).alias("s"), text.is_repetitive(F.col("t")).alias("r"), F.array_join(text.words(F.col("t")), " ").alias("w"),
        F.array_join(text.ngrams(F.col("ws"), 2), "|").alias("g"),
    ).collect()
    assert [r.s for r in out[:2]] == ["One two.", ""] and [r.r for r in out] == [False, True, True, False, False]
    assert out[4].w == "strasse été x_1" and out[0].g == "one two|two three" and out[1].g == ""


def test_geometry_edges():
    assert geometry.trajectory([]) == (0, *[0.0] * 11)
    assert geometry.trajectory([" ", None, "x"])[0] == 1 and geometry.trajectory(["x"])[-1] == 0.5
    got = dict(zip(geometry.TRAJECTORY.names, geometry.trajectory(["red apple tree"] * 3)))
    assert got["curvature"] == 0 and 0 <= got["composite"] <= 1
    assert geometry.guidance([]) == 0 and 0 <= geometry.guidance([("tell me of whales " * 9, "tell me of whales " * 9)]) <= 1
    assert math.isclose(sum(v * v for v in geometry.hashed_vector("a b c")), 1.0) and not any(geometry.hashed_vector(None))


def by_pair_bits(exchange):
    history, saved, total = [], 0.0, 0.0
    mean = lambda target, context, place: sum(x[place] for x in codecs.pair_bits(target, context)) / 3
    for prompt, answer in exchange:
        prompt, answer = (prompt or "").strip(), (answer or "").strip()
        before = "\n".join(history)
        history += [f"user: {prompt}"] if prompt else []
        if prompt and answer:
            saved += max(0.0, mean(answer, before, 2) - mean(answer, "\n".join(history), 2))
            total += mean(answer, "", 1)
        history += [f"assistant: {answer}"] if answer else []
    return min(1.0, saved / total) if total else 0.0


def test_path_is_the_greater_of_trajectory_and_guidance_at_less_work(monkeypatch):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["river", "lamp", "valve", "été", "bridge", "road", str(r.random())]) for _ in range(n))
    noise = f"{r.getrandbits(3000)}"
    cases = [([text(20) for _ in range(5)], [text(60) for _ in range(5)]) for _ in range(4)]
    cases += [([noise], [noise]), ([noise, "x"], [noise, "y"]), ([text(90)] * 3, [text(90)] * 3), ([None, "a", " "], ["b", None, "c"]), (["a", "b"], [None, " x "]), ([], [])]
    calls = []
    length = codecs.code_length
    monkeypatch.setattr(codecs, "code_length", lambda data, codec: calls.append((codec, len(data))) or length(data, codec))
    higher = 0
    for prompts, outputs in cases:
        exchange = list(zip(prompts, outputs))
        way = geometry.trajectory(outputs)
        led = by_pair_bits(exchange)
        assert geometry.guidance(exchange) == led
        calls.clear()
        got = geometry.path(prompts, outputs)
        assert got == (max(way[-1], led) if way[0] > 1 else led)
        higher += got == led > way[-1]
        if len(outputs) == 5:
            slow = sum(n for codec, n in calls if codec != "zlib")
            calls.clear()
            geometry.trajectory(outputs), by_pair_bits(exchange)
            assert slow < 0.6 * sum(n for codec, n in calls if codec != "zlib")
    assert higher


def test_medoids_revisits_and_vectors_by_hand():
    rng = np.random.default_rng(5)
    for n in (2, 3, 5, 9):
        d = np.abs(rng.normal(size=(n, n)))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        k = min(3, n)
        medoids, groups = [round(i * (n - 1) / (k - 1)) for i in range(k)], []
        for _ in range(8):
            groups = [min(range(k), key=lambda c: d[i][medoids[c]]) for i in range(n)]
            best = [min((i for i in range(n) if groups[i] == c), key=lambda i: sum(d[i][j] for j in range(n) if groups[j] == c), default=medoids[c]) for c in range(k)]
            if best == medoids:
                break
            medoids = best
        assert math.isclose(geometry.switching_rate(d, 8), sum(a != b for a, b in zip(groups, groups[1:])) / (n - 1))
        w = math.ceil(0.3 * n)
        assert math.isclose(geometry.revisit_score(d), max([0.0, *[1 - d[i, j] for i in range(w) for j in range(n - w, n) if i != j]]))
    assert geometry.vector_trajectory([])[0] == 0 and geometry.vector_trajectory([" ", "x"])[-1] == 0.5
    got = dict(zip(geometry.TRAJECTORY.names, geometry.vector_trajectory(["a b", "a b", "c d"], lambda t: [[1, 0], [1, 0], [0, 1]])))
    assert got["path_length"] == 1 and got["max_distance"] == 1 and got["local_coherence"] == 0.5 and got["curvature"] == 0 and got["revisit_score"] == 0
    assert math.isclose(geometry.alignment([("a b", "A B"), ("a", None), (" ", "a")]), 1.0) and geometry.alignment([]) == 0.0


def test_folds_keep_clusters_whole_and_do_not_depend_on_order(spark):
    rows = [("d" + str(i % 3), f"c{i}", k) for i in range(300) for k in range(1 + i % 7)] + [(None, None, 1)] * 3 + [("d0", "hot", k) for k in range(400)]
    schema = "domain string, cluster string, fold_before int"
    one = {(r.domain, r.cluster, r.fold) for r in models.with_folds(spark.createDataFrame(rows, schema), "domain", "cluster", 1, "fold").collect()}
    other = {(r.domain, r.cluster, r.fold) for r in models.with_folds(spark.createDataFrame(rows[::-1], schema).repartition(3), "domain", "cluster", 1, "fold").collect()}
    assert one == other and len(one) == 302 and {f for _, _, f in one} == set(range(5))
    sizes = {}
    for d, c, _ in rows:
        sizes[d, c] = sizes.get((d, c), 0) + 1
    for d in ("d0", "d1", "d2"):
        load = [sum(sizes[d, c] for x, c, f in one if x == d and f == fold and c != "hot") for fold in range(5)]
        assert max(load) - min(load) <= 16
    assert models.with_folds(spark.createDataFrame([], schema), "domain", "cluster", 1, "fold").count() == 0


def test_ridge_matches_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    z = np.column_stack([np.ones(200), x, y])
    m = z.T @ z
    s = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(s.T @ s + 2.0 * np.eye(3), s.T @ (y - y.mean())) / x.std(0)
    got = models.ridge(m, 2.0)
    assert np.allclose(got[1:], beta) and math.isclose(models.squared_error(m, got), float(((y - np.column_stack([np.ones(200), x]) @ got) ** 2).sum()), rel_tol=1e-9)


def test_bootstrap(spark):
    rows = [("k", f"c{i}", float(i % 5), 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, cluster string, total double, n int")
    means = resample.additive(df, ["k"], "cluster", "total", "n", 100)
    got = resample.intervals(means, ["k"], "mean", 100).first()
    assert math.isclose(got.point, 1.0) and got.low < 1.0 < got.high and got.high - got.low < 0.5 and got.valid == 100
    assert resample.intervals(means.withColumn("mean", F.expr("if(rep % 2 = 0, mean, null)")), ["k"], "mean", 100).first().low is None
    w = {(r.cluster, r.rep): r.w for r in resample.replicated(df, "cluster", 50).collect()}
    assert all(w[f"c{i}", resample.POINT] == 1 for i in range(200)) and 0.95 < sum(v for (_, rep), v in w.items() if rep >= 0) / 10_000 < 1.05
    assert max(w.values()) >= 4 and len(resample.THRESHOLDS) > 15


def test_rank_bootstrap_by_hand(spark):
    rng = np.random.default_rng(2)
    rows = [("e", f"c{i // 3}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(0, 9, 90), rng.integers(0, 9, 90)))] + [("e", "c1", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, cluster string, x double, y double")
    w = {(r.cluster, r.rep): r.w for r in resample.replicated(df.select("cluster").distinct(), "cluster", 4).collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for r in resample.rank_correlations(df, ["k"], "cluster", "x", "y", 4).collect():
        drawn = [(x, y) for _, c, x, y in rows[:-1] for _ in range(w.get((c, r.rep), 0))]
        a, b = (np.array(v) for v in zip(*drawn))
        assert math.isclose(r.rho, np.corrcoef(rank(a), rank(b))[0, 1], abs_tol=1e-9)
    assert resample.rank_correlations(df.filter("k = 'none'"), ["k"], "cluster", "x", "y", 3).count() == 0


def test_strata_keep_their_sizes(spark):
    rows = [("e", "ab"[i % 4 == 0], f"c{i}", float(i % 7), float(i % 5)) for i in range(400)]
    sums = resample.pair_sums(spark.createDataFrame(rows, "k string, s string, cluster string, x double, y double"), ["k", "s", "cluster"], "x", "y")
    got = resample.weighted_sums(resample.replicated(sums, "cluster", 20), ["k"], "s").collect()
    assert len(got) == 21 and all(math.isclose(r.n, 400) for r in got) and len({round(r.x, 6) for r in got}) > 15
