"""Ranks, places and quantiles over counted ranges against NumPy, and the places where users plug in functions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from inkgauge.functions import stats
from inkgauge.operators import plugins

SCHEMA = "k string, i int, v double, w int"


def rows(seed=1, n=600):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 8 + ["a", None]), i, r.choice([None, *[float(r.randrange(40)) for _ in range(6)]]), r.randrange(4)) for i in range(n)]


def test_places_and_quantiles(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.i: r.place for r in stats.places(df, ["k"], [F.desc_nulls_last("v"), F.col("i")], "place").collect()}
    for k in ("hot", "a", None):
        order = sorted((x for x in data if x[0] == k), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        assert [got[x[1]] for x in order] == list(range(1, len(order) + 1))
    wanted = {"low": 0.1, "mid": 0.5, "top": 1.0}
    for weight in (None, "w"):
        found = {r.k: r for r in stats.quantiles(df, ["k"], "v", wanted, weight).collect()}
        for k in ("hot", "a", None):
            values = np.array([x[2] for x in data if x[0] == k and x[2] is not None for _ in range(x[3] if weight else 1)])
            assert all(math.isclose(getattr(found[k], name), np.quantile(values, q)) for name, q in wanted.items())
    whole = {r.k: r for r in stats.describe(df, ["k"], "v").collect()}
    assert whole[None].n == sum(x[0] is None and x[2] is not None for x in data)
    empty = df.filter("i < 0")
    assert stats.quantiles(empty, ["k"], "v", wanted).count() == stats.places(empty, ["k"], [F.col("i")], "p").count() == 0


def test_weighted_midranks(spark):
    data = [(k, i, v, w) for k, i, v, w in rows(2, 200) if v is not None and w > 0]
    got = {r.i: r.rank for r in stats.midranks(spark.createDataFrame(data, SCHEMA).filter("k = 'hot'"), ["k"], "v", "rank", "w").collect()}
    full = np.array([v for k, _, v, w in data if k == "hot" for _ in range(w)])
    assert all(math.isclose(got[i], (full < v).sum() + ((full == v).sum() + 1) / 2) for k, i, v, _ in data if k == "hot")


def test_pseudo_alpha_and_phi(spark):
    r = np.random.default_rng(3)
    x = r.random((12, 5))
    df = spark.createDataFrame([(float(u.sum()), float((u * u).sum())) for u in x], "s double, q double")
    flat = x.ravel()
    inside = np.mean([(u[:, None] - u[None, :]) ** 2 for u in x]) * 5 / 4
    total = ((flat[:, None] - flat[None, :]) ** 2).sum() / (60 * 59)
    assert math.isclose(df.agg(stats.alpha_of(5, F.col("s"), F.col("q")).alias("a")).first().a, 1 - inside / total)
    values = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (-1.0, 1.0), (None, 1.0)], "a double, b double")
    assert [v[0] for v in values.select(stats.phi(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0, None]


def test_plugins(spark):
    df = spark.createDataFrame([(1, "p", "one two three", "x"), (2, "p", None, "x"), (3, None, "", "y")], "pair_id bigint, prompt string, output string, slot string")
    drawn = plugins.with_sampler(df, plugins.template_sampler).collect()
    assert len(drawn) == 6 and {r.cf_prompt for r in drawn if r.pair_id == 1} == {"Write about: one two three", "Topic words: three, one, two"}
    vectors = plugins.with_embedding(df, "output", lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()
    assert [r.embedding for r in vectors] == [[13.0, 1.0], None, [0.0, 1.0]]
    values = {r.slot: r.value for r in plugins.with_metric(df, ["slot"], lambda g: float(len(g))).collect()}
    assert values == {"x": 2.0, "y": 1.0}


def test_p_values(spark):
    df = spark.createDataFrame([(1.959963984540054, 2.0), (0.0, 0.0), (None, None)], "z double, t double")
    got = df.select(stats.normal_p(F.col("z")).alias("a"), stats.student_p(F.col("t"), F.lit(10)).alias("b")).collect()
    assert math.isclose(got[0].a, 0.05, rel_tol=1e-9) and got[1].a == 1.0 and got[2].a is None
    assert math.isclose(got[0].b, 0.07338803, rel_tol=1e-6) and got[1].b == 1.0 and got[2].b is None
