import random

import pytest

from inkgauge.llm import groups

SCHEMA = "paired_id bigint, source_cluster_domain string, source_cluster_id string, source_cluster_fingerprint string, root string, split string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_contraction_against_union_find(spark):
    r = random.Random(4)
    edges = [(f"v{r.randrange(80):02}", f"v{r.randrange(80):02}") for _ in range(70)] + [("v01", "v01"), ("v01", "v02"), ("v02", "v01")]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[find(a)] = find(b)
    got = dict(groups.contract(spark.createDataFrame(edges, "a string, b string")).collect())
    inner = [v for e in edges if e[0] != e[1] for v in e]
    assert set(got) == set(inner)
    assert len({(got[v], find(v)) for v in inner}) == len({got[v] for v in inner}) == len({find(v) for v in inner})


def test_long_path_and_star(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i:03}") for i in range(60)]
    got = dict(groups.contract(spark.createDataFrame(path + star, "a string, b string")).collect())
    assert len({got[f"p{i:03}"] for i in range(61)}) == 1 and len({got[f"s{i:03}"] for i in range(60)} | {got["hub"]}) == 1
    assert groups.contract(spark.createDataFrame([], "a string, b string")).count() == 0


def test_rounds_and_one_task_find_the_same_components(spark, monkeypatch):
    r = random.Random(9)
    edges = spark.createDataFrame([(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(7, None)], "a bigint, b bigint")

    def found():
        parts = {}
        for v, root in groups.contract(edges).collect():
            parts.setdefault(root, set()).add(v)
        assert all(root in part for root, part in parts.items())
        return sorted(map(sorted, parts.values()))

    at_once = found()
    monkeypatch.setattr(groups, "FEW_BYTES", 0)
    in_rounds = found()
    bytes_ = iter([10, 10, 0])
    monkeypatch.setattr(groups, "FEW_BYTES", 5)
    monkeypatch.setattr(groups, "plan_bytes", lambda df: next(bytes_))
    assert at_once == in_rounds == found()


def test_rows_are_related_over_source_and_fingerprint(spark):
    f, g = "AB" * 32, "cd" * 32
    rows = [
        (1, " Arxiv ", "été", f.lower()), (2, "arxiv", "été ", None), (3, "news", "b", f), (4, "news", "c", "legacy-id-fallback"),
        (5, "news", "c", "legacy-id-fallback"), (6, "poetry", "d", "legacy-id-fallback"), (7, None, None, f), (8, None, None, None), (9, None, "", g), (10, None, None, g),
        (11, "news", "b", f),
    ]
    got = {r.paired_id: r for r in groups.related(frame(spark, rows), "paired_id").collect()}
    assert len(got) == 11
    assert {got[i].group_key for i in (1, 2, 3, 7, 11)} == {"arxiv:été"} and {got[i].n_sources for i in (1, 2, 3, 7, 11)} == {2}
    assert got[4].group_key == got[5].group_key == "news:c" and got[6].group_key == "poetry:d" and got[4].n_sources == 1
    assert got[8].group_key is None and got[9].root == got[10].root != got[8].root and got[9].n_sources == 0
    assert groups.related(frame(spark, []), "paired_id").count() == 0


def test_splits_keep_components_and_shares(spark):
    rows = [(i, "d", "hot" if i < 600 else f"s{i // 2}", None) for i in range(2000)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split string, target_share double")
    got = groups.assign_splits(frame(spark, rows), "paired_id", targets).collect()
    assert len(got) == 2000
    by_key = {}
    for r in got:
        by_key.setdefault(r.group_key, set()).add(r.split)
    assert all(len(s) == 1 for s in by_key.values())
    count = {s: sum(r.split == s for r in got) / 2000 for s in ("train", "validation", "test", "none")}
    assert count["train"] == pytest.approx(0.8, abs=0.01) and count["test"] == pytest.approx(0.1, abs=0.01) and count["none"] == 0
