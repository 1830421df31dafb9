import random

from tests.llm.test_spans import brute, found, noise


def test_a_passage_twice_in_one_document_is_found_at_both_places(spark):
    r = random.Random(12)
    s = noise(r, 2000)
    twice = noise(r, 90) + s + noise(r, 300) + s + noise(r, 70)
    for low, high in ((500, 750), (500, 1100), (0, 230), (1700, 2000)):
        texts = [(1, twice), (2, noise(r, 120) + s[low:high] + noise(r, 80))]
        wanted = brute(texts)
        assert len(wanted) == 3 and found(spark, texts) == wanted
    texts = [(5, twice), (1, noise(r, 40) + s[640:1480] + s[640:1480]), (2, "".join(["xyz" * 120, s[300:900], "xyz" * 90])), (3, "xyz" * 80), (4, s[100:700] + s[:400] + s[100:700])]
    assert found(spark, texts) == brute(texts)


def test_sifting_keeps_every_key_and_drops_most_others(spark, monkeypatch):
    from inkgauge.llm import sift

    rows = spark.range(20_000).selectExpr("id", "id % 7 AS b", "'x' AS clash")
    keys = spark.range(0, 20_000, 50).selectExpr("id", "id % 7 AS b")
    got = {r.id for r in sift.sifted(rows, ["id", "b"], keys).collect()}
    assert set(range(0, 20_000, 50)) <= got and len(got) < 400 + 0.12 * 20_000
    assert sift.sifted(rows, ["id"], keys.limit(0)).count() == 0
    monkeypatch.setattr(sift, "MOST_BITS", 100)
    assert sift.sifted(rows, ["id", "b"], keys).count() == 20_000
