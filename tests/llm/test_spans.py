import random

from inkgauge.llm import spans

SCHEMA = "doc_id bigint, text string, low int, anchor string"


def brute(texts):
    n, seen = spans.SPAN, {}
    for d, t in texts:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(d)
    out = []
    for d, t in texts:
        marks = [i for i in range(len(t or "") - n + 1) if len(seen[t[i : i + n]]) > 1]
        start = end = None
        for i in marks:
            if start is not None and i <= end:
                end = i + n
            else:
                if start is not None:
                    out.append((d, start, end))
                start, end = i, i + n
        if start is not None:
            out.append((d, start, end))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame([(d, t, 5, "clash") for d, t in texts], SCHEMA)
    return sorted(tuple(r) for r in spans.shared_spans(df).collect())


def noise(r, n, letters="abcdefgh  é𝄞"):
    return "".join(r.choice(letters) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(8)
    shared = [noise(r, k) for k in (150, 199, 200, 201, 260, 700)]
    texts = []
    for d in range(40):
        parts = []
        for _ in range(r.randrange(1, 5)):
            s = r.choice(shared)
            a = r.randrange(0, max(1, len(s) - 190))
            parts += [noise(r, r.randrange(0, 300)), s[a:] if r.random() < 0.5 else s[: len(s) - a]]
        texts.append((d, "".join(parts)))
    texts += [(40, texts[0][1]), (41, texts[0][1]), (42, None), (43, ""), (44, "short"), (45, "xyz" * 200), (46, "ab" * 300), (47, "b" + "ab" * 150), (48, "q" * 500), (49, "q" * 230)]
    assert found(spark, texts) == brute(texts)


def test_repeats_within_one_document_do_not_count(spark):
    r = random.Random(9)
    s = noise(r, 300)
    assert found(spark, [(1, s + noise(r, 50) + s), (2, noise(r, 400))]) == []
    two = [(1, s + noise(r, 50) + s), (2, "z" + s[:250])]
    assert found(spark, two) == brute(two)
    assert found(spark, []) == []


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    r = random.Random(10)
    monkeypatch.setattr(spans, "CHUNK", 1000)
    long = noise(r, 5000)
    texts = [(1, long), (2, noise(r, 333) + long[700:4200] + noise(r, 100)), (3, long[950:1170])]
    assert found(spark, texts) == brute(texts)


def test_share(spark):
    r = random.Random(11)
    s = noise(r, 300)
    df = spark.createDataFrame([(1, s, 1, "c"), (2, s + noise(r, 300), 1, "c"), (3, None, 1, "c")], SCHEMA)
    got = {x.doc_id: x for x in spans.shared_share(df, spans.shared_spans(df)).collect()}
    assert got[1].shared_share == 1.0 and got[2].shared_share == 0.5 and got[3].shared_share == 0.0 and got[3].n_chars == 0
