import random

from inkgauge.functions import codecs
from inkgauge.plans import scoring

SCHEMA = "generation_model string, domain string, id string, level string, pair_id bigint, prompt string, output string"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/level_results.parquet")
    return str(folder)


def test_distances_of_all_level_pairs(spark, tmp_path):
    r = random.Random(3)
    text = {k: " ".join(r.choice(["river", "lamp", "valve", "été", "bridge"]) for _ in range(60)) for k in range(1, 8)}
    rows = [("m", "d", "whole", f"L{k}", k, "p", text[k]) for k in range(1, 6)]
    rows += [("m", "d", "part", "L2", 12, "p", text[2]), ("m", "d", "part", "L4", 14, "p", text[4]), (None, "d", "part", "L1", 19, "p", text[1])]
    rows += [("m", "d", "twice", "L1", 21, "p", text[1]), ("m", "d", "twice", "L1", 20, "p", text[1]), ("m", "d", "twice", "L3", 23, "p", text[3]), ("m", "d", "twice", "L3", 24, "p", text[6])]
    rows += [("m", "d", "none", "L1", 31, "p", text[1]), ("m", "d", "none", "L5", 35, "p", None), ("m", "d", "none", None, 36, "p", text[7])]
    got = {(x.id, x.pair_id, x.other_id): (x.lv, x.l2, x.distance) for x in scoring.P09_level_distances(spark, tables(spark, tmp_path, rows)).collect()}
    pairs = [("whole", a, b, a, b) for a in range(1, 6) for b in range(a + 1, 6)]
    pairs += [("part", 12, 14, 2, 4), ("twice", 20, 23, 1, 3), ("twice", 20, 24, 1, 6)]
    level = {n: lv for _, _, _, lv, n, _, _ in rows}
    assert got == {(i, m, n): (level[m], level[n], round(codecs.distance(text[a], text[b]), 6)) for i, m, n, a, b in pairs}
