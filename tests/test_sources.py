import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.sources import strict
from inkgauge.streaming import monitors

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.IntegerType())])


def test_lines_are_rejected_with_a_reason(spark):
    lines = ['{"id":"a","x":1}', '{"id":"a","x":1}', '{"id":"b","x":1}', '{"id":"b","x":2}', "", None, "{bad", '{"x":1}', '{"id":"c","x":"no"}', '{"id":"d","x":1}', '{"id":"e","id":"f","x":1}']
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "i int, line string, note string")
    got = {r.i: r.reason for r in strict.checked_lines(df, "line", SCHEMA, "id").select("i", "reason").collect()}
    assert got[0] == got[1] == "duplicate" and sorted([str(got[2]), str(got[3])]) == ["None", "conflict"]
    assert [got[i] for i in (4, 5, 6, 7, 8, 9, 10)] == ["blank", "blank", "malformed", "key missing", "malformed", None, "malformed"]
    assert strict.checked_lines(df.limit(0), "line", SCHEMA, "id").count() == 0


def test_write_once_and_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    strict.write_once(spark.range(3), path)
    with pytest.raises(Exception):
        strict.write_once(spark.range(3), path)
    assert strict.inventory(spark, path).filter("length(sha256) = 64").count() >= 1
    (tmp_path / "x.jsonl").write_text("a\nb\n")
    assert strict.read_lines(spark, str(tmp_path / "x.jsonl")).count() == 2


def test_monitors(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(i, "u", t + timedelta(seconds=10 * i), i not in (3, 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp, failed boolean")
    limited = monitors.rate_limited(df, "user_id", "ts", "event_id", 3, 40).collect()
    assert sum(r.over for r in limited) == 9 and max(r.recent for r in limited) == 4
    found = monitors.outages(df, "user_id", "ts", "failed", 5, 40, 60).collect()
    assert [(r.failures, (r.ended - r.begun).seconds) for r in found] == [(5, 40)]
    assert monitors.outages(df.limit(0), "user_id", "ts", "failed", 5, 40, 60).count() == 0
    folder = str(tmp_path / "events")
    df.write.parquet(folder)
    counts = monitors.stream_counts(spark, folder, df.schema, "ts", "user_id", "1 minute", "1 minute", f"counts_{uuid.uuid4().hex}")
    assert sorted(r.n for r in counts.collect()) == [6, 6]
    for name in ("first", "second"):
        stream = spark.readStream.schema(df.schema).parquet(folder)
        monitors.journal(spark, stream, "event_id", str(tmp_path / "journal"), str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "journal")).count() == 12


def test_written_tables_can_be_removed(spark):
    from inkgauge import session

    before = len(session.tables())
    df = session.materialized(spark.range(3), "removed")
    assert df.count() == 3 and len(session.tables()) == before + 1
    path = Path(session.tables()[-1].removeprefix("file:"))
    assert path.exists() and session.cleared(before) == before and not path.exists()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from inkgauge import session

    sc = N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(N(sparkContext=sc, conf=N(get=lambda *_: None)))


def test_identical_checkpoints_manifests_and_torn_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None), (2, "", 0.5)], "k int, t string, x double")
    target = str(tmp_path / "table")
    strict.write_identical(df, target, ["k"])
    strict.write_identical(df.orderBy("t"), target, ["k"])
    with pytest.raises(ValueError):
        strict.write_identical(df.withColumn("x", F.lit(1.0)), target, ["k"])
    strict.checkpoint_with(df, str(tmp_path / "point"), {"run": "1"})
    assert strict.read_checkpoint(spark, str(tmp_path / "point"), {"run": "1"}).count() == 2
    with pytest.raises(ValueError):
        strict.read_checkpoint(spark, str(tmp_path / "point"), {"run": "2"})
    assert sorted(strict.csv_cache(df, str(tmp_path / "csv")).collect()) == sorted(df.collect())
    assert sorted(strict.json_sink(df, str(tmp_path / "json")).collect()) == sorted(df.collect())
    assert [r.line for r in df.select(strict.markdown("t", "x").alias("line")).collect()] == ["| a\\|b |  |", "|  | 0.5 |"]
    manifest = strict.inventory(spark, target).withColumn("sha256", F.when(F.col("path").endswith("_SUCCESS"), "0").otherwise(F.col("sha256")))
    assert {r.verified for r in strict.checked_manifest(spark, target, manifest.unionByName(manifest.limit(1).withColumn("path", F.lit("gone")))).collect()} <= {True, False}
    lines = spark.createDataFrame([('{"a":1}', False), ('{"a":', True), ('{"a":2}', True), (None, True)], "line string, last boolean")
    assert [r.torn for r in strict.torn_lines(lines, "line", "last").collect()] == [False, True, False, True]
