"""Stateful checks of event streams, as batch plans and as streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgauge.session import shared_dir


def rate_limited(events: DataFrame, key: str, time: str, ident: str, limit: int, seconds: int) -> DataFrame:
    """events with recent, the events of the same key in the seconds before and with it, and over, whether they exceed limit."""
    at = F.unix_micros(time)
    window = W.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = events.withColumn("recent", F.count(ident).over(window))
    return out.withColumn("over", F.col("recent") > limit)


#: Failures, seconds from the first to the last of them, and most seconds between two, by which a circuit opens (fixed values).
FAILURES, DURATION, GAP = 6, 180, 3600


def failure_runs(events: DataFrame, key: str, time: str, failed: str, gap: int = GAP) -> DataFrame:
    """key, begun, ended, failures: runs of failures of a key, no two more than gap seconds apart.

    A success ends a run. Events of equal time count in the order failed last.
    """
    order = W.partitionBy(key).orderBy(time, failed)
    before = F.lag(time).over(order)
    late = F.unix_micros(time) - F.unix_micros(before) > gap * 1_000_000
    breaks = (~F.col(failed)) | F.coalesce(late, F.lit(False))
    runs = events.withColumn("_run", F.sum(breaks.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).filter(F.col(failed))
    return runs.groupBy(key, "_run").agg(F.min(time).alias("begun"), F.max(time).alias("ended"), F.count("*").alias("failures")).drop("_run")


def outages(events: DataFrame, key: str, time: str, failed: str, least: int = FAILURES, seconds: int = DURATION, gap: int = GAP) -> DataFrame:
    """failure_runs() that open a circuit: at least so many failures over at least so many seconds."""
    lasting = F.unix_micros("ended") - F.unix_micros("begun") >= seconds * 1_000_000
    return failure_runs(events, key, time, failed, gap).filter((F.col("failures") >= least) & lasting)


def stream_counts(spark: SparkSession, folder: str, schema, time: str, key: str, window: str, late: str, name: str) -> DataFrame:
    """Counts per window and key of the Parquet files of folder, read as a stream up to what is there now."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    counts = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"))
    place = f"{shared_dir(spark)}/{name}"
    # Each trigger writes the windows that have changed, numbered; the last word on a window is the latest one.
    write = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{place}/rows")
    query = counts.select("w.start", "w.end", key, "n").writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    latest = F.max_by("n", "epoch").alias("n")
    return spark.read.parquet(f"{place}/rows").groupBy("start", "end", key).agg(latest)


def journal(spark: SparkSession, stream: DataFrame, key: str, target: str, checkpoint: str) -> None:
    """Appends the rows of stream whose key target does not hold yet; a restart goes on where it stopped."""

    def append(batch: DataFrame, _epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
