"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a stand-alone session. On a cluster the submitted configuration stays as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}

_RUN = uuid.uuid4().hex
_written: list[tuple[SparkSession, str]] = []


def build_session(master: str | None = None, app: str = "inkgauge", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the session names one.

    Only a local session, as in tests on one machine, may leave it unset; a temporary folder is made and set then.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkgauge-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back.

    Unlike a checkpoint, the table keeps column pruning, filter pushdown and a size that the optimizer can see.
    The files are removed by cleared(), at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkgauge-{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: An input below this many bytes per core is redistributed before work that is heavy on CPU.
SMALL_PER_CORE = 4 << 20


def plan_bytes(df: DataFrame) -> int:
    """Size of df as the optimizer estimates it; of a whole table, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, size: int | None = None) -> DataFrame:
    """df over all cores if its input is small, as a small file is often a single row group and so a single task.

    size is the input's size in bytes where it is known better than from the plan, which takes all texts for short.
    Larger inputs come in enough partitions and are left as they are: nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = (plan_bytes(df) if size is None else size) < SMALL_PER_CORE * cores
    return df.repartition(cores) if small else df


def cleared(keep: int = 0) -> int:
    """Removes the tables of materialized() but the first keep, and returns how many are left.

    A long session calls it when it has taken the results of a query: mark = cleared(len(tables())), query, cleared(mark).
    """
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has ended already
            continue
    return len(_written)


def tables() -> list[str]:
    """Paths of the tables of materialized() that have not been removed."""
    return [path for _, path in _written]


atexit.register(cleared)
