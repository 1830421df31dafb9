"""Strict readers: JSON lines with a reject table, and inventories of files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Column in which Spark keeps a line that does not fit the schema.
_CORRUPT = "_corrupt"


def checked_lines(lines: DataFrame, line: str, schema: T.StructType, key: str) -> DataFrame:
    """lines with the parsed row in parsed and the reason of its rejection in reason, null for a good row.

    Reasons, the first that holds: blank, malformed (no JSON object of the schema, NaN, or a key that comes twice in an object), key missing, duplicate (the
    same content under the same key before), conflict (another content under the same key). "Before" follows the order of
    the content, so that the outcome does not depend on partitions.
    """
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowNonNumericNumbers": "false"}
    out = lines.withColumn("parsed", F.from_json(F.col(line), wide, options))
    out = out.withColumn("_key", F.col("parsed")[key].cast("string")).withColumn("_hash", F.sha2(F.coalesce(F.col(line), F.lit("")), 256))
    bad = (
        F.when(F.trim(F.coalesce(F.col(line), F.lit(""))) == "", "blank")
        .when(F.col("parsed").isNull() | F.col("parsed")[_CORRUPT].isNotNull() | F.try_parse_json(line).isNull(), "malformed")
        .when(F.col("_key").isNull() | (F.trim("_key") == ""), "key missing")
    )
    out = out.withColumn("reason", bad)
    counts = out.filter("reason is null").groupBy("_key", "_hash").agg(F.count("*").alias("_n"))
    keys = counts.groupBy("_key").agg(F.count("*").alias("_contents"), F.min("_hash").alias("_first"))
    repeated = counts.join(keys, "_key").filter("_n > 1 or _contents > 1")
    joined = out.join(repeated, ["_key", "_hash"], "left")
    reason = F.coalesce("reason", F.when(F.col("_contents") > 1, F.when(F.col("_hash") == F.col("_first"), F.when(F.col("_n") > 1, "duplicate")).otherwise("conflict")).when(F.col("_n") > 1, "duplicate"))
    return joined.withColumn("reason", reason).drop("_key", "_hash", "_n", "_contents", "_first")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every line of the text files under path."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def checked_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """manifest (path, size, sha256) with verified: whether the file is there with that size and hash."""
    there = inventory(spark, path).select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    same = (F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha"))
    return manifest.join(there, "path", "left").withColumn("verified", F.coalesce(same, F.lit(False))).drop("_size", "_sha")


def csv_cache(df: DataFrame, folder: str) -> DataFrame:
    """df written as CSV into a new folder and read back with its schema; null and the empty text stay apart."""
    path = f"{folder}/{uuid.uuid4().hex}"
    options = {"header": "true", "nullValue": "\\N", "quote": '"', "escape": '"'}
    df.write.options(**options).csv(path)
    return df.sparkSession.read.schema(df.schema).options(multiLine="true", **options).csv(path)


def json_sink(df: DataFrame, folder: str) -> DataFrame:
    """df written as JSON lines into a new folder, one row a line and nulls kept, and read back with its schema."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_identical(df: DataFrame, path: str, keys: list[str]) -> None:
    """Creates path, or leaves it if it holds the same rows by keys and content; other content is an error."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return write_once(df, path)
    mark = lambda rows, n: rows.select(*keys, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("_h"), F.lit(n).alias("_n"))
    both = mark(df, 1).unionByName(mark(spark.read.parquet(path), -1))
    if not both.groupBy(*keys, "_h").agg(F.sum("_n").alias("d")).filter("d <> 0").isEmpty():
        raise ValueError(f"{path} holds other rows")
    return None


def checkpoint_with(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Parquet at path with meta beside the rows, so that they can't be mistaken for those of another run."""
    write_once(df.withColumn("_meta", F.lit(json.dumps(meta, sort_keys=True))), path)


def read_checkpoint(spark: SparkSession, path: str, meta: dict[str, str]) -> DataFrame:
    """The rows of checkpoint_with(); an error if they were written under other meta."""
    rows = spark.read.parquet(path)
    if not rows.filter(F.col("_meta") != json.dumps(meta, sort_keys=True)).isEmpty():
        raise ValueError(f"{path} was written by another run")
    return rows.drop("_meta")


def torn_lines(lines: DataFrame, line: str, last: str) -> DataFrame:
    """lines with torn: the last line of a file (last true) that is no JSON object, as a writer that was stopped leaves it."""
    whole = F.try_parse_json(line).isNotNull() & F.trim(line).startswith("{")
    return lines.withColumn("torn", F.coalesce(F.col(last) & ~whole, F.lit(False)))


def markdown(*columns: str) -> Column:
    """A row of a Markdown table; bars within a cell are escaped and nulls are empty."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def write_once(df: DataFrame, path: str) -> None:
    """Parquet at path, all or nothing; an existing table is an error."""
    df.write.mode("errorifexists").parquet(path)


def unique_ids(df: DataFrame, key: str, text: str, to: str) -> DataFrame:
    """df with an identifier that is the key where it is unique, else the key, a row number and a hash of the text."""
    by_key = W.partitionBy(key)
    row = F.format_string("__row%04d_", F.row_number().over(by_key.orderBy(F.sha2(text, 256))))
    several = F.concat(key, row, F.substring(F.sha2(text, 256), 1, 8))
    return df.withColumn(to, F.when(F.count("*").over(by_key) > 1, several).otherwise(F.col(key)))
