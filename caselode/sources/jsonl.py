"""Append-only JSON lines: a tolerant reader that counts what it skips, a strict one that names the line, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caselode.functions.exports import is_json


def _rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """file, line (text) and value (null where it does not parse); blank lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    return lines.withColumn("value", F.from_json("line", schema, {"mode": "PERMISSIVE"})).withColumn("ok", is_json(F.col("line")))


def read_tolerant(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and one row with the number of those that do not."""
    rows = _rows(spark, path, schema)
    return rows.where("ok").select("value.*"), rows.agg(F.count_if(~F.col("ok")).alias("skipped"))


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a log in which a line that does not parse is an error that names its file."""
    rows = _rows(spark, path, schema)
    fail = F.raise_error(F.concat(F.lit("unreadable line in "), F.col("file"), F.lit(": "), F.substring("line", 1, 80)))
    return rows.select(F.when(F.col("ok"), F.col("value")).otherwise(fail).alias("value")).select("value.*")


def append(df: DataFrame, path: str) -> None:
    """Adds rows; existing ones are never rewritten."""
    df.write.mode("append").json(path)


def truncate(spark: SparkSession, path: str, schema: StructType | str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """df, if no key repeats; else an error with the number of repeated keys and the first three."""
    repeated = df.groupBy(key).count().where("count > 1")
    first = [r[0] for r in repeated.orderBy(key).limit(3).collect()]
    if first:
        raise ValueError(f"{repeated.count()} repeated {key}, first {first}")
    return df
