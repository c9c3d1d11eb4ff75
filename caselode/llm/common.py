"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.session import shared_folder


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text column, null taken as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/caselode/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` once all that reads them has been written itself; they take up the shared folder for nothing."""
    for df in tables:
        files = df.inputFiles()
        folder = files[0].rpartition("/")[0] if files else ""
        if "/caselode/" in folder:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key with this share of a table's rows, or more, is hot; at most 1 / HOT_KEY keys can be.
HOT_KEY = 1 / 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """key and n, its number of rows, of the keys that hold HOT_KEY of the rows of df or more; at most 1 / HOT_KEY rows."""
    total = df.count()
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, total * HOT_KEY))


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of left, a written table, with right, one row a key, however many rows of left share a key.

    Rows with a hot key stay where they lie and meet broadcast rows of right, at most 1 / HOT_KEY; all others are shuffled.
    right meets the hot keys, each there once, in an inner join: a semi-join would be moved below right's own grouping, where it
    gives all rows of the hot keys instead of one a key.
    """
    hot = F.broadcast(hot_keys(left, key).select(key))
    cold = left.join(hot, key, "left_anti").join(right.hint("merge"), key)
    return cold.unionByName(left.join(F.broadcast(right.join(hot, key)), key))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that starts with stem and that df does not have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, size: int = 128):
    """Arrow batches in slices of few rows, so that the words of a slice fit in memory however long the batch is."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


_MEMORY: dict = {"owner": None, "value": None}


def memory(owner, make):
    """What a worker remembers for the operator that it runs now; another owner's memory is given up first."""
    if _MEMORY["owner"] != owner:
        _MEMORY.update(owner=None, value=None)
        _MEMORY.update(owner=owner, value=make())
    return _MEMORY["value"]
