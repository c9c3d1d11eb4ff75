"""Index tables: the tables of an index and a manifest, published together; the reader takes the writer's embedder or nothing.

Each publication writes its tables to a folder of its own and then adds one line to the manifests, a file that appears whole
or not at all. Readers take the newest line, so they see the old version until the new one is complete, and one that breaks
off is never seen. Nothing that a reader may hold is ever overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("index_version", "embedding_model", "parser_version", "corpus_sha", "tables", "build", "sequence")
SCHEMA = "index_version string, embedding_model string, parser_version string, corpus_sha string, tables map<string, long>, build string, sequence long"


def corpus_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """First 8 hex digits of the SHA-256 of each source file."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 8).alias("corpus_sha"))


def index_version(parser: str, embedder: str, corpus: str) -> str:
    return f"{parser}+{embedder}+{corpus}"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every published version, oldest first by sequence; none where nothing has been published."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{path}/manifest")


def newest(spark: SparkSession, path: str) -> dict | None:
    found = manifests(spark, path).orderBy(F.desc("sequence"), F.desc("build")).head()
    return found.asDict() if found else None


def publish_tables(tables: dict[str, DataFrame], path: str, parser: str, embedder: str, corpus: str) -> dict:
    """Writes the tables, stamped with their version, then the manifest's line; gives the manifest. An id that repeats within a
    table is an error, and nothing is published."""
    spark = next(iter(tables.values())).sparkSession
    version, build, counts = index_version(parser, embedder, corpus), uuid.uuid4().hex, {}
    for name, df in tables.items():
        df.withColumn("index_version", F.lit(version)).write.parquet(f"{path}/{name}/build={build}")
        rows = spark.read.parquet(f"{path}/{name}/build={build}")
        counts[name] = rows.count()
        key = [c for c in ("doc_id", "id") if c in rows.columns]
        if "id" in rows.columns and not rows.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} has repeated ids; nothing is published")
    before = newest(spark, path)
    line = (version, embedder, parser, corpus, counts, build, before["sequence"] + 1 if before else 1)
    spark.createDataFrame([line], SCHEMA).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return dict(zip(FIELDS, (version, embedder, parser, corpus, counts, build, line[-1]), strict=True))


def publish(df: DataFrame, path: str, parser: str, embedder: str, corpus: str) -> str:
    """An index of one table, named rows; gives its version."""
    return publish_tables({"rows": df}, path, parser, embedder, corpus)["index_version"]


def open_index(spark: SparkSession, path: str, embedder: str, table: str = "rows") -> DataFrame:
    """A table of the newest published version; an error if there is none, a field is missing or another embedder wrote it."""
    found = newest(spark, path)
    missing = [f for f in FIELDS if not found or found[f] is None]
    if missing:
        raise ValueError(f"the manifest lacks {missing}")
    if found["embedding_model"] != embedder:
        raise ValueError(f"the index was embedded by {found['embedding_model']}, not {embedder}")
    return spark.read.parquet(f"{path}/{table}/build={found['build']}")


def table_count(spark: SparkSession, path: str, table: str) -> int:
    """Rows of a table of the newest version, 0 where there is none."""
    found = newest(spark, path)
    return (found["tables"] or {}).get(table, 0) if found else 0


def lock_entries(spark: SparkSession, path: str, pinned_by: str) -> DataFrame:
    """name, path, pinned (SHA-256) and pinned_by of every file below a folder: the rows of a lock file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "path", F.sha2("content", 256).alias("pinned"), F.lit(pinned_by).alias("pinned_by"))
