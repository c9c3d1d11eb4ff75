"""Session defaults used by tests and the benchmark; on a cluster the submitted configuration wins."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "caselode", **extra: str) -> SparkSession:
    """A local session with UTC time, adaptive execution and few shuffle partitions."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    } | extra
    conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="caselode-"))
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One parquet table of a data folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="caselode-"))
    return found.rstrip("/")


def checkpointed(df):
    """df from a checkpoint in the shared folder: its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
