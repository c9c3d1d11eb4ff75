"""Two indexes over the same documents side by side, pages of leaves, and the report over all controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T
from caselode.operators import retrieval, vectors
from caselode.session import checkpointed


def windows(docs: DataFrame, size: int = L.CHUNK, overlap: int = L.OVERLAP) -> DataFrame:
    """The plain index: fixed windows of the texts, with their offsets and vectors, and nothing to cite them by."""
    cut = docs.select("doc_id", F.explode(T.windows(F.coalesce("text", F.lit("")), size, overlap)).alias("w"))
    rows = cut.select(F.format_string("%s/%08d", "doc_id", "w.offset").alias("id"), "w.offset", F.col("w.chunk").alias("text"))
    return rows.withColumn("vector", retrieval.hashing_embedding(T.embedding_tokens(F.col("text"))))


def compared(questions: DataFrame, plain: DataFrame, leaves: DataFrame, parents: DataFrame, k: int = 3) -> DataFrame:
    """query_id, pipeline, place, id, score, citation (empty where a hit has none) and preview: the k hits of each index to each question."""
    by = checkpointed(retrieval.different(questions, "question"))
    hits = vectors.nearest(by, plain, k).join(plain.select("id", "text"), "id")
    simple = hits.select("query_id", F.lit("simple").alias("pipeline"), F.col("rank").cast("int").alias("place"), "id", F.round("score", 4).alias("score"), F.lit("").alias("citation"), T.preview(F.col("text")).alias("preview"))
    found = checkpointed(retrieval.search(by, leaves, k).select("query_id", "rank", "citation", "text", "score", "parent_id"))
    wide = retrieval.expanded(found, parents, k)
    both = simple.unionByName(wide.select("query_id", F.lit("hierarchical").alias("pipeline"), (F.col("place") + 1).cast("int").alias("place"), F.concat_ws("#", "parent_id", "citation").alias("id"), F.round("score", 4).alias("score"), "citation", T.preview(F.col("text")).alias("preview")))
    return questions.select("query_id", retrieval.text_id("question").alias("_text")).join(both.withColumnRenamed("query_id", "_text"), "_text").drop("_text")


def summary(hits: DataFrame) -> DataFrame:
    """Hits, citable hits and the best score of each question, by pipeline."""
    return hits.groupBy("query_id", "pipeline").agg(F.count("*").alias("hits"), F.count_if(F.col("citation") != "").alias("citable"), F.max("score").alias("best"))


def page(rows: DataFrame, limit: int, offset: int, by: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """A page of each group's rows, in order; place counts from 0. A page has 1 to 100 rows."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows and begins at 0 or later")
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("place", place.cast("long")).where((F.col("place") >= offset) & (F.col("place") < offset + limit))


def _long(rows: DataFrame, section, name, metrics: list[str]) -> DataFrame:
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
    return rows.select(section.alias("section"), name.alias("name"), values).select("section", "name", "x.metric", "x.value")


def control_report(controls: DataFrame, provenance: DataFrame, broker: DataFrame) -> DataFrame:
    """section, name, metric and value: controls one by one and combined, repeats with the fence off and on, the broker off and on."""
    on = lambda c: F.when(F.col(c), "on").otherwise("off")
    section = F.when(F.col("control") == "combined", "combined").otherwise("control")
    rows = _long(controls, section, F.col("control"), ["block_rate", "false_positive_rate", "latency_ms", "attacks", "benign_runs"])
    rows = rows.unionByName(_long(provenance, F.lit("provenance"), on("on"), ["mean", "low", "high", "deviation", "repetitions"]))
    return rows.unionByName(_long(broker.withColumn("ok", F.col("ok").cast("int")), F.lit("broker"), on("broker"), ["payloads", "escapes", "ok"]))
