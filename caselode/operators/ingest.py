"""From documents to a searchable index: parse, leaf and parent rows, vectors, one published version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import retrieval, structure
from caselode.session import checkpointed
from caselode.sources import index_tables

#: Named in every index version; a change of the tree's form or of the vectors changes them.
PARSER, EMBEDDER = "layout-statute-2", "hashing-512"


def parsed(docs: DataFrame) -> DataFrame:
    """The tree of documents (doc_id, text), from a checkpoint, as rows of several kinds are made from it; see ``structure.nodes``."""
    return checkpointed(structure.nodes(structure.classified(structure.body(structure.lines(docs)))))


def corpus_mark(docs: DataFrame) -> str:
    """8 hex digits that stand for all ids and texts of a corpus, whatever their order; sums and counts only."""
    h = F.xxhash64("doc_id", "text")
    found = docs.select(h.alias("h")).agg(F.count("h").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return found.select(F.substring(F.sha2(F.concat_ws(":", "n", "x", "s"), 256), 1, 8)).head()[0]


def vector(document: Column) -> Column:
    return retrieval.hashing_embedding(T.embedding_tokens(document))


def ingest(docs: DataFrame, path: str, tree: DataFrame | None = None) -> dict:
    """Parses docs, embeds leaf and parent rows and publishes both as one version; gives its manifest. tree: docs ``parsed`` already.

    A corpus without a leaf is an error, as nothing could be found in it; ids that repeat are one as well.
    """
    tree = parsed(docs) if tree is None else tree
    leaves, parents = structure.leaves(tree), structure.parents(tree)
    if leaves.isEmpty():
        raise ValueError("the documents have no leaves; nothing is published")
    embedded = lambda rows: rows.withColumn("vector", vector(F.col("document")))
    return index_tables.publish_tables({"leaves": embedded(leaves), "parents": embedded(parents)}, path, PARSER, EMBEDDER, corpus_mark(docs))


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Leaf and parent rows of the published version."""
    return tuple(index_tables.open_index(spark, path, EMBEDDER, name) for name in ("leaves", "parents"))
