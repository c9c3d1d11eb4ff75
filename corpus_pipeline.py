"""The corpus pipeline: toxicity, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. The toxicity stage learns from the labels of the rows that it is given.

Defined results: null and empty texts are not toxic, are copies of each other, and one of them stays; packed, it is a piece
of one token. Of rows that repeat id and text one stays. Rows without an id are learnt from and scored like others, are copies like
others, and are never near-duplicates. An empty table gives no pieces. Columns besides those of ``documents`` go through all
stages but the last, whatever their names; ties go to the largest id among copies and to the class's own id among near ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, written
from caselode.llm.exact_dedup import deduplicate
from caselode.llm.near_dedup import without_near_copies
from caselode.llm.packing import packed_pieces
from caselode.llm.pii import WHOLE, sanitise
from caselode.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return without_toxic(docs, documents(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return without_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; n_chars follows the new text."""
    return sanitise(docs, **WHOLE).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packed_pieces(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: No SQL: the first stage learns a model, the third draws hashes, the last packs in order; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
