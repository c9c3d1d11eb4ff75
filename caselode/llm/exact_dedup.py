"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's own ``approx_top_k``, a mergeable frequent-items sketch of fixed size) finds the digests
that may hold at least ``HOT_SHARE`` of the rows. Their exact counts are then taken with a map-side combined aggregate,
and these verified winners, at most ``1 / HOT_SHARE`` rows, are broadcast: rows of a hot group are settled where they
lie and are never shuffled. All other digests, none of which can be large, meet in an ordinary shuffle.

Defined results: null text counts as empty, so all null and empty texts are one group; null ids are smaller than all
others; if a group has no id at all, keep_id is null. Rows that repeat both id and text count as copies: ``mark``
flags each of them as kept, ``deduplicate`` returns just one of them. Empty tables give empty results. Columns of the
input other than id and text are never touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.llm.common import documents, fresh, text_of, written

#: A digest with this share of the rows, or more, is hot. At most 1 / HOT_SHARE digests can be.
HOT_SHARE = 1 / 1000
#: Counters of the Misra-Gries summary; its error, under 4 / TRACKED of the rows, lies well below HOT_SHARE.
TRACKED = 16_000


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def hot_groups(keyed: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, hot_id (largest id) and hot_size of the verified heavy hitters; at most 1 / HOT_SHARE rows."""
    view = keyed.select(F.col(key))
    top = view.agg(F.expr(f"approx_top_k(`{key}`, {round(2 / HOT_SHARE)}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    found = top.select("n", F.explode("top").alias("t")).where(F.col("t.count") >= F.col("n") * HOT_SHARE).select(F.col("t.item").alias(key), "n")
    exact = keyed.join(F.broadcast(found), key).groupBy(key, "n").agg(F.max(id_col).alias("hot_id"), F.count("*").alias("hot_size"))
    return exact.where(F.col("hot_size") >= F.col("n") * HOT_SHARE).select(key, "hot_id", "hot_size")


def mark_groups(keyed: DataFrame, key: str, id_col: str) -> DataFrame:
    """Adds keep_id (largest id of equal keys) and group_size to rows of (id, key); no group lands in one task.

    keyed should be cheap to read again (a written table): it is read three times.
    """
    hot = written(hot_groups(keyed, key, id_col), "hot")
    ordinary = keyed.join(F.broadcast(hot.select(key)), key, "left_anti")
    whole = Window.partitionBy(key)
    cold = ordinary.withColumns({"keep_id": F.max(id_col).over(whole), "group_size": F.count(F.lit(1)).over(whole)})
    warm = keyed.join(F.broadcast(hot), key).withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"})
    return cold.unionByName(warm)


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256. The text itself is read once, never shuffled."""
    keyed = written(df.select(F.col(id_col).alias("id"), F.unhex(digest(text_of(text_col))).alias("raw")), "digests")
    marked = mark_groups(keyed.select("id", F.hex("raw").alias("sha")), "sha", "id")
    return marked.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower("sha").alias("text_sha256")
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, one for each text: the one with the largest id, with all its columns.

    Rows of hot groups collapse map-side to one candidate each; the others meet by digest in one shuffle.
    """
    sha, place, hot_sha, hot_id, row = (fresh(df, name) for name in ("sha", "place", "hot_sha", "hot_id", "row"))
    rows = df.withColumn(sha, digest(text_of(text_col)))
    keyed = written(rows.select(F.col(sha).alias("sha"), F.col(id_col).alias("id")), "digests")
    hot = written(hot_groups(keyed, "sha", "id"), "hot").withColumnsRenamed({"sha": sha})
    newest = Window.partitionBy(sha).orderBy(F.col(id_col).desc_nulls_last())
    cold = rows.join(F.broadcast(hot.select(sha)), sha, "left_anti").withColumn(place, F.row_number().over(newest)).where(F.col(place) == 1)
    of = hot.select(F.col(sha).alias(hot_sha), F.col("hot_id").alias(hot_id))
    warm = rows.join(F.broadcast(of), F.col(sha).eqNullSafe(F.col(hot_sha)) & F.col(id_col).eqNullSafe(F.col(hot_id)))
    one = warm.groupBy(sha).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(row)).select(f"{row}.*")
    return cold.select(*df.columns).unionByName(one)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    return mark(documents(spark, sf_dir))


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
