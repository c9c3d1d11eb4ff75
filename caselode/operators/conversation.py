"""Conversations: follow-ups resolved from earlier questions, bounded history, sessions, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T


def questions(turns: DataFrame) -> DataFrame:
    """User turns that are not blank."""
    return turns.where((F.col("role") == "user") & (F.trim("text") != ""))


def contextualised(turns: DataFrame) -> DataFrame:
    """Each question with the query to search for: a follow-up borrows terms from the latest earlier question with a topic.

    The six questions before it are looked at, newest first; those that are follow-ups themselves are passed over, and
    the first that brings new terms lends up to six of them.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-L.LOOK_BACK, -1)
    asked = questions(turns).withColumn("text", F.trim("text")).withColumns({"follows": T.follow_up(F.col("text")), "topic": F.array_distinct(T.topic_terms(F.col("text")))})
    seen = asked.withColumn("earlier", F.reverse(F.collect_list(F.struct("follows", "topic")).over(before)))
    fresh = F.transform(F.filter("earlier", lambda e: ~e.follows), lambda e: F.slice(F.array_except(e.topic, T.words(F.col("text"))), 1, L.BORROWED))
    lent = F.coalesce(F.get(F.filter(fresh, lambda t: F.size(t) > 0), 0), F.array().cast("array<string>"))
    out = seen.withColumn("borrowed", F.when(F.col("follows"), lent).otherwise(F.array().cast("array<string>")))
    query = F.when(F.size("borrowed") > 0, F.concat_ws(" ", "text", F.array_join("borrowed", " "))).otherwise(F.col("text"))
    return out.select("conv_id", "turn", query.alias("query"), (F.size("borrowed") > 0).alias("used_history"), "follows")


def bounded(turns: DataFrame, keep: int = L.HISTORY) -> DataFrame:
    """The last turns of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def sessions(turns: DataFrame, newest: int = 25) -> DataFrame:
    """Per conversation: title (its first question), turns, questions; the newest ones."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    out = turns.groupBy("conv_id").agg(T.preview(first, 63).alias("title"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("questions"), F.max("turn").alias("last_turn"))
    return out.orderBy(F.desc("conv_id")).limit(newest)


def exchanges(turns: DataFrame) -> DataFrame:
    """Each question with the assistant's turn right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"answer": F.lead("text").over(order), "next_role": F.lead("role").over(order), "answer_turn": F.lead("turn").over(order)})
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer", "answer_turn")
