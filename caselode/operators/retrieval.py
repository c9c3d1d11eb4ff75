"""Retrieval over leaf and parent tables: embedding, top-k, small-to-big expansion, context packing, the gated loop."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T
from caselode.operators import vectors
from caselode.session import checkpointed

DIM = 512


@lru_cache(200_000)
def bucket(term: str, dim: int) -> int:
    """A term's place: its 64-bit BLAKE2b digest, big end first, modulo the dimension (a fixed format)."""
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big") % dim


def hashing_embedding(tokens: Column, dim: int = DIM) -> Column:
    """Unit vectors of hashed terms and neighbouring pairs, each weighing 1 + ln(count); no tokens give the first axis."""
    if dim < 32:
        raise ValueError("at least 32 dimensions")

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(batch), 1024):
            rows, places, weights = [], [], []
            part = batch[at : at + 1024]
            for row, words in enumerate(part):
                words = list(words) if words is not None else []
                counts = Counter([*words, *map("_".join, zip(words, words[1:], strict=False))])
                rows += [row] * len(counts)
                places += [bucket(term, dim) for term in counts]
                weights += counts.values()
            m = np.zeros((len(part), dim))
            np.add.at(m, (rows, places), 1 + np.log(np.array(weights, float)))
            empty = ~m.any(axis=1)
            m[empty, 0] = 1.0
            out += list(m / np.sqrt((m * m).sum(axis=1))[:, None])
        return pd.Series(out, index=batch.index, dtype=object)

    return run(tokens)


def different(questions: DataFrame, query: str) -> DataFrame:
    """query_id and vector of the different texts of questions: the text is the id, as equal texts find the same."""
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # texts are short, and would be put together in one
    return questions.select(text_id(query).alias("query_id")).repartition(tasks, "query_id").distinct().withColumn("vector", hashing_embedding(T.embedding_tokens(F.col("query_id"))))


def text_id(query: str) -> Column:
    return F.coalesce(F.col(query), F.lit(""))


def search(questions: DataFrame, leaves: DataFrame, k: int = L.TOP_K) -> DataFrame:
    """The 3k nearest leaves of each question (query_id, vector), ranked, ties by id. questions is the small, stated side."""
    return leaves.drop("vector").join(vectors.nearest(questions, leaves, k * L.OVERFETCH), "id")


HIT = "struct<rank:int,citation:string,text:string,score:double,parent_id:string,expanded:boolean>"


def expanded(hits: DataFrame, parents: DataFrame, k: int = L.TOP_K, cap: int = L.PARENT_CAP) -> DataFrame:
    """Widens the first three hits with a parent to it, drops what the parents cover, and keeps k, in rank order.

    hits: query_id, rank, citation, text, score, parent_id; parents: parent_id, citation, text.
    """
    has = (F.coalesce("parent_id", F.lit("")) != "").cast("int")
    nth = F.sum(has).over(Window.partitionBy("query_id").orderBy("rank"))
    rows = hits.withColumn("_wanted", (has == 1) & (nth <= L.EXPAND_TOP)).join(parents.select("parent_id", F.col("citation").alias("_pc"), F.col("text").alias("_pt")), "parent_id", "left")
    listed = F.array_sort(F.collect_list(F.struct("rank", "citation", "text", "score", "parent_id", "_wanted", "_pc", "_pt")))
    hit = lambda x, c, t, e: F.struct(x.rank.cast("int").alias("rank"), c.alias("citation"), t.alias("text"), x.score.cast("double").alias("score"), x.parent_id.alias("parent_id"), F.lit(e).alias("expanded"))

    def step(acc, x):
        seen = F.array_contains(acc.seen, x.citation)
        state = lambda s, c, o: F.struct(s.alias("seen"), c.alias("covered"), o.alias("out"))
        add = lambda h: F.concat(acc.out, F.array(h))
        leaf, wide = hit(x, x.citation, x.text, False), hit(x, x._pc, x._pt, True)
        plain = F.when(seen | F.array_contains(acc.covered, x.parent_id), acc).otherwise(state(F.concat(acc.seen, F.array(x.citation)), acc.covered, add(leaf)))
        long = F.when(seen, acc).otherwise(state(F.concat(acc.seen, F.array(x.citation)), acc.covered, add(leaf)))
        new = F.when(F.array_contains(acc.seen, x._pc), acc).otherwise(state(F.concat(acc.seen, F.array(x._pc)), F.concat(acc.covered, F.array(x.parent_id)), add(wide)))
        return F.when(~x._wanted | x._pc.isNull(), plain).when(x._pt == "", state(acc.seen, acc.covered, add(leaf))).when(F.length(x._pt) > cap, long).otherwise(new)

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("seen"), none.alias("covered"), F.array().cast(f"array<{HIT}>").alias("out"))
    folded = rows.groupBy("query_id").agg(listed.alias("xs")).select("query_id", F.aggregate("xs", start, step, lambda a: F.slice(a.out, 1, k)).alias("hits"))
    return folded.select("query_id", F.posexplode("hits").alias("place", "h")).select("query_id", "place", "h.citation", "h.text", "h.score", "h.parent_id", "h.expanded")


def packed_context(hits: DataFrame, budget: int = L.BUDGET, least: int = L.MIN_BLOCK) -> DataFrame:
    """The context of each question: blocks [citation] breadcrumb + body, first of a citation wins, cut to the budget.

    hits: query_id, place, citation, breadcrumb, text.
    """
    xs = F.array_sort(F.collect_list(F.struct("place", "citation", "breadcrumb", "text")))

    def step(acc, x):
        head = F.concat(F.lit("["), x.citation, F.lit("] "), x.breadcrumb)
        block = F.when(x.text == "", head).otherwise(F.concat(head, F.lit("\n"), x.text))
        state = lambda left, seen, out, done: F.struct(left.alias("left"), seen.alias("seen"), out.alias("out"), done.alias("done"))
        seen = F.concat(acc.seen, F.array(x.citation))
        left = (acc.left - F.length(block) - 2).cast("int")
        allowed = F.greatest(F.lit(least), acc.left) - F.length(head) - 2
        cut = F.concat(head, F.lit("\n"), F.rtrim(F.substring(x.text, F.lit(1), allowed.cast("int"))), F.lit(" […truncated]"))
        alone = F.when(F.size(acc.out) == 0, F.array(F.substring(head, 1, budget))).otherwise(acc.out)
        fits = state(left, seen, F.concat(acc.out, F.array(block)), left <= least)
        over = state(acc.left, seen, F.when(allowed <= 0, alone).otherwise(F.concat(acc.out, F.array(cut))), F.lit(True))
        return F.when(acc.done | F.array_contains(acc.seen, x.citation), acc).when(F.length(block) <= acc.left, fits).otherwise(over)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(budget).alias("left"), none.alias("seen"), none.alias("out"), F.lit(False).alias("done"))
    return hits.groupBy("query_id").agg(F.array_join(F.aggregate(xs, start, step, lambda a: a.out), "\n\n").alias("context"))


def sufficiency(question: Column, scores: Column, evidence: Column) -> Column:
    """0.35 x mean of the top three scores + 0.65 x coverage of the question's distinctive words; 0 without hits."""
    top = F.slice(F.sort_array(scores, asc=False), 1, L.EXPAND_TOP)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    value = L.SIMILARITY_WEIGHT * F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)) + L.COVERAGE_WEIGHT * T.coverage(T.distinctive(question), T.words(evidence))
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.round(value, 6))


def refined(question: Column, breadcrumbs: Column) -> Column:
    """The question and up to six new distinctive words of the first breadcrumbs."""
    fresh = F.slice(F.array_except(T.kept(T.term_list(F.array_join(F.slice(breadcrumbs, 1, 3), " ")), 5, L.GENERIC), T.words(question)), 1, 6)
    return F.when(F.size(fresh) == 0, question).otherwise(F.concat_ws(" ", question, F.array_join(fresh, " ")))


def route(score: Column, attempts: Column) -> Column:
    return F.when(score >= L.SUFFICIENT, "generate").when(attempts < L.MAX_ATTEMPTS, "refine").otherwise("refuse")


def answered(questions: DataFrame, leaves: DataFrame, parents: DataFrame, k: int = L.TOP_K, query: str = "question") -> DataFrame:
    """One retrieval of a batch of questions (query_id, question and the query to search by): citations, breadcrumbs and sufficiency of
    what is found and expanded. Questions without hits have no row. leaves: id, citation, breadcrumb, text, parent_id, vector; parents: parent_id, citation,
    text and, for what is widened to keep one, breadcrumb."""
    hits = checkpointed(search(different(questions, query), leaves, k).select("query_id", "rank", "citation", "breadcrumb", "text", "score", "parent_id"))
    crumbs = hits.select("citation", "breadcrumb")
    if "breadcrumb" in parents.columns:
        crumbs = crumbs.unionByName(parents.join(hits.select("parent_id").distinct(), "parent_id", "left_semi").select("citation", "breadcrumb"))
    crumbs = crumbs.dropDuplicates(["citation"])
    wide = expanded(hits, parents, k).join(crumbs, "citation", "left").withColumn("breadcrumb", F.coalesce("breadcrumb", F.lit("")))
    xs = F.array_sort(F.collect_list(F.struct("place", "score", "text", "breadcrumb", "citation")))
    of = lambda f: F.transform("xs", f)
    seen = questions.withColumn("_text", text_id(query)).join(wide.groupBy(F.col("query_id").alias("_text")).agg(xs.alias("xs")), "_text")
    evidence = F.array_join(of(lambda x: F.concat_ws(" ", x.text, x.breadcrumb)), " ")
    return seen.select("query_id", of(lambda x: x.citation).alias("citations"), of(lambda x: x.breadcrumb).alias("breadcrumbs"), sufficiency(F.col("question"), of(lambda x: x.score), evidence).alias("sufficiency"))


def asked(questions: DataFrame, leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """The bounded loop over a batch of questions (query_id, question): retrieve, expand, assess, refine what falls short.

    leaves: id, citation, breadcrumb, text, parent_id, vector. Gives query, attempts, sufficiency and route.
    """
    todo, done = questions.withColumn("query", F.col("question")), None
    for attempt in range(1, L.MAX_ATTEMPTS + 1):
        seen = todo.join(answered(todo, leaves, parents, query="query"), "query_id", "left")
        seen = seen.withColumns({"attempts": F.lit(attempt), "sufficiency": F.coalesce("sufficiency", F.lit(0.0)), "breadcrumbs": F.coalesce("breadcrumbs", F.array().cast("array<string>"))})
        seen = checkpointed(seen.withColumns({"route": route(F.col("sufficiency"), F.col("attempts")), "next": refined(F.col("query"), F.col("breadcrumbs"))}).drop("citations", "breadcrumbs"))
        ended = seen.where("route <> 'refine'").drop("next")
        done = ended if done is None else done.unionByName(ended)
        todo = seen.where("route = 'refine'").select("query_id", "question", F.col("next").alias("query"))
    return done
