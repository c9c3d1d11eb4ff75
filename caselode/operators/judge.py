"""Lexical judging of answers and chance-corrected calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T


def groundedness(answer: Column, there: Column) -> Column:
    """Share of the answer's substantive sentences most of whose content words are there, the context's words; 0 if none is."""
    sets = F.filter(F.transform(T.sentences(answer), T.content_words), lambda w: F.size(w) >= L.MIN_WORDS)
    good = F.filter(sets, lambda w: F.size(F.array_intersect(w, there)) / F.size(w) >= L.GROUNDED)
    return F.when(F.size(sets) == 0, 0.0).otherwise(F.round(F.size(good) / F.size(sets), 6))


def citation_coverage(answer: Column, available: Column) -> Column:
    """Share of substantive sentences with a mark that resolves; any mark counts where nothing is available."""
    found = F.filter(T.sentences(answer), lambda s: F.size(T.content_words(s)) >= L.MIN_WORDS)
    cited = F.filter(found, lambda s: F.exists(T.citations(s), lambda c: (F.size(available) == 0) | T.resolves(c, available)))
    return F.when(F.size(found) == 0, 0.0).otherwise(F.round(F.size(cited) / F.size(found), 6))


def relevance(question: Column, there: Column) -> Column:
    return F.round(T.coverage(T.question_terms(question), there), 6)


def scored(rows: DataFrame) -> DataFrame:
    """rows (question, answer, and the context or its content words, context_words) with the judge's scores."""
    rows = rows if "context_words" in rows.columns else rows.withColumn("context_words", T.content_words(F.col("context")))
    q, a, c = (F.col(x) for x in ("question", "answer", "context_words"))
    return rows.withColumns({"groundedness": groundedness(a, c), "context_relevance": relevance(q, c), "answer_relevance": relevance(q, T.content_words(a))})


def kappa(rows: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """Confusion counts, agreement and Cohen's kappa of two 0/1 columns; 0 for no rows or where chance alone agrees."""
    t, p = F.col(label) == 1, F.col(predicted) == 1
    counts = {"tp": t & p, "fp": ~t & p, "tn": ~t & ~p, "fn": t & ~p}
    out = rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    n = F.nullif(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.lit(0))
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    value = F.when(n.isNull() | (pe >= 1), 0.0).otherwise((po - pe) / (1 - pe))
    return out.select(*by, *counts, F.round(F.coalesce(po, F.lit(0.0)), 6).alias("agreement"), F.round(value, 6).alias("kappa"))
