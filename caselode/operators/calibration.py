"""Calibration rows made from contexts, the judge's agreement with their labels in three ways, and the whole gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T
from caselode.operators import evaluation, judge

BLOCK = r"(?s)^\[([^\]\n]{2,160})\][^\n]*\n(.*?)(?:\n\n\[|$)"


def first_block(contexts: DataFrame) -> DataFrame:
    """contexts (query_id, question, context) with the citation and first sentence of their first block; those without one are left out."""
    body = F.regexp_extract("context", BLOCK, 2)
    first = F.get(F.filter(F.transform(F.split(F.regexp_replace(body, r"([.;])\s+", "$1\u0001"), "\u0001"), F.trim), lambda s: s != ""), 0)
    rows = contexts.withColumns({"citation": F.regexp_extract("context", BLOCK, 1), "_first": first}).where("citation <> '' and _first is not null")
    return rows.withColumn("sentence", F.when(F.col("_first").endswith("."), F.col("_first")).otherwise(F.concat("_first", F.lit(".")))).drop("_first")


def rows(contexts: DataFrame, clean: int = L.CLEAN_ROWS) -> DataFrame:
    """id, question, context, answer, human_label and note: the first ``clean`` contexts, by query_id, each quoted, every third with
    invented text; and the hard cases over the first of them, without which agreement would be near perfect."""
    some = first_block(contexts).orderBy("query_id").limit(clean)
    n = F.row_number().over(Window.orderBy("query_id"))  # of at most ``clean`` rows
    some = some.withColumn("n", n)
    quoted = lambda text: F.concat(F.lit("["), F.col("citation"), F.lit("] provides: "), text)
    invented = F.col("n") % 3 == 0
    easy = some.select(
        F.format_string("c%03d", "n").alias("id"), "question", "context", quoted(F.when(invented, F.lit(L.FABRICATED)).otherwise(F.col("sentence"))).alias("answer"),
        F.when(invented, 0).otherwise(1).alias("human_label"), F.when(invented, "fabricated provision text").otherwise("verbatim quotation with a resolvable citation").alias("note"),
    )
    parts = F.filter(F.split(F.regexp_replace("context", r"([.;])\s+", "$1\u0001"), "\u0001"), lambda s: T.any_of(s, L.BOILERPLATE))
    plate = F.coalesce(F.get(parts, 0), F.col("sentence"))
    answers = {"paraphrase": F.lit(L.PARAPHRASE), "partial": quoted(F.concat_ws(" ", "sentence", F.lit(L.INVENTED))), "uncited": F.col("sentence"), "trailing": quoted(F.concat_ws(" ", "sentence", F.lit(L.TRAILING))), "boilerplate": quoted(plate)}
    answer, label, note, known = (F.lit(None) for _ in range(4))
    for i, (kind, human, why) in enumerate(L.HARD_CASES, 1):
        here = F.col("n") == i
        answer, label, note, known = F.when(here, answers[kind]).otherwise(answer), F.when(here, human).otherwise(label), F.when(here, why).otherwise(note), F.when(here, True).otherwise(known)
    hard = some.where(known).select(F.format_string("h%03d", "n").alias("id"), F.when(F.col("n").isin(1, 5), L.PARAPHRASED_QUESTION).otherwise(F.col("question")).alias("question"), "context", answer.alias("answer"), label.alias("human_label"), note.alias("note"))
    return easy.unionByName(hard)


def judged(calibration: DataFrame) -> DataFrame:
    """calibration rows with the judge's four scores, of which shippable is the smaller of support and attribution."""
    scored = judge.scored(calibration).withColumn("citation_coverage", judge.citation_coverage(F.col("answer"), T.citations(F.col("context"))))
    return scored.withColumn("shippable", evaluation.shippable(F.col("groundedness"), F.col("citation_coverage")))


def report(scored: DataFrame, threshold: float = L.KAPPA_CUT) -> DataFrame:
    """Agreement of labels and scores at the threshold: all rows by shippable, the clean ones alone, and all by groundedness alone."""
    def run(name: str, some: DataFrame, score: str) -> DataFrame:
        return judge.kappa(some.withColumn("machine", (F.col(score) >= threshold).cast("int")), "human_label", "machine").withColumn("run", F.lit(name))

    return run("full", scored, "shippable").unionByName(run("clean only", scored.where("id like 'c%'"), "shippable")).unionByName(run("groundedness only", scored, "groundedness"))


def observed(values: DataFrame, name: str, column: Column) -> DataFrame:
    """One gate's observation from a table of one row."""
    return values.select(F.lit(name).alias("name"), column.cast("double").alias("observed"))


def gate(seen: DataFrame, chain: DataFrame, baseline_failures: int, thresholds: dict[str, float] = L.QUALITY_THRESHOLDS) -> DataFrame:
    """The ten gates: nine observations (name, observed) against their thresholds, known failures not to grow, and the audit chains, whose
    threshold is their number of records; and the row "all"."""
    limits = thresholds | {"known failures": float(baseline_failures)}
    rows = evaluation.gates(seen, limits, ("known failures",)).where("name <> 'all'")
    whole = chain.agg(F.sum("verified").cast("double").alias("observed"), F.sum("records").cast("double").alias("threshold"))
    rows = rows.unionByName(whole.select(F.lit("audit chain verifies").alias("name"), "observed", "threshold", (F.col("observed") == F.col("threshold")).alias("passed")))
    return rows.unionByName(rows.agg(F.lit("all").alias("name"), F.count_if("passed").cast("double").alias("observed"), F.lit(float(len(limits) + 1)).alias("threshold")).withColumn("passed", F.col("observed") == F.col("threshold")))
