"""Golden rows: questions made from the sections of documents, each with what it has to find, checked against the index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T
from caselode.operators import retrieval

FIELDS = "doc_id string, id string, question string, intent string, must_cite array<string>, should_refuse boolean, known_failure boolean, note string"


def subject(title: Column) -> Column:
    """A heading as the topic of a question: what stands after a colon first, openings that are no topic dropped."""
    title = F.regexp_replace(F.trim(title), r"\.+$", "")
    head, tail = F.trim(F.substring_index(title, ":", 1)), F.trim(F.regexp_replace(title, "^[^:]*:", ""))
    turned = F.when(~title.contains(":"), title).when(tail == "", F.substring_index(title, ":", 1)).otherwise(F.concat(tail, F.lit(" ("), F.lower(head), F.lit(")")))
    low = F.concat(F.lower(F.substring(turned, 1, 1)), F.substring(turned, 2, 1_000_000))
    rest = F.regexp_extract(low, f"^(?:{'|'.join(L.LEADING_NOISE)})(.*)$", 1)
    return F.when((F.size(F.split(F.trim(rest), r"\s+")) >= 3) | (F.length(rest) >= 18), rest).otherwise(low)


def spread(rows: DataFrame, group: list[str], order: str, count: int) -> DataFrame:
    """count evenly spaced rows of each group, by order: the i-th is number floor(i * n / count); all if there are fewer."""
    inside = Window.partitionBy(*group)
    placed = rows.withColumns({"_at": F.row_number().over(inside.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(inside)})
    wanted = [F.expr(f"CAST({i} * _n DIV {count} AS INT)") for i in range(count)]
    return placed.where((F.col("_n") <= count) | F.col("_at").isin(*wanted)).drop("_at", "_n")


def candidates(tree: DataFrame, per_part: int = L.QUESTIONS_PER_PART, named: bool = False) -> DataFrame:
    """Questions about sections spread over each part of a document, with the citation to be found; schedules are left out.

    With several documents in one index a question has to name its own (named), and citations begin with the document's id.
    """
    body = tree.where("kind = 'section' and container like 'Part %' and citation not like 'Sch. %'")
    chosen = spread(body, ["doc_id", "container"], "ordinal", per_part)
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("container", "ordinal")) - 1
    about = F.concat(subject(F.col("title")), F.lit(" in the "), F.col("document")) if named else subject(F.col("title"))
    question = F.lit(None).cast("string")
    for n, form in enumerate(L.QUESTION_FORMS):
        pieces = [{"{number}": F.col("number"), "{subject}": about}.get(p, F.lit(p)) for p in re.split(r"(\{\w+\})", form)]
        question = F.when(F.col("_i") % len(L.QUESTION_FORMS) == n, F.concat(*pieces)).otherwise(question)
    rows = chosen.withColumn("_i", i).withColumn("question", question)
    cite = F.concat_ws(" ", "doc_id", "citation") if named else F.col("citation")
    return rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.format_string("g%03d", F.col("_i") + 1).alias("id"), "question", T.intent(F.col("question")).alias("intent"), F.array(cite).alias("must_cite"),
        F.lit(False).alias("should_refuse"), F.lit(False).alias("known_failure"), F.concat_ws(" · ", "container", "title").alias("note"),
    )


def out_of_scope(spark: SparkSession) -> DataFrame:
    rows = [("", f"r{i:03d}", q, "", [], True, False, "out of scope") for i, q in enumerate(L.OUT_OF_SCOPE, 1)]
    return spark.createDataFrame(rows, FIELDS).withColumn("intent", T.intent(F.col("question")))


def known_failures(spark: SparkSession) -> DataFrame:
    rows = [("", f"k{i:03d}", q, "", [], False, True, f"paraphrase with no corpus vocabulary ({topic})") for i, (q, topic) in enumerate(L.KNOWN_FAILURES, 1)]
    return spark.createDataFrame(rows, FIELDS).withColumn("intent", T.intent(F.col("question")))


def provisions(citations: Column) -> Column:
    """Citations without their subsections, each once: a widened provision covers its leaves."""
    return F.array_distinct(F.transform(citations, lambda c: F.substring_index(c, "(", 1)))


def verified(rows: DataFrame, leaves: DataFrame, parents: DataFrame, k: int = L.TOP_K) -> DataFrame:
    """rows after one batch search of the index: with outcome (kept, known failure, now passes, answered out of scope), score, and a
    note where the row does not do what it should. leaves and parents as ``retrieval.asked`` takes them."""
    asked = rows.withColumn("query_id", F.concat_ws("/", "doc_id", "id"))
    hits = retrieval.answered(asked.select("query_id", "question"), leaves, parents, k)
    seen = asked.join(hits, "query_id", "left").withColumn("score", F.coalesce("sufficiency", F.lit(0.0)))
    found = F.size(F.array_except(provisions("must_cite"), provisions(F.coalesce("citations", F.array().cast("array<string>"))))) == 0
    outcome = (
        F.when(F.col("should_refuse"), F.when(F.col("score") >= L.SUFFICIENT, "answered out of scope").otherwise("kept"))
        .when(F.col("known_failure"), F.when((F.size("must_cite") > 0) & found, "now passes").otherwise("known failure"))
        .otherwise(F.when(found, "kept").otherwise("known failure"))
    )
    seen = seen.withColumn("outcome", outcome)
    missed = (F.col("outcome") == "known failure") & ~F.col("known_failure")
    note = F.when(F.col("outcome") == "answered out of scope", F.concat("note", F.format_string(" (WARNING: scored %.3f)", "score"))).when(missed, F.concat("note", F.lit(f" · expected citation not in top-{k}"))).otherwise(F.col("note"))
    return seen.select("doc_id", "id", "question", "intent", "must_cite", "should_refuse", (F.col("known_failure") | missed).alias("known_failure"), note.alias("note"), F.round("score", 4).alias("score"), "outcome")


BASELINE = "known_failures array<string>, generated_for map<string, string>, quality_thresholds map<string, double>, note string, sequence long"


def read_baseline(spark: SparkSession, path: str) -> dict | None:
    """The newest baseline of a folder, None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    found = spark.read.schema(BASELINE).json(path).orderBy(F.desc("sequence")).head()
    return found.asDict() if found else None


def write_baseline(rows: DataFrame, path: str, manifest: dict) -> dict:
    """Adds a baseline: which rows (of ``verified``) are known to fail, and for which index. Thresholds and the note are carried over from
    the newest one, as making the rows anew must not relax the gate. Older baselines stay readable."""
    spark = rows.sparkSession
    before = read_baseline(spark, path) or {}
    kept = (before.get("quality_thresholds") or L.QUALITY_THRESHOLDS, before.get("note") or "known_failures must not grow; thresholds ratchet upward only.", before.get("sequence", 0) + 1)
    failing = rows.where("known_failure").agg(F.array_sort(F.collect_set(F.concat_ws("/", F.nullif("doc_id", F.lit("")), "id"))).alias("known_failures"))
    line = spark.createDataFrame([({k: str(manifest[k]) for k in ("corpus_sha", "index_version")}, *kept)], "generated_for map<string, string>, quality_thresholds map<string, double>, note string, sequence long")
    failing.join(F.broadcast(line)).coalesce(1).write.mode("append").json(path)
    return read_baseline(spark, path)


def drift(committed: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows on one side only, repeats counted: missing from what is committed, or stale there."""
    names = committed.columns
    missing = derived.select(*names).exceptAll(committed).withColumn("drift", F.lit("missing"))
    return missing.unionByName(committed.exceptAll(derived.select(*names)).withColumn("drift", F.lit("stale")))
