from collections import Counter

from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import compare, golden, ingest, retrieval, structure, vectors
from caselode.plans.retrieval import golden_rows

ACT = "An Act about Pay 2026\n\nBE IT ENACTED by us\n\n" + "".join(
    f"                 PART {p}\n\n            {name}\n\n" + "".join(f"{10 * p + i}     {title} of {name.lower()} number{i}\n\n    (1)  The {word} of {name.lower()} is settled by officers.\n\n" for i, (title, word) in enumerate([("Power to make rules", "rulebook"), ("Notice: form", "notice"), ("Right to pay", "payment"), ("Records", "recording"), ("Appeals", "appealing"), ("Inspection", "inspector"), ("Fees", "feepaying")]))
    for p, name in [(1, "WAGES"), (2, "HOLIDAYS")]
)


def test_subjects(spark):
    headings = {
        "Right to guaranteed hours of work.": "guaranteed hours of work", "Application for recognition": "application for recognition", "Duty to give notice": "duty to give notice",
        "Guaranteed hours: number of hours": "number of hours (guaranteed hours)", "Tips:": "tips", "Fair allocation of tips": "fair allocation of tips", "Removal of the statutory limit": "removal of the statutory limit",
        "Removal of the statutory limit on awards": "statutory limit on awards",
    }
    got = spark.createDataFrame([(h,) for h in headings], "h string").select("h", golden.subject(F.col("h")).alias("s")).collect()
    assert {r.h: r.s for r in got} == headings


def test_golden_rows(spark):
    tree = ingest.parsed(spark.createDataFrame([("pay", ACT)], "doc_id string, text string")).cache()
    rows = golden.candidates(tree).orderBy("id").collect()
    assert [r.must_cite[0] for r in rows] == [f"s.{p}{i}" for p in (1, 2) for i in (0, 1, 2, 4, 5)]  # number floor(i * 7 / 5) of each part
    assert rows[0].question == "What does section 10 say about rules of wages number0?"
    assert rows[5].question.startswith("What does section 20 say about") and rows[6].question == "What does the document say about form of holidays number1 (notice)?"
    leaves = structure.leaves(tree).withColumn("vector", ingest.vector(F.col("document")))
    parents = structure.parents(tree).select(F.col("id").alias("parent_id"), "citation", "breadcrumb", F.col("raw_text").alias("text"))
    lost = leaves.where("section_number <> '22'")
    every = golden.candidates(tree).unionByName(golden.out_of_scope(spark)).unionByName(golden.known_failures(spark))
    answerable = golden.out_of_scope(spark).limit(1).withColumns({"id": F.lit("r9"), "question": F.lit("What are the fees of wages number6?")})
    passing = golden.candidates(tree).where("id = 'g001'").withColumns({"id": F.lit("k9"), "known_failure": F.lit(True)})
    found = {r.id: r for r in golden.verified(every.unionByName(answerable).unionByName(passing), lost, parents).collect()}
    assert found["g008"].outcome == "known failure" and found["g008"].known_failure and found["g008"].note.endswith("expected citation not in top-6")
    assert Counter(r.outcome for i, r in found.items() if i[0] == "g") == {"kept": 9, "known failure": 1}
    assert found["r9"].outcome == "answered out of scope" and "WARNING: scored" in found["r9"].note and found["k9"].outcome == "now passes"
    assert {found[f"r{i:03d}"].outcome for i in range(1, 6)} == {"kept"} and {found[f"k{i:03d}"].outcome for i in (1, 2)} == {"known failure"}


def test_answers_by_hand(spark):
    tree = ingest.parsed(spark.createDataFrame([("pay", ACT)], "doc_id string, text string")).cache()
    leaves = structure.leaves(tree).withColumn("vector", ingest.vector(F.col("document"))).cache()
    parents = structure.parents(tree).select(F.col("id").alias("parent_id"), "citation", "breadcrumb", F.col("raw_text").alias("text"))
    q = spark.createDataFrame([("q", "fees of holidays number6"), ("none", "")], "query_id string, question string")
    found = {r.query_id: r for r in retrieval.answered(q, leaves, parents).collect()}
    v = leaves.collect()
    ask = q.select(ingest.vector(F.col("question")).alias("v"), T.distinctive(F.col("question")).alias("t")).head()
    best = sorted(v, key=lambda r: (-round(min(1, max(0, sum(a * b for a, b in zip(ask.v, r.vector, strict=True)))), 6), r.id))
    assert found["q"].citations[0] == best[0].citation.split("(")[0] == "s.26" and ask.t == ["holidays", "number6"]
    assert found["q"].sufficiency > 0.65


def test_equal_questions_are_searched_once(spark, monkeypatch):
    tree = ingest.parsed(spark.createDataFrame([("pay", ACT)], "doc_id string, text string")).cache()
    leaves = structure.leaves(tree).withColumn("vector", ingest.vector(F.col("document"))).cache()
    parents = structure.parents(tree).select(F.col("id").alias("parent_id"), "citation", "breadcrumb", F.col("raw_text").alias("text"))
    texts = {f"q{i}": None if i == 5 else ["What are the fees of wages number6?", "fees of holidays number6", ""][i % 3] for i in range(12)}
    q = spark.createDataFrame(list(texts.items()), "query_id string, question string")
    searched, nearest = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda asked, *a, **b: searched.append(asked.count()) or nearest(asked, *a, **b))
    hits = compare.compared(q, compare.windows(spark.createDataFrame([("pay", ACT)], "doc_id string, text string")), leaves, parents).collect()
    found = {r.query_id: (tuple(r.citations), r.sufficiency) for r in retrieval.answered(q.where("query_id <> 'q5'"), leaves, parents).collect()}
    assert searched == [3, 3, 3]
    per = {i: sorted((r.pipeline, r.place, r.id, r.score) for r in hits if r.query_id == i) for i in texts}
    assert len(found) == 11 and all(per[i] == per[f"q{'2' if t is None else int(i[1:]) % 3}"] and len(per[i]) > 3 for i, t in texts.items())
    assert all(found[i] == found[f"q{int(i[1:]) % 3}"] for i in found)


def test_golden_rows_parse_the_acts_once(spark, sf_dir, monkeypatch):
    parsed, calls = ingest.parsed, []
    monkeypatch.setattr(ingest, "parsed", lambda docs: calls.append(1) or parsed(docs))
    golden_rows(spark, sf_dir)
    assert len(calls) == 1
