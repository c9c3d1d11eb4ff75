"""Layouts that are easy to read wrongly, the rows made from them, and their index."""

import pytest
from pyspark.sql import functions as F

from caselode.operators import ingest, structure
from caselode.sources import index_tables

FRONT = "Demonstration Act 2026\n\nCHAPTER 14\n\nBE IT ENACTED by somebody:\n\n"
PART = "                                 PART 1\n\n                           EMPLOYMENT RIGHTS\n\n"
TWO_INSERTS = PART + """1     Amendments

    (1)  In the Employment Rights Act 1996, after section 27B insert—

              Guaranteed hours: further provision

              “27BA  Guaranteed hours

              (1)  An employer must secure that hours are offered.

              “27BB  Guaranteed hours: supplementary

              (1)  In section 27BA, references include an agent's offer.”


2     Guaranteed hours: number of hours

    (1)  An employer must state the number of hours.
"""
SCHEDULES = """1  Seafarers' wages

    (1)  Schedule 5 amends the Seafarers' Wages Act 2023.

                            SCHEDULE 5                     Section 1

                    SEAFARERS' WAGES AND WORKING CONDITIONS

 9          After section 4 insert—

              “4A  Remuneration regulations

                (1)  Regulations may specify requirements.

                            SCHEDULE 6                     Section 1(2)

                    PAY AND CONDITIONS OF SUPPORT STAFF

 2          In the Education Act 2002, after Part 8 insert—

              “148A  The Negotiating Body

                (1)  There is to be a body known as the Negotiating Body.
"""
ONE = PART + "1     Right to guaranteed hours\n\n    (1)  An employer must make an offer.\n"
TEXTS = {
    "two": FRONT + TWO_INSERTS,
    "schedules": FRONT + SCHEDULES,
    "amended": FRONT + """1  Amendments

    (1)  The Trade Union and Labour Relations (Consolidation) Act 1992 is amended
         in accordance with subsections (2) to (6).

    (2)  In Part 3, before section 137 insert—

              “136A  Right to a statement

                (1)  A worker is entitled to a statement.

    (3)  This section applies to agency workers.
""",
    "headers": FRONT + ONE + "\f7      Demonstration Act 2026 (c. 14)\n       Part 1 — Employment rights\n\n                12\n\n               Section 1\n\n    (2)  The offer must be in writing.\n",
    "wrapped": FRONT + PART + "1  Right to guaranteed hours\n\n    (1)  An offer that complies with subsection\n         (2) of that section.\n\n          (2)  Regulations may make provision.\n",
    "heading": FRONT + PART + "                        Zero hours workers, etc\n\n1     Right to guaranteed hours\n\n    (1)  An employer must make an offer.\n",
    "contents": "Contents of an Act\n\n" + PART + "1     Right to guaranteed hours\n2     Number of hours\n\f" + ONE,
    "prose": "just some prose with no structure at all\n",
    "odd \\E [title": "Odd \\E (title Act\n\nBE IT ENACTED\n\n" + ONE + "\f 3 Odd \\E (title Act\n    (2)  More.\n",
    "orphan": FRONT + PART + "    (1)  Nobody's text.\n\n              “3A  Nowhere to go\n\n              (1)  But kept.\n",
    "nothing": None,
}


@pytest.fixture(scope="module")
def tree(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string").selectExpr("*", "1 AS n", "'x' AS kind").repartition(3)
    return ingest.parsed(df).cache()


def rows(df, doc, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.where(F.col("doc_id") == doc).orderBy("ordinal").select(*columns).collect()]


def test_inserted_provisions_name_their_act(tree):
    inserted = tree.where("kind = 'inserted'")
    assert rows(inserted, "two", "host", "inserted_by") == [("Employment Rights Act 1996", "1")] * 2
    assert rows(inserted, "amended", "host") == ["Trade Union and Labour Relations (Consolidation) Act 1992"]
    assert rows(inserted, "schedules", "citation") == ["Seafarers' Wages Act 2023 s.4A (as inserted by Sch. 5 para. 9)", "Education Act 2002 s.148A (as inserted by Sch. 6 para. 2)"]
    assert rows(inserted, "orphan", "citation") == ["the host Act s.3A"]
    assert rows(structure.leaves(tree), "amended", "citation")[-1] == "s.1(3)"


def test_quoted_headings_and_wrapped_references(tree):
    assert rows(tree.where("kind = 'heading'"), "two", "title") == []
    assert rows(tree.where("kind = 'heading'"), "heading", "citation", "breadcrumb") == [("Part 1 — Zero hours workers, etc", "Demonstration Act 2026 > Part 1 Employment Rights > Zero hours workers, etc")]
    assert rows(tree.where("kind = 'subsection'"), "wrapped", "number", "text") == [("1", "An offer that complies with subsection (2) of that section."), ("2", "Regulations may make provision.")]
    assert rows(tree, "two", "kind") == ["part", "section", "subsection", "inserted", "subsection", "inserted", "subsection", "section", "subsection"]


def test_furniture_goes_and_marks_stay(tree):
    assert rows(tree, "headers", "kind", "text") == [("part", ""), ("section", ""), ("subsection", "An employer must make an offer."), ("subsection", "The offer must be in writing.")]
    assert rows(tree.where("kind = 'subsection'"), "odd \\E [title", "breadcrumb") == [f"Odd \\E (title Act > Part 1 Employment Rights > s.1 Right to guaranteed hours > ({n})" for n in (1, 2)]
    assert rows(tree, "contents", "kind") == ["part", "section", "subsection"]  # the contents are front matter
    assert rows(tree, "prose", "kind") == rows(tree, "nothing", "kind") == []


def test_tree_is_a_preorder(tree):
    for doc in TEXTS:
        found = rows(tree, doc, "ordinal", "parent", "path", "children")
        assert [o for o, *_ in found] == list(range(1, len(found) + 1))
        paths = {0: []} | {o: p for o, _, p, _ in found}
        assert all(p == [*paths[parent], o] for o, parent, p, _ in found)
        assert all(n == sum(p == o for _, p, *_ in found) for o, _, _, n in found)


def test_rows(tree):
    leaves, parents = structure.leaves(tree).cache(), structure.parents(tree).cache()
    assert rows(leaves, "two", "id") == ["l00007::Employment Rights Act 1996 s.27BB(1) (as inserted by s.1)", "l00009::s.2(1)"]
    assert rows(leaves, "two", "document")[1].split("\n") == ["Demonstration Act 2026 > Part 1 Employment Rights > s.2 Guaranteed hours: number of hours > (1)", "(1) An employer must state the number of hours."]
    assert leaves.join(parents.select("doc_id", F.col("id").alias("parent_id")), ["doc_id", "parent_id"], "left_anti").isEmpty()
    whole = {(r.doc_id, r.id): r.raw_text for r in parents.collect()}
    assert all(r.raw_text in whole[r.doc_id, r.parent_id] for r in leaves.collect())
    text = whole["two", "p00002::s.1"].split("\n")
    assert text[1] == "s.27BA [Employment Rights Act 1996] Guaranteed hours" and len(text) == 5 and text[-1].startswith("(1) In section 27BA")
    assert rows(leaves, "orphan", "citation") == ["the host Act s.3A(1)"] and structure.checked(tree, 0, 0, 0).where("doc_id = 'orphan'").head().failures == "too many orphans"


def test_ingest_is_one_version(spark, tmp_path):
    path = f"{tmp_path}/index"
    docs = spark.createDataFrame([(k, v) for k, v in TEXTS.items() if k != "orphan"], "doc_id string, text string")
    assert index_tables.newest(spark, path) is None
    first = ingest.ingest(docs, path)
    leaves, parents = ingest.opened(spark, path)
    assert first["tables"] == {"leaves": leaves.count(), "parents": parents.count()} and index_tables.table_count(spark, path, "leaves") == leaves.count()
    assert {r.index_version for r in leaves.collect()} == {first["index_version"]} and len(leaves.head().vector) == 512
    again = ingest.ingest(docs.repartition(3), path)
    assert again["index_version"] == first["index_version"] and again["sequence"] == 2 and leaves.count() == first["tables"]["leaves"]  # open readers keep their rows
    fewer = docs.where("doc_id = 'two'")
    broken = structure.parents(ingest.parsed(fewer)).withColumn("chars", F.when(F.col("ordinal") > 2, F.raise_error(F.lit("lost"))).otherwise(F.col("chars")))
    with pytest.raises(Exception, match="lost"):
        index_tables.publish_tables({"leaves": structure.leaves(ingest.parsed(fewer)), "parents": broken}, path, "p", ingest.EMBEDDER, "c")
    with pytest.raises(ValueError, match="repeated"):
        index_tables.publish_tables({"leaves": leaves.drop("index_version").unionByName(leaves.drop("index_version"))}, path, "p", ingest.EMBEDDER, "c")
    assert index_tables.newest(spark, path)["build"] == again["build"] and ingest.opened(spark, path)[0].count() == first["tables"]["leaves"]
    with pytest.raises(ValueError, match="no leaves"):
        ingest.ingest(docs.where("doc_id = 'prose'"), path)
    assert ingest.corpus_mark(docs) == ingest.corpus_mark(docs.repartition(4)) != ingest.corpus_mark(fewer)
