"""Queries over structured documents: the customers of each nation laid out as Acts, then parsed, indexed and searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.operators import ingest, structure
from caselode.session import read_table


def acts(spark, sf_dir):
    """The text of an Act for each nation and 1,000 customer keys.

    A front page with contents and the enacting formula; a part; for each market segment a page with running headers, a
    heading, a section that authorises a schedule, and a subsection for each customer, which refers to itself across a wrapped
    line, or, for a customer in debt, inserts provisions into another Act; then a schedule for each segment, whose first
    paragraph opens with its subsection and whose second inserts a provision without saying where.
    """
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.initcap("n_name").alias("nation"))
    c = read_table(spark, sf_dir, "customer").join(nation, "c_nationkey").withColumn("doc_id", F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / 1000)))
    c = c.withColumns({"s": (F.length("c_mktsegment") * 10 + F.ascii(F.substring("c_mktsegment", 2, 1))).cast("long"), "k": F.col("c_custkey").cast("string"), "segment": F.initcap("c_mktsegment")})
    act, s = F.concat("nation", F.lit(" Accounts Act 2024")), F.col("s").cast("string")
    row = lambda a, b, d, n, *text: F.struct(*[F.lit(x).cast("long").alias(name) if isinstance(x, int) else x.cast("long").alias(name) for name, x in zip("abdn", (a, b, d, n), strict=True)], F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("line"))
    rows = lambda a, b, d, texts: F.array(*[row(a, b, d, n, *(t if isinstance(t, tuple) else (t,))) for n, t in enumerate(texts)])
    head = c.select("doc_id", F.inline(rows(0, 0, 0, [
        act, "", "                    PART 1", "", "1     Contents of the Act", "", "B     E IT ENACTED by the bank as follows:—", "and so on.", "", "                    PART 1", "", "          ACCOUNTS OF THE CUSTOMERS", "",
    ]))).distinct()
    section = c.select("doc_id", F.inline(rows(1, F.col("s"), -1, [
        ("\f  12   ", act), "       Part 1 — Accounts of the customers", "", "   7", "", ("          ", F.col("segment"), " accounts"), "", (s, "     Accounts of ", F.lower("segment")), "",
        ("    (0)  Schedule ", s, " amends the ", F.col("segment"), " Customers Act 2001."), "",
    ]))).distinct()
    due = c.where("c_acctbal >= 0").select("doc_id", F.inline(rows(1, F.col("s"), F.col("c_custkey"), [
        ("    (", F.col("k"), ")  The balance of ", F.col("c_name"), " is kept under subsection"), ("           (", F.col("k"), ") of this section."), "",
    ])))
    debt = [
        ("    (", F.col("k"), ")  In the Debts of ", F.col("nation"), " Act 1990, after section ", F.col("k"), " insert—"), "", "          Debts: further provision", "",
        ("          “", F.col("k"), "A  Debts of ", F.col("c_name")), "", ("          (1)  A debt of ", F.col("c_name"), " is due."), "",
    ]
    interest = [("          “", F.col("k"), "B  Interest on debts"), "", "          (1)  Interest runs.”", ""]
    owed = c.where("c_acctbal < 0").select("doc_id", F.inline(F.when(F.col("c_acctbal") < -500, rows(1, F.col("s"), F.col("c_custkey"), debt + interest)).otherwise(rows(1, F.col("s"), F.col("c_custkey"), debt))))
    schedule = c.select("doc_id", F.inline(rows(2, F.col("s"), 0, [
        ("                 SCHEDULE ", s, "                     Section ", s, "(1)"), "", ("                 ", F.upper("segment"), " CUSTOMERS"), "", " 1     (1) The customers are listed in order.", "     (2)  More may be added.", "",
        " 2     After section 4 insert—", "", "          “4A  Lists of customers", "", "          (1)  A list may be kept.”", "",
    ]))).distinct()
    every = head.unionByName(section).unionByName(due).unionByName(owed).unionByName(schedule)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "d", "n", "line"))), lambda x: x.line), "\n")
    return every.groupBy("doc_id").agg(text.alias("text"))


def tree(spark, sf_dir):
    return ingest.parsed(acts(spark, sf_dir))


def parsed_leaves(spark, sf_dir):
    return structure.leaves(tree(spark, sf_dir)).select("doc_id", "id", "parent_id", "citation", "breadcrumb", "section_number", "section_title", "part", "heading", "page", "text", "document")


def parsed_parents(spark, sf_dir):
    """Parent rows, those of inserted provisions included, with the text of all that stands below."""
    return structure.parents(tree(spark, sf_dir)).select("doc_id", "id", "breadcrumb", "kind", "part", "heading", "child_count", "raw_text", "host_document", "inserted_by")


def inserted_hosts(spark, sf_dir):
    """Which Act each inserted provision goes into, and what inserts it."""
    return tree(spark, sf_dir).where("kind = 'inserted'").groupBy("host", F.regexp_extract("citation", r"inserted by (s\.|Sch\.)", 1).alias("by")).agg(F.count("*").alias("n"))


def node_stats(spark, sf_dir):
    return tree(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def quality_gate(spark, sf_dir):
    return structure.checked(tree(spark, sf_dir), 1, 1, 1)


def running_headers(spark, sf_dir):
    """How many lines the documents have, and how many are left once front pages, running headers and page numbers are gone."""
    rows = structure.lines(acts(spark, sf_dir))
    left = structure.body(rows).groupBy("doc_id").agg(F.count("*").alias("kept"), F.first("document").alias("title"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(left, "doc_id").select("doc_id", "title", "n", "kept")


def document_lines(spark, sf_dir):
    """Lines of all documents: how many, how many blank, and the widest, by language."""
    rows = structure.lines(read_table(spark, sf_dir, "documents"), "lang")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.trim("line") == "").alias("blank"), F.max(F.length("line")).cast("long").alias("widest"))


QUERIES = {f.__name__: f for f in (parsed_leaves, parsed_parents, inserted_hosts, node_stats, quality_gate, running_headers, document_lines)}

#: The tree said by SQL: a row for each node, straight from the tables; ``place`` orders the nodes of a document.
NODES = """c AS (SELECT c_nationkey || '-' || (c_custkey // 1000) AS doc_id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nation, c_custkey AS k, c_name, c_acctbal, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment,
  length(c_mktsegment) * 10 + ascii(c_mktsegment[2]) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT DISTINCT doc_id, nation, nation || ' Accounts Act 2024' AS act FROM c),
g AS (SELECT DISTINCT doc_id, nation, nation || ' Accounts Act 2024' AS act, segment, s, 1 + dense_rank() OVER (PARTITION BY doc_id ORDER BY s) AS page FROM c),
ends AS (SELECT doc_id, max(page) AS last_page FROM g GROUP BY doc_id),
h AS (SELECT *, act || ' > Part 1 Accounts of the Customers' AS part_crumb, act || ' > Part 1 Accounts of the Customers > ' || segment || ' accounts' AS head_crumb, act || ' > Part 1 Accounts of the Customers > ' || segment || ' accounts > s.' || s || ' Accounts of ' || lower(segment) AS crumb,
  act || ' > Schedule ' || s || ' ' || segment || ' Customers' AS sched_crumb, segment || ' Customers Act 2001' AS amended, segment || ' accounts' AS heading FROM g JOIN ends USING (doc_id)),
x AS (SELECT c.*, h.page, h.heading, h.crumb || ' > (' || k || ')' AS sub_crumb, 'Debts of ' || c.nation || ' Act 1990' AS host FROM c JOIN h USING (doc_id, s)),
y AS (SELECT *, sub_crumb || ' > s.' || k || 'A [' || host || '] Debts of ' || c_name AS a_crumb FROM x WHERE c_acctbal < 0),
raw AS (
  SELECT doc_id, [0, 0, 0, 0] AS place, 'part' AS kind, '1' AS number, 'Accounts of the Customers' AS title, '' AS text, 1 AS page, act || ' > Part 1 Accounts of the Customers' AS crumb, 'Part 1' AS cite, []::BIGINT[][] AS provs, '' AS host, '' AS by, 0 AS children, 'Part 1 Accounts of the Customers' AS part, '' AS heading FROM d
  UNION ALL SELECT doc_id, [1, s, 0, 0], 'heading', '', heading, '', page, head_crumb, 'Part 1 — ' || heading, [], '', '', 1, 'Part 1 Accounts of the Customers', heading FROM h
  UNION ALL SELECT doc_id, [1, s, 1, 0], 'section', '' || s, 'Accounts of ' || lower(segment), '', page, crumb, 's.' || s, [[1, s, 1, 0]], '', '', 1 + (SELECT count(*) FROM c WHERE c.doc_id = h.doc_id AND c.s = h.s), 'Part 1 Accounts of the Customers', heading FROM h
  UNION ALL SELECT doc_id, [1, s, 2, 0], 'subsection', '0', '', 'Schedule ' || s || ' amends the ' || amended || '.', page, crumb || ' > (0)', 's.' || s || '(0)', [[1, s, 1, 0]], '', '', 0, 'Part 1 Accounts of the Customers', heading FROM h
  UNION ALL SELECT doc_id, [1, s, 3, k * 10], 'subsection', '' || k, '', CASE WHEN c_acctbal < 0 THEN 'In the ' || host || ', after section ' || k || ' insert— Debts: further provision' ELSE 'The balance of ' || c_name || ' is kept under subsection (' || k || ') of this section.' END, page, sub_crumb, 's.' || s || '(' || k || ')', [[1, s, 1, 0]], '', '', CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END, 'Part 1 Accounts of the Customers', heading FROM x
  UNION ALL SELECT doc_id, [1, s, 3, k * 10 + 1], 'inserted', k || 'A', 'Debts of ' || c_name, '', page, a_crumb, host || ' s.' || k || 'A (as inserted by s.' || s || ')', [[1, s, 1, 0], [1, s, 3, k * 10 + 1]], host, '' || s, 1, 'Part 1 Accounts of the Customers', heading FROM y
  UNION ALL SELECT doc_id, [1, s, 3, k * 10 + 2], 'subsection', '1', '', 'A debt of ' || c_name || ' is due.', page, a_crumb || ' > (1)', host || ' s.' || k || 'A(1) (as inserted by s.' || s || ')', [[1, s, 1, 0], [1, s, 3, k * 10 + 1]], host, '' || s, CASE WHEN c_acctbal < -500 THEN 1 ELSE 0 END, 'Part 1 Accounts of the Customers', heading FROM y
  UNION ALL SELECT doc_id, [1, s, 3, k * 10 + 3], 'inserted', k || 'B', 'Interest on debts', '', page, a_crumb || ' > (1) > s.' || k || 'B [' || host || '] Interest on debts', host || ' s.' || k || 'B (as inserted by s.' || s || ')', [[1, s, 1, 0], [1, s, 3, k * 10 + 1], [1, s, 3, k * 10 + 3]], host, '' || s, 1, 'Part 1 Accounts of the Customers', heading FROM y WHERE c_acctbal < -500
  UNION ALL SELECT doc_id, [1, s, 3, k * 10 + 4], 'subsection', '1', '', 'Interest runs.', page, a_crumb || ' > (1) > s.' || k || 'B [' || host || '] Interest on debts > (1)', host || ' s.' || k || 'B(1) (as inserted by s.' || s || ')', [[1, s, 1, 0], [1, s, 3, k * 10 + 1], [1, s, 3, k * 10 + 3]], host, '' || s, 0, 'Part 1 Accounts of the Customers', heading FROM y WHERE c_acctbal < -500
  UNION ALL SELECT doc_id, [2, s, 0, 0], 'schedule', '' || s, segment || ' Customers', '', last_page, sched_crumb, 'Sch. ' || s, [], '', '', 2, 'Schedule ' || s || ' ' || segment || ' Customers', '' FROM h
  UNION ALL SELECT doc_id, [2, s, 1, 0], 'section', '1', '', '', last_page, sched_crumb || ' > s.1', 'Sch. ' || s || ' para. 1', [[2, s, 1, 0]], '', '', 2, 'Schedule ' || s || ' ' || segment || ' Customers', '' FROM h
  UNION ALL SELECT doc_id, [2, s, 2, n], 'subsection', '' || n, '', CASE n WHEN 1 THEN 'The customers are listed in order.' ELSE 'More may be added.' END, last_page, sched_crumb || ' > s.1 > (' || n || ')', 'Sch. ' || s || ' para. 1(' || n || ')', [[2, s, 1, 0]], '', '', 0, 'Schedule ' || s || ' ' || segment || ' Customers', '' FROM h, range(1, 3) AS r(n)
  UNION ALL SELECT doc_id, [2, s, 3, 0], 'section', '2', 'After section 4 insert—', '', last_page, sched_crumb || ' > s.2 After section 4 insert—', 'Sch. ' || s || ' para. 2', [[2, s, 3, 0]], '', '', 1, 'Schedule ' || s || ' ' || segment || ' Customers', '' FROM h
  UNION ALL SELECT doc_id, [2, s, 4, 0], 'inserted', '4A', 'Lists of customers', '', last_page, sched_crumb || ' > s.2 After section 4 insert— > s.4A [' || amended || '] Lists of customers', amended || ' s.4A (as inserted by Sch. ' || s || ' para. 2)', [[2, s, 3, 0], [2, s, 4, 0]], amended, '2', 1, 'Schedule ' || s || ' ' || segment || ' Customers', '' FROM h
  UNION ALL SELECT doc_id, [2, s, 5, 0], 'subsection', '1', '', 'A list may be kept.', last_page, sched_crumb || ' > s.2 After section 4 insert— > s.4A [' || amended || '] Lists of customers > (1)', amended || ' s.4A(1) (as inserted by Sch. ' || s || ' para. 2)', [[2, s, 3, 0], [2, s, 4, 0]], amended, '2', 0, 'Schedule ' || s || ' ' || segment || ' Customers', '' FROM h),
nodes AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS ordinal, CASE WHEN kind = 'subsection' THEN '(' || number || ') ' || text ELSE text END AS own FROM raw),
units AS (SELECT n.*, p.number AS p_number, p.title AS p_title, 'p' || lpad('' || p.ordinal, 5, '0') || '::' || p.cite AS parent_id FROM nodes n JOIN nodes p ON p.doc_id = n.doc_id AND p.place = n.provs[-1] WHERE n.kind = 'subsection' AND n.children = 0 OR n.kind = 'section' AND n.number = '2' AND n.place[1] = 2),
leaves AS (SELECT doc_id, 'l' || lpad('' || ordinal, 5, '0') || '::' || cite AS id, parent_id, cite AS citation, crumb AS breadcrumb, p_number AS section_number, p_title AS section_title, part, heading, page, text, own, crumb || chr(10) || own AS document FROM units),
below AS (SELECT doc_id, unnest(provs) AS owner, place, CASE WHEN own <> '' THEN own ELSE regexp_extract(crumb, '.* > (s[.].*)', 1) END AS piece FROM nodes),
texts AS (SELECT doc_id, owner, string_agg(piece, chr(10) ORDER BY place) FILTER (place <> owner) AS raw_text FROM below GROUP BY doc_id, owner),
parents AS (SELECT n.doc_id, 'p' || lpad('' || n.ordinal, 5, '0') || '::' || n.cite AS id, n.cite AS citation, n.crumb AS breadcrumb, n.kind, n.part, n.heading, n.children AS child_count, t.raw_text, n.host AS host_document, n.by AS inserted_by FROM nodes n JOIN texts t ON t.doc_id = n.doc_id AND t.owner = n.place)"""

ORACLE_SQL = {
    "parsed_leaves": f"WITH {NODES} SELECT doc_id, id, parent_id, citation, breadcrumb, section_number, section_title, part, heading, page, text, document FROM leaves",
    "parsed_parents": f"WITH {NODES} SELECT doc_id, id, breadcrumb, kind, part, heading, child_count, raw_text, host_document, inserted_by FROM parents",
    "inserted_hosts": f"WITH {NODES} SELECT host, CASE WHEN place[1] = 1 THEN 's.' ELSE 'Sch.' END AS by, count(*) AS n FROM nodes WHERE kind = 'inserted' GROUP BY ALL",
    "node_stats": f"WITH {NODES} SELECT kind, count(*) AS n FROM nodes GROUP BY kind",
    "quality_gate": f"WITH {NODES} SELECT doc_id, count(*) FILTER (kind = 'part') AS parts, count(*) FILTER (kind IN ('section', 'inserted')) AS provisions, count(*) FILTER (kind = 'subsection') AS subsections, 0 AS orphans, 0 AS empty, '' AS failures FROM nodes GROUP BY doc_id",
    "running_headers": """WITH c AS (SELECT c_nationkey || '-' || (c_custkey // 1000) AS doc_id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nation, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT doc_id, any_value(nation) || ' Accounts Act 2024' AS title, count(DISTINCT c_mktsegment) AS g, sum(CASE WHEN c_acctbal < -500 THEN 12 WHEN c_acctbal < 0 THEN 8 ELSE 3 END)::BIGINT AS own FROM c GROUP BY doc_id)
SELECT doc_id, title, 13 + g * (12 + 13) + own AS n, 5 + g * (8 + 13) + own - 1 AS kept FROM n""",
    "document_lines": r"""WITH l AS (SELECT lang, rtrim(unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}\r\n]')), ' ') AS line FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (trim(line, ' ') = '') AS blank, max(length(line)) AS widest FROM l GROUP BY lang""",
}
