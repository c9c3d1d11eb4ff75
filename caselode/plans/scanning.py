"""Queries over scans: benchmark texts set into sentences that fire one rule each, or just miss it; findings of all scanners."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import spans as S
from caselode.operators import guard, scanning
from caselode.plans.guard import _BECAUSE, _CAPS, _FORMS, _NEAR, _Q, composed
from caselode.plans.texts import ANY, docs
from caselode.session import read_table

BOX = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][a-z]+"


def question_scan(spark, sf_dir):
    """What fires in each question, and what is left of it."""
    return scanning.scanned_questions(composed(spark, sf_dir), "text").select("item_id", "form", "passed", "reason", "matched", "cleaned")


def block_scan(spark, sf_dir):
    """The forms of an item as the blocks of one request: how many are dropped, for what, and which stay."""
    blocks = composed(spark, sf_dir).select(F.col("item_id").alias("request_id"), F.col("form").alias("place"), F.col("form").alias("block_id"), "text")
    kept, report = scanning.scanned_blocks(blocks)
    stays = kept.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list("block_id")), ", ").alias("kept"))
    return report.join(stays, "request_id", "left").select("request_id", "passed", "reason", "matched", F.array_join("flagged_ids", ", ").alias("flagged"), F.coalesce("kept", F.lit("")).alias("kept"))


def rules_fired(spark, sf_dir):
    """How often each rule fires, by form."""
    rows = composed(spark, sf_dir).select("form", F.explode(scanning.findings(F.col("text"))).alias("m"))
    return rows.groupBy("form", "m.rule").agg(F.count("*").alias("n"))


def outbound_scan(spark, sf_dir):
    """Documents as answers to requests that held their first half: personal data beyond it is a leak."""
    rows = docs(spark, sf_dir).withColumn("held", S.vault(S.entities(F.expr("left(text, length(text) div 2)"))))
    return rows.select("doc_id", scanning.outbound(F.col("text"), F.col("held")).alias("o")).select("doc_id", "o.passed", "o.reason", "o.matched")


def mailbox_lines(spark, sf_dir):
    """Lines of documents that hold a mailbox, as findings with document and line number."""
    return scanning.call_sites(scanning.numbered_lines(docs(spark, sf_dir), "doc_id", "text"), BOX, "scan_mailboxes", "a mailbox in a document")


def findings_by_scanner(spark, sf_dir):
    """The union of all scanners' findings, counted by scanner and severity."""
    names = F.array(*[F.lit(c) for c in L.JUSTIFIED_BY], F.lit("gpu:use"))
    pick = lambda n: F.element_at(names, (n % 8 + 1).cast("int"))
    skills = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, "sync message file")).alias("description"), F.array(pick(F.col("p_partkey")), pick(F.col("p_size"))).alias("capabilities"))
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    entries = d.select("name", F.when(F.col("name") % 11 == 0, None).when(F.col("name") % 7 == 0, F.lit("0")).otherwise(F.col("sha")).alias("pinned"))
    nation = read_table(spark, sf_dir, "nation")
    name = lambda balance: F.concat_ws(":", "n_name", F.floor(F.col(balance) / 100).cast("string")).alias("name")
    run = read_table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s_acctbal")).distinct()
    seen = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c_acctbal")).distinct()
    lines = scanning.numbered_lines(docs(spark, sf_dir), "doc_id", "text")
    every = scanning.every_finding(skills, guard.unjustified(skills), guard.lock_status(entries, d.where("name % 13 <> 0")), guard.surface_changes(run, seen), lines, BOX)
    return every.groupBy("scanner", "severity").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"), F.countDistinct("summary").alias("summaries"))


QUERIES = {f.__name__: f for f in (question_scan, block_scan, rules_fired, outbound_scan, mailbox_lines, findings_by_scanner)}

_BOX = r"[\p{L}\p{M}\p{Nd}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Pc}-]+(?:\.[\p{L}\p{M}\p{Nd}\p{Pc}-]+)+"
_SEND = f"(regexp_matches(x, '{_BOX}') AND ({ANY('lower(x)', [m + v for v in L.SEND_VERBS for m in L.IMPERATIVE_MARKERS])} OR regexp_matches(lower(x), '^(?:{'|'.join(L.SEND_VERBS)})')))"
_FIRST = lambda needles: f"coalesce(list_filter(s, lambda x: {ANY('lower(x)', needles)})[1], left(text, 200))"
_CASE = lambda names: "CASE " + " ".join(f"WHEN contains(low, {_Q(n)}) THEN {_Q(n)}" for n in names) + " END"
SCANNED = f"""f(form, a, n, b) AS (VALUES {_FORMS}), c AS (SELECT item_id, form, a || left(coalesce(text, ''), n) || b AS text FROM benchmark, f),
l AS (SELECT *, lower(text) AS low, list_filter(list_transform(string_split(regexp_replace(text, '([.;:])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM c),
p AS (SELECT *, {_CASE(L.SYSTEM_ADDRESS)} AS phrase, {_CASE(L.TOOL_NAMES)} AS tool, list_filter(s, lambda x: {_SEND})[1] AS sent FROM l),
m AS (SELECT item_id, form, text, list_filter([
  CASE WHEN {_NEAR(L.OVERRIDE_VERBS, L.OVERRIDE_OBJECTS)} THEN {{'rule': 'override_instructions', 'text': {_FIRST(L.OVERRIDE_VERBS)}}} END,
  CASE WHEN phrase IS NOT NULL THEN {{'rule': 'addressed_to_the_system', 'text': coalesce(list_filter(s, lambda x: contains(lower(x), phrase))[1], left(text, 200))}} END,
  CASE WHEN {_NEAR(L.EXTRACTION_VERBS, L.EXTRACTION_OBJECTS, 40)} THEN {{'rule': 'prompt_extraction', 'text': {_FIRST(L.EXTRACTION_OBJECTS)}}} END,
  CASE WHEN tool IS NOT NULL THEN {{'rule': 'names_a_tool', 'text': tool}} END, CASE WHEN sent IS NOT NULL THEN {{'rule': 'imperative_with_recipient', 'text': sent}} END], lambda x: x IS NOT NULL) AS found FROM p)"""
_CUTS = ", ".join(
    f"k{i} AS (SELECT *, CASE WHEN len(found) >= {i} THEN replace({'text' if i == 1 else f'cut{i - 1}'}, found[{i}].text, {_Q(L.REDACTION)}) ELSE {'text' if i == 1 else f'cut{i - 1}'} END AS cut{i} FROM {'m' if i == 1 else f'k{i - 1}'})" for i in range(1, 6)
)
_RULES = "array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.rule))), ', ')"
ORACLE_SQL = {
    "question_scan": f"""WITH {SCANNED}, {_CUTS} SELECT item_id, form, len(found) = 0 AS passed, CASE WHEN len(found) = 0 THEN 'heuristic: no instruction-shaped text in the question' ELSE 'heuristic: ' || {_RULES} || ' in the question' END AS reason,
coalesce(found[1].text, '') AS matched, CASE WHEN len(found) = 0 THEN text WHEN cut5 = text THEN {_Q(L.REDACTION)} ELSE cut5 END AS cleaned FROM k5""",
    "block_scan": f"""WITH {SCANNED}, r AS (SELECT item_id, count(*) AS n, count(*) FILTER (len(found) > 0) AS dropped, list_sort(list_distinct(flatten(list(list_transform(found, lambda x: x.rule))))) AS rules, arg_min(found[1].text, form) FILTER (len(found) > 0) AS first,
  string_agg(form, ', ' ORDER BY form) FILTER (len(found) > 0) AS flagged, string_agg(form, ', ' ORDER BY form) FILTER (len(found) = 0) AS kept FROM m GROUP BY item_id)
SELECT item_id AS request_id, dropped = 0 AS passed, CASE WHEN dropped = 0 THEN 'heuristic: ' || n || ' retrieved block(s), none instruction-shaped' ELSE 'heuristic: dropped ' || dropped || ' of ' || n || ' retrieved block(s) (' || array_to_string(rules, ', ') || ')' END AS reason,
coalesce(first, '') AS matched, coalesce(flagged, '') AS flagged, coalesce(kept, '') AS kept FROM r""",
    "rules_fired": f"WITH {SCANNED} SELECT form, x.rule AS rule, count(*) AS n FROM (SELECT form, unnest(found) AS x FROM m) GROUP BY ALL",
    "mailbox_lines": """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS n FROM documents)
SELECT 'scan_mailboxes' AS scanner, 'FAIL' AS severity, doc_id || ':' || n AS subject, 'a mailbox in a document' AS summary FROM l WHERE regexp_matches(line, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][a-z]+')""",
    "findings_by_scanner": f"""WITH s AS (SELECT p_partkey AS id, lower(concat_ws(' ', p_name, CASE WHEN p_size % 2 = 0 THEN 'sync message file' END)) AS d, unnest([{_CAPS}[p_partkey % 8 + 1], {_CAPS}[p_size % 8 + 1]]) AS capability FROM part),
b(capability, because) AS (VALUES {_BECAUSE}), j AS (SELECT *, regexp_extract_all(d, '{L.TERM.replace("'", "''")}') AS words FROM s LEFT JOIN b USING (capability)),
u AS (SELECT id, bool_or(because IS NULL) AS unknown, string_agg(DISTINCT capability, ', ' ORDER BY capability) AS capabilities FROM j WHERE because IS NULL OR NOT list_has_any(words, because) GROUP BY id),
d AS (SELECT doc_id AS name, sha256(coalesce(text, '')) AS sha FROM documents), e AS (SELECT name, CASE WHEN name % 11 = 0 THEN NULL WHEN name % 7 = 0 THEN '0' ELSE sha END AS pinned FROM d),
k AS (SELECT e.name, CASE WHEN pinned IS NULL THEN 'unpinned' WHEN sha IS NULL THEN 'absent' WHEN sha <> pinned THEN 'moved' ELSE 'ok' END AS status FROM e LEFT JOIN (SELECT * FROM d WHERE name % 13 <> 0) f USING (name)),
r AS (SELECT DISTINCT n_name || ':' || floor(s_acctbal / 100)::BIGINT AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), v AS (SELECT DISTINCT n_name || ':' || floor(c_acctbal / 100)::BIGINT AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS n FROM documents),
every AS (SELECT 'scan_skills' AS scanner, CASE WHEN unknown THEN 'WARN' ELSE 'FAIL' END AS severity, '' || id AS subject, capabilities AS summary FROM u UNION ALL SELECT 'scan_skills', 'PASS', '' || p_partkey, '' FROM part WHERE p_partkey NOT IN (SELECT id FROM u)
  UNION ALL SELECT 'scan_lock', CASE WHEN status IN ('moved', 'absent') THEN 'FAIL' WHEN status = 'unpinned' THEN 'WARN' ELSE 'PASS' END, '' || name, status FROM k
  UNION ALL SELECT 'scan_tool_surface', 'FAIL', name, 'not reviewed' FROM (SELECT * FROM r EXCEPT SELECT * FROM v) UNION ALL SELECT 'scan_tool_surface', 'WARN', name, 'stale' FROM (SELECT * FROM v EXCEPT SELECT * FROM r)
  UNION ALL SELECT 'scan_model', 'FAIL', doc_id || ':' || n, 'link' FROM l WHERE regexp_matches(line, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][a-z]+'))
SELECT scanner, severity, count(*) AS n, min(subject) AS first_subject, count(DISTINCT summary) AS summaries FROM every GROUP BY ALL""",
}
