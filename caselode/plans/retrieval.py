"""Queries over an index of Acts: ingest and reading back, small-to-big expansion, packed contexts, sufficiency, golden rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T
from caselode.functions.stats import exact_mean, with_ranks
from caselode.operators import calibration, golden, ingest, retrieval, structure
from caselode.plans import evaluation
from caselode.plans.structure import NODES, acts, tree
from caselode.plans.texts import ANY, CONTENT, KEPT, REL, TERM, chain_verify, docs, term_coverage
from caselode.plans.texts import ORACLE_SQL as TEXT_SQL
from caselode.session import checkpointed, read_table, shared_folder

#: Hits that a question gets before expansion, and the longest parent here, so that some are wider.
HITS, CAP, KEEP, ROOM = 12, 700, 6, 900
#: Known failures that the baseline of the gate has.
BASELINE_FAILURES = 20


def published(spark, docs, tree=None):
    """The folder of an index of docs, which several passes read, published just now."""
    path = f"{shared_folder(spark)}/caselode/index-{uuid.uuid4().hex}"
    ingest.ingest(docs, path, tree)
    return path


def ingested_index(spark, sf_dir):
    """Leaf and parent rows of a published index, read back, by what they stand in."""
    path = published(spark, checkpointed(acts(spark, sf_dir)))
    leaves, parents = ingest.opened(spark, path)
    row = lambda df, tier, parent: df.select(F.lit(tier).alias("tier"), "doc_id", "id", "citation", parent.alias("parent_id"), "chars", F.sha2("document", 256).alias("sha"), (F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6) == 1).alias("embedded"))
    return row(leaves, "leaf", F.col("parent_id")).unionByName(row(parents, "parent", F.lit("")))


def ranked_hits(spark, sf_dir):
    """For each Act as a question, leaves in the order of their hashes."""
    t = tree(spark, sf_dir)
    leaves = structure.leaves(t).select(F.col("doc_id").alias("query_id"), "id", "citation", "breadcrumb", F.col("raw_text").alias("text"), F.concat_ws("/", "doc_id", "parent_id").alias("parent_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5(F.concat("query_id", "id").cast("binary"))))
    hits = leaves.withColumn("rank", rank).where(F.col("rank") <= HITS).withColumn("score", F.lit(1.0) / F.col("rank"))
    parents = structure.parents(t).select(F.concat_ws("/", "doc_id", "id").alias("parent_id"), "citation", F.col("raw_text").alias("text"), "breadcrumb")
    return hits, parents


def ranked_leaves(spark, sf_dir):
    return structure.leaves(tree(spark, sf_dir)).select("doc_id", "id", "ordinal")


def expanded_hits(spark, sf_dir):
    """The first hits widened to their provisions, what those cover left out."""
    hits, parents = ranked_hits(spark, sf_dir)
    return retrieval.expanded(hits, parents, KEEP, CAP).select("query_id", F.col("place").cast("int").alias("place"), "citation", "text", F.round("score", 6).alias("score"), "expanded")


def packed_contexts(spark, sf_dir):
    """The hits packed into a context of bounded length."""
    hits, _ = ranked_hits(spark, sf_dir)
    return retrieval.packed_context(hits.withColumn("place", F.col("rank")), ROOM, 200)


def text_hits(spark, sf_dir):
    """query_id, question, and the three documents that cover each benchmark text best, as scores, evidence and breadcrumbs."""
    top = term_coverage(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "text", "lang", "source"), "doc_id")
    crumb = F.concat_ws(" > ", F.lit("documents"), "lang", F.substring("text", 1, 120))
    xs = F.array_sort(F.collect_list(F.struct("rank", "coverage", "text", crumb.alias("crumb"))))
    of = lambda name: F.transform("xs", lambda x: x[name])
    found = top.groupBy("item_id").agg(xs.alias("xs")).select("item_id", of("coverage").alias("scores"), F.array_join(of("text"), " ").alias("evidence"), of("crumb").alias("breadcrumbs"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question")).join(found, "item_id")


def sufficiency_of_hits(spark, sf_dir):
    """What the evidence of each benchmark text is worth, where that leads, and the question refined by its breadcrumbs."""
    rows = text_hits(spark, sf_dir).withColumn("score", retrieval.sufficiency(F.col("question"), F.col("scores"), F.col("evidence")))
    return rows.select("item_id", "score", retrieval.route(F.col("score"), F.lit(1)).alias("first_route"), retrieval.route(F.col("score"), F.lit(L.MAX_ATTEMPTS)).alias("last_route"), retrieval.refined(F.col("question"), F.col("breadcrumbs")).alias("refined"))


def _keyed(index):
    """Leaves and parents of an index under ids that are its own across documents."""
    leaves, parents = index
    key = lambda c: F.concat_ws("/", "doc_id", c)
    cite = F.concat_ws(" ", "doc_id", "citation")
    return leaves.withColumns({"id": key("id"), "parent_id": key("parent_id"), "citation": cite}), parents.withColumns({"parent_id": key("id"), "citation": cite})


def asked_questions(spark, sf_dir):
    """The gated loop over questions about each segment of each Act, against the published index."""
    leaves, parents = _keyed(ingest.opened(spark, published(spark, checkpointed(acts(spark, sf_dir)))))
    heads = leaves.where("heading <> ''").select("doc_id", "heading").distinct()
    questions = heads.select(F.concat_ws("/", "doc_id", "heading").alias("query_id"), F.concat(F.lit("How are "), F.lower("heading"), F.lit(" of Act "), "doc_id", F.lit(" kept?")).alias("question"))
    return retrieval.asked(questions, leaves, parents.select("parent_id", "citation", "breadcrumb", F.col("raw_text").alias("text"))).select("query_id", "attempts", F.round("sufficiency", 4).alias("sufficiency"), "route")


def golden_candidates(spark, sf_dir):
    """Questions spread over the sections of each part, with the citation that each one has to find."""
    t = tree(spark, sf_dir)
    return golden.candidates(t, named=True).select("doc_id", "id", "question", "intent", "must_cite", "note")


def golden_rows(spark, sf_dir):
    """The candidates and questions out of scope, checked against the index that they were drawn from."""
    docs = checkpointed(acts(spark, sf_dir))
    t = ingest.parsed(docs)
    leaves, parents = _keyed(ingest.opened(spark, published(spark, docs, t)))
    rows = golden.candidates(t, named=True).unionByName(golden.out_of_scope(spark)).unionByName(golden.known_failures(spark))
    return golden.verified(rows, leaves, parents.select("parent_id", "citation", "breadcrumb", F.col("raw_text").alias("text")))


def calibration_rows(spark, sf_dir):
    """Calibration rows over the packed contexts: quoted, invented, and the hard cases."""
    contexts = packed_contexts(spark, sf_dir).withColumn("question", F.concat(F.lit("What does the document say about the accounts and balance of "), "query_id", F.lit("?")))
    return calibration.rows(contexts)


def calibrations(spark, sf_dir):
    """Agreement of the judge with the labels: all rows, clean ones, and by support alone."""
    return calibration.report(calibration.judged(checkpointed(calibration_rows(spark, sf_dir))))


def judged_calibration(spark, sf_dir):
    """The judge's scores of every calibration row, attribution included."""
    return calibration.judged(calibration_rows(spark, sf_dir)).select("id", "human_label", "groundedness", "citation_coverage", "context_relevance", "answer_relevance", "shippable")


def whole_gate(spark, sf_dir):
    """All ten gates: the judge's kappa, its scores, the experiment's outcomes and the audit chains."""
    scored = checkpointed(calibration.judged(checkpointed(calibration_rows(spark, sf_dir))))
    means = {n: F.round(exact_mean(F.col(n)), 6) for n in ("citation_coverage", "context_relevance", "answer_relevance")}
    per = with_ranks(scored, (), "groundedness", {"p10": 0.1}, {"groundedness": F.round(exact_mean(F.col("groundedness")), 6)} | means)
    kappa = calibration.report(scored).where("run = 'full'")
    one = evaluation.experiment_summary(spark, sf_dir)
    of = calibration.observed
    seen = of(kappa, "judge kappa", F.col("kappa")).unionByName(of(one, "refusal accuracy", F.col("refusal_accuracy"))).unionByName(of(one, "citation hit rate", F.col("citation_hit_rate"))).unionByName(of(one, "known failures", F.col("known_failures")))
    for name, column in (("groundedness mean", "groundedness"), ("groundedness p10", "p10"), ("citation coverage mean", "citation_coverage"), ("context relevance mean", "context_relevance"), ("answer relevance mean", "answer_relevance")):
        seen = seen.unionByName(of(per, name, F.col(column)))
    return calibration.gate(seen, chain_verify(spark, sf_dir), BASELINE_FAILURES)


QUERIES = {f.__name__: f for f in (ingested_index, expanded_hits, packed_contexts, sufficiency_of_hits, asked_questions, golden_candidates, golden_rows, calibration_rows, calibrations, judged_calibration, whole_gate)}

INTENT = lambda q: "CASE " + " ".join(f"WHEN {ANY(f'lower({q})', k)} THEN '{n}'" for n, k in L.INTENTS) + " ELSE 'general' END"
_DISTINCT = lambda t, n, stop: KEPT(f"list_distinct(regexp_extract_all(lower({t}), '{TERM}'))", n, stop)
_HITS = f"""{NODES},
hits AS (SELECT l.*, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || id)) AS rank FROM leaves l QUALIFY rank <= {HITS}),
wide AS (SELECT h.doc_id AS query_id, h.rank, h.citation, h.breadcrumb, h.own AS text, 1.0::DOUBLE / h.rank AS score, h.parent_id, p.citation AS pc, p.raw_text AS pt FROM hits h JOIN parents p ON p.doc_id = h.doc_id AND p.id = h.parent_id)"""
ORACLE_SQL = {
    "ingested_index": f"""WITH {NODES} SELECT 'leaf' AS tier, doc_id, id, citation, parent_id, length(own) AS chars, sha256(document) AS sha, true AS embedded FROM leaves
UNION ALL SELECT 'parent', doc_id, id, citation, '', length(raw_text), sha256(breadcrumb || chr(10) || raw_text), true FROM parents""",
    # the fold said by recursion: a step a hit, lists of citations seen and of parents that cover their leaves
    "expanded_hits": f"""WITH RECURSIVE {_HITS},
fold AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, []::VARCHAR[] AS seen, []::VARCHAR[] AS covered, []::STRUCT(citation VARCHAR, text VARCHAR, score DOUBLE, expanded BOOLEAN)[] AS out FROM wide
  UNION ALL SELECT f.query_id, w.rank,
    CASE WHEN skip THEN seen WHEN widen THEN list_append(seen, pc) ELSE list_append(seen, citation) END, CASE WHEN NOT skip AND widen THEN list_append(covered, parent_id) ELSE covered END,
    CASE WHEN skip THEN out WHEN widen THEN list_append(out, {{'citation': pc, 'text': pt, 'score': score, 'expanded': true}}) ELSE list_append(out, {{'citation': citation, 'text': text, 'score': score, 'expanded': false}}) END
  FROM fold f JOIN wide w ON w.query_id = f.query_id AND w.rank = f.rank + 1,
    LATERAL (SELECT w.rank <= 3 AND length(pt) <= {CAP} AS widen), LATERAL (SELECT CASE WHEN w.rank > 3 THEN list_contains(seen, citation) OR list_contains(covered, parent_id) WHEN widen THEN list_contains(seen, pc) ELSE list_contains(seen, citation) END AS skip)),
done AS (SELECT query_id, unnest(out[:{KEEP}]) AS h, generate_subscripts(out[:{KEEP}], 1) - 1 AS place FROM fold QUALIFY fold.rank = max(fold.rank) OVER (PARTITION BY query_id))
SELECT query_id, place::INTEGER AS place, h.citation AS citation, h.text AS text, round(h.score, 6) AS score, h.expanded AS expanded FROM done""",
    "sufficiency_of_hits": f"""WITH top AS ({TEXT_SQL["term_coverage"]}),
h AS (SELECT item_id, avg(coverage) AS mean, string_agg(coalesce(text, ''), ' ' ORDER BY rank) AS evidence, string_agg('documents > ' || lang || ' > ' || left(coalesce(text, ''), 120), ' ' ORDER BY rank) AS crumbs FROM top JOIN documents USING (doc_id) GROUP BY item_id),
q AS (SELECT item_id, coalesce(text, '') AS question, mean, crumbs, {_DISTINCT("coalesce(text, '')", 5, L.GENERIC)} AS wanted, regexp_extract_all(lower(evidence), '{TERM}') AS there, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TERM}')) AS own FROM benchmark JOIN h USING (item_id)),
s AS (SELECT *, round({L.SIMILARITY_WEIGHT} * mean + {L.COVERAGE_WEIGHT} * CASE WHEN len(wanted) = 0 THEN 0 ELSE len(list_filter(wanted, lambda w: list_contains(there, w))) / len(wanted) END, 6) AS score,
  {KEPT(f"regexp_extract_all(lower(crumbs), '{TERM}')", 5, L.GENERIC)} AS terms FROM q),
f AS (SELECT *, list_filter(terms, lambda w, i: list_position(terms, w) = i AND NOT list_contains(own, w))[1:6] AS fresh FROM s)
SELECT item_id, score, CASE WHEN score >= {L.SUFFICIENT} THEN 'generate' ELSE 'refine' END AS first_route, CASE WHEN score >= {L.SUFFICIENT} THEN 'generate' ELSE 'refuse' END AS last_route, CASE WHEN len(fresh) = 0 THEN question ELSE question || ' ' || array_to_string(fresh, ' ') END AS refined FROM f""",
    "golden_candidates": f"""WITH {NODES}, sections AS (SELECT n.doc_id, act, n.number, n.title, n.cite, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.place) - 1 AS i FROM nodes n JOIN d USING (doc_id) WHERE n.kind = 'section' AND n.place[1] = 1),
asked AS (SELECT *, lower(title[1]) || title[2:] || ' in the ' || act AS subject FROM sections),
q AS (SELECT *, CASE i % 5 WHEN 0 THEN 'What does section ' || number || ' say about ' || subject || '?' WHEN 1 THEN 'What does the document say about ' || subject || '?' WHEN 2 THEN 'Which provision covers ' || subject || '?'
  WHEN 3 THEN 'What does section ' || number || ' require in relation to ' || subject || '?' ELSE 'What does the document provide about ' || subject || '?' END AS question FROM asked)
SELECT doc_id, 'g' || lpad('' || (i + 1), 3, '0') AS id, question, {INTENT('question')} AS intent, [doc_id || ' ' || cite] AS must_cite, 'Part 1 Accounts of the Customers · ' || title AS note FROM q""",
    "packed_contexts": f"""WITH RECURSIVE {_HITS}, b AS (SELECT *, '[' || citation || '] ' || breadcrumb AS head, '[' || citation || '] ' || breadcrumb || CASE WHEN text = '' THEN '' ELSE chr(10) || text END AS block FROM wide),
fold AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, {ROOM}::BIGINT AS room, []::VARCHAR[] AS seen, []::VARCHAR[] AS out, false AS done FROM wide
  UNION ALL SELECT f.query_id, w.rank, CASE WHEN skip OR NOT fits THEN room ELSE room - length(block) - 2 END, CASE WHEN skip THEN seen ELSE list_append(seen, citation) END,
    CASE WHEN skip THEN out WHEN fits THEN list_append(out, block) WHEN allowed > 0 THEN list_append(out, head || chr(10) || rtrim(left(text, allowed), ' ') || ' […truncated]') WHEN len(out) = 0 THEN [left(head, {ROOM})] ELSE out END,
    CASE WHEN skip THEN done WHEN fits THEN room - length(block) - 2 <= 200 ELSE true END
  FROM fold f JOIN b w ON w.query_id = f.query_id AND w.rank = f.rank + 1, LATERAL (SELECT done OR list_contains(seen, citation) AS skip, length(block) <= room AS fits, greatest(200, room) - length(head) - 2 AS allowed))
SELECT query_id, array_to_string(out, chr(10) || chr(10)) AS context FROM fold QUALIFY fold.rank = max(fold.rank) OVER (PARTITION BY query_id)""",
}

_CONTEXTS = ORACLE_SQL["packed_contexts"].removeprefix("WITH RECURSIVE ").replace("SELECT query_id, array_to_string(out, chr(10) || chr(10)) AS context FROM fold", ", contexts AS (SELECT query_id, array_to_string(out, chr(10) || chr(10)) AS context, 'What does the document say about the accounts and balance of ' || query_id || '?' AS question FROM fold") + ")"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_BLOCK = r"'(?s)^\[([^\]\n]{2,160})\][^\n]*\n(.*?)(?:\n\n\[|$)'"
_CUT = lambda t: f"string_split(regexp_replace({t}, '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_QUOTED = lambda t: f"'[' || citation || '] provides: ' || {t}"
_ANSWERS = {"paraphrase": _Q(L.PARAPHRASE), "partial": _QUOTED(f"sentence || ' ' || {_Q(L.INVENTED)}"), "uncited": "sentence", "trailing": _QUOTED(f"sentence || ' ' || {_Q(L.TRAILING)}"), "boilerplate": _QUOTED(f"coalesce(list_filter({_CUT('context')}, lambda p: {ANY('p', L.BOILERPLATE)})[1], sentence)")}
_HARD = lambda f: "CASE n " + " ".join(f"WHEN {i} THEN {f(*case)}" for i, case in enumerate(L.HARD_CASES, 1)) + " END"
CALIBRATION = f"""{_CONTEXTS},
blocks AS (SELECT *, regexp_extract(context, {_BLOCK}, 1) AS citation, list_filter(list_transform({_CUT(f"regexp_extract(context, {_BLOCK}, 2)")}, lambda p: trim(p, ' ')), lambda p: p <> '')[1] AS first FROM contexts),
chosen AS (SELECT *, CASE WHEN first LIKE '%.' THEN first ELSE first || '.' END AS sentence, row_number() OVER (ORDER BY query_id) AS n FROM blocks WHERE citation <> '' AND first IS NOT NULL QUALIFY n <= {L.CLEAN_ROWS}),
calibration AS (SELECT 'c' || lpad('' || n, 3, '0') AS id, question, context, CASE WHEN n % 3 = 0 THEN {_QUOTED(_Q(L.FABRICATED))} ELSE {_QUOTED("sentence")} END AS answer, CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS human_label,
  CASE WHEN n % 3 = 0 THEN 'fabricated provision text' ELSE 'verbatim quotation with a resolvable citation' END AS note FROM chosen
  UNION ALL SELECT 'h' || lpad('' || n, 3, '0'), CASE WHEN n IN (1, 5) THEN {_Q(L.PARAPHRASED_QUESTION)} ELSE question END, context, {_HARD(lambda kind, human, why: _ANSWERS[kind])}, {_HARD(lambda kind, human, why: human)}, {_HARD(lambda kind, human, why: _Q(why))} FROM chosen WHERE n <= {len(L.HARD_CASES)})"""
_HIDE = lambda t: f"regexp_replace({t}, '(\\[[^\\]\\n]*?[.!?])(\\s[^\\]\\n]*\\])', '\\1' || chr(2) || '\\2', 'g')"
_SENTENCES = lambda t: f"list_filter(list_transform(string_split(regexp_replace({_HIDE(_HIDE(_HIDE(f'trim({t})')))}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(replace(p, chr(2), ''))), lambda p: p <> '')"
_BARE = lambda c: f"trim(regexp_replace({c}, '{L.AS_INSERTED}', ' ', 'g'))"
_CANON = lambda c: f"CASE WHEN regexp_extract({_BARE(c)}, '{L.SCHEDULE_REF}', 2) <> '' THEN 'sch.' || lower(regexp_extract({_BARE(c)}, '{L.SCHEDULE_REF}', 1)) || ' para.' || lower(regexp_extract({_BARE(c)}, '{L.SCHEDULE_REF}', 2)) WHEN regexp_extract({_BARE(c)}, '{L.SECTION_REF}', 1) <> '' THEN 's.' || lower(regexp_extract({_BARE(c)}, '{L.SECTION_REF}', 1)) ELSE lower(trim(regexp_replace({_BARE(c)}, '\\s+', ' ', 'g'))) END"
JUDGED_CALIBRATION = f"""{CALIBRATION},
j0 AS (SELECT *, list_filter({CONTENT("question")}, lambda w: NOT list_contains([{", ".join(_Q(w) for w in L.GENERIC)}], w)) AS q, {CONTENT("answer")} AS a, {CONTENT("context")} AS c, list_filter(list_transform({_SENTENCES("answer")}, lambda s: {{'s': s, 'w': {CONTENT("s")}}}), lambda x: len(x.w) >= {L.MIN_WORDS}) AS sets,
  list_transform(regexp_extract_all(context, '{L.CITATION}', 1), lambda m: {_CANON("m")}) AS available FROM calibration),
scores AS (SELECT id, human_label, CASE WHEN len(sets) = 0 THEN 0.0 ELSE round(len(list_filter(sets, lambda x: len(list_intersect(x.w, c)) / len(x.w) >= {L.GROUNDED})) / len(sets), 6) END AS groundedness,
  CASE WHEN len(sets) = 0 THEN 0.0 ELSE round(len(list_filter(sets, lambda x: len(list_filter(regexp_extract_all(x.s, '{L.CITATION}', 1), lambda m: list_contains(available, {_CANON("m")}))) > 0)) / len(sets), 6) END AS citation_coverage,
  {REL("q", "c")} AS context_relevance, {REL("q", "a")} AS answer_relevance FROM j0),
judged AS (SELECT *, least(groundedness, citation_coverage) AS shippable FROM scores),
runs AS (SELECT 'full' AS run, human_label = 1 AS t, shippable >= {L.KAPPA_CUT} AS p FROM judged UNION ALL SELECT 'clean only', human_label = 1, shippable >= {L.KAPPA_CUT} FROM judged WHERE id LIKE 'c%' UNION ALL SELECT 'groundedness only', human_label = 1, groundedness >= {L.KAPPA_CUT} FROM judged),
counts AS (SELECT run, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn, count(*) AS n FROM runs GROUP BY run),
kappas AS (SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) AS agreement, CASE WHEN pe >= 1 THEN 0.0 ELSE round(((tp + tn) / n - pe) / (1 - pe), 6) END AS kappa, run FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM counts))"""
_LIMITS = ", ".join(f"({_Q(n)}, {v}::DOUBLE)" for n, v in (L.QUALITY_THRESHOLDS | {"known failures": BASELINE_FAILURES}).items())
ORACLE_SQL |= {
    "calibration_rows": f"WITH RECURSIVE {CALIBRATION} SELECT * FROM calibration",
    "judged_calibration": f"WITH RECURSIVE {JUDGED_CALIBRATION} SELECT * FROM judged",
    "calibrations": f"WITH RECURSIVE {JUDGED_CALIBRATION} SELECT * FROM kappas",
    "whole_gate": f"""WITH RECURSIVE {JUDGED_CALIBRATION}, e AS ({evaluation.ORACLE_SQL["experiment_summary"]}), v AS ({TEXT_SQL["chain_verify"]}), limits(name, threshold) AS (VALUES {_LIMITS}),
m AS (SELECT sum(groundedness::DECIMAL(28,6))::DOUBLE / count(*) AS g, sum(citation_coverage::DECIMAL(28,6))::DOUBLE / count(*) AS cc, sum(context_relevance::DECIMAL(28,6))::DOUBLE / count(*) AS cr, sum(answer_relevance::DECIMAL(28,6))::DOUBLE / count(*) AS ar, list_sort(list(groundedness))[greatest(1, ceil(0.1 * count(*)))::INT] AS p10 FROM judged),
seen AS (SELECT 'judge kappa' AS name, kappa AS observed FROM kappas WHERE run = 'full' UNION ALL SELECT 'groundedness mean', round(g, 6) FROM m UNION ALL SELECT 'groundedness p10', p10 FROM m UNION ALL SELECT 'citation coverage mean', round(cc, 6) FROM m UNION ALL SELECT 'context relevance mean', round(cr, 6) FROM m
  UNION ALL SELECT 'answer relevance mean', round(ar, 6) FROM m UNION ALL SELECT 'refusal accuracy', refusal_accuracy FROM e UNION ALL SELECT 'citation hit rate', citation_hit_rate FROM e UNION ALL SELECT 'known failures', known_failures FROM e),
rows_ AS (SELECT name, observed::DOUBLE AS observed, threshold, CASE WHEN name = 'known failures' THEN observed <= threshold ELSE observed >= threshold END AS passed FROM seen JOIN limits USING (name) UNION ALL SELECT 'audit chain verifies', sum(verified)::DOUBLE, sum(records)::DOUBLE, sum(verified) = sum(records) FROM v)
SELECT * FROM rows_ UNION ALL SELECT 'all', count(*) FILTER (passed), {len(L.QUALITY_THRESHOLDS) + 2}, count(*) FILTER (passed) = {len(L.QUALITY_THRESHOLDS) + 2} FROM rows_""",
}
