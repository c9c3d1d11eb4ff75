"""Queries over texts: documents as the corpus, benchmark as questions, conversations as transcripts, labels as judgements."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T
from caselode.operators import conversation, integrity, judge, overlap, vectors
from caselode.operators.panels import band
from caselode.session import read_table, shared_folder


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


def turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


def digest(items):
    """Count and digest of an array of strings."""
    return F.size(items).cast("long").alias("n"), F.sha2(F.array_join(items, " ").cast("binary"), 256).alias("sha")


def tokenize_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(T.term_list(F.col("text"))))


def embedding_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(T.embedding_tokens(F.col("text"))))


def distinctive_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(F.array_sort(T.distinctive(F.col("text")))))


def content_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(F.array_sort(T.content_words(F.col("text")))))


def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", "source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(T.sentences(F.col("text"))))


def redact_identifiers(spark, sf_dir):
    out = T.redacted(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", (out != F.col("text")).alias("changed"), F.sha2(out.cast("binary"), 256).alias("sha"))


def fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8).alias("short"))


def window_chunks(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(T.windows(F.col("text"), L.CHUNK, L.OVERLAP)).alias("pos", "w"))
    return rows.select("doc_id", F.format_string("s%05d", F.col("pos")).alias("id"), F.col("w.offset").alias("offset"), F.length("w.chunk").cast("long").alias("chars"), F.sha2(F.col("w.chunk").cast("binary"), 256).alias("sha"))


def question_intents(spark, sf_dir):
    out = turns(spark, sf_dir).where("role = 'user'").withColumn("intent", T.intent(F.col("text")))
    return out.groupBy("intent").agg(F.count("*").alias("n"))


def follow_ups(spark, sf_dir):
    return conversation.questions(turns(spark, sf_dir)).select("conv_id", "turn", T.follow_up(F.col("text")).alias("follows"))


def contextualise(spark, sf_dir):
    return conversation.contextualised(turns(spark, sf_dir)).select("conv_id", "turn", "query", "used_history")


def history_tail(spark, sf_dir):
    out = conversation.bounded(turns(spark, sf_dir), 4)
    return out.groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


def session_summary(spark, sf_dir):
    return conversation.sessions(turns(spark, sf_dir))


def reconstruct_turns(spark, sf_dir):
    """Two rows for each exchange, in order."""
    pairs = conversation.exchanges(turns(spark, sf_dir))
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("agent").alias("role"), F.col("answer").alias("content")))
    rows = pairs.select("conv_id", "turn", F.posexplode(both).alias("pos", "x"))
    return rows.select("conv_id", (F.col("turn") * 2 + F.col("pos")).alias("seq"), "x.role", F.length("x.content").cast("long").alias("chars"))


def judge_answers(spark, sf_dir):
    """Answers judged against their conversation's other turns by the assistant, whose words are taken once a conversation."""
    rows = turns(spark, sf_dir)
    words = rows.where("role <> 'user'").select("conv_id", "turn", F.explode(T.content_words(F.col("text"))).alias("word"))
    held = words.groupBy("conv_id", "word").agg(F.count("*").alias("n"), F.min("turn").alias("turn"))
    held = held.groupBy("conv_id").agg(F.collect_list(F.struct("word", F.when(F.col("n") == 1, F.col("turn")).alias("only"))).alias("held"))
    pairs = conversation.exchanges(rows).join(held, "conv_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<word:string,only:bigint>>")))
    others = F.transform(F.filter("held", lambda w: w.only.isNull() | (w.only != F.col("answer_turn"))), lambda w: w.word)
    out = judge.scored(pairs.withColumn("context_words", others))
    return out.select("conv_id", "turn", "groundedness", "context_relevance", "answer_relevance")


def score_summary(spark, sf_dir):
    """Judge scores as rows: mean, share of full marks and band by dimension."""
    rows = judge_answers(spark, sf_dir)
    long = rows.select(F.expr("stack(3, 'groundedness', groundedness, 'context_relevance', context_relevance, 'answer_relevance', answer_relevance) AS (name, score)"))
    out = long.groupBy("name").agg(F.round(F.sum(F.col("score").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("mean"), F.count_if(F.col("score") == 1).alias("full"), F.count("*").alias("n"))
    return out.withColumn("band", band(F.col("mean")))


def calibration(spark, sf_dir):
    """Kappa of a length rule against the quality labels, by language and in all."""
    rows = read_table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), "doc_id").withColumn("predicted", (F.col("n_chars") >= 400).cast("int"))
    whole = judge.kappa(rows, "quality", "predicted").withColumn("lang", F.lit("all"))
    return whole.unionByName(judge.kappa(rows, "quality", "predicted", "lang"))


def disagreements(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    return rows.where((F.col("n_chars") >= 400).cast("int") != F.col("quality")).select("doc_id", "quality", "n_chars")


def term_coverage(spark, sf_dir):
    """For each benchmark text, the three documents that hold most of its distinctive terms (all documents compete)."""
    asked = read_table(spark, sf_dir, "benchmark").select("item_id", T.distinctive(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    sets = asked.select(F.col("item_id").alias("item"), "terms")
    top = overlap.most_shared(sets, docs(spark, sf_dir).select(F.col("doc_id").alias("id"), T.distinctive(F.col("text")).alias("terms")), 3)
    size = asked.select(F.col("item_id").alias("item"), F.size("terms").alias("n_terms"))
    return top.join(size, "item").select(F.col("item").alias("item_id"), F.col("id").alias("doc_id"), "rank", "shared", F.round(F.col("shared") / F.col("n_terms"), 6).alias("coverage"))


def vector_topk(spark, sf_dir):
    """The five nearest vectors of each one whose id is divisible by 50, itself left out; all vectors compete."""
    v = read_table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest(asked, v, 5, "vec_id", "embedding", itself=False).withColumnRenamed("id", "vec_id")


def vector_cells(spark, sf_dir):
    """As vector_topk, by an index of coarse cells of which each question looks at some."""
    v = read_table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    path = f"{shared_folder(spark)}/caselode/cells-{uuid.uuid4().hex}"
    vectors.write_cells(v.select("vec_id", "embedding"), path, 32, "vec_id", "embedding")
    return vectors.probed(asked, path, 5, 20, "vec_id", "embedding", itself=False).withColumnRenamed("id", "vec_id")


def sufficiency_gate(spark, sf_dir):
    """Retrieved vectors of each query: mean of the top three, coverage of its label by the five, the gate's score and route."""
    labels = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = vector_topk(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    hit = top.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= L.EXPAND_TOP, F.col("score").cast("decimal(12,6)"))).alias("s"), F.max((F.col("label") == F.col("asked")).cast("double")).alias("coverage")
    )
    mean = F.col("s").cast("double") / 3
    score = F.round(L.SIMILARITY_WEIGHT * mean + L.COVERAGE_WEIGHT * F.col("coverage"), 6)
    return hit.select("query_id", "coverage", score.alias("score"), F.when(score >= L.SUFFICIENT, "generate").otherwise("refine").alias("route"))


def vector_profile(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return v.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(norm, 4).alias("norm"), F.round(F.array_min("embedding").cast("double"), 6).alias("low"), F.round(F.array_max("embedding").cast("double"), 6).alias("high"))


def chain_verify(spark, sf_dir):
    """Hash chains over each user's events, a few of which were altered after they were sealed."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    sealed = integrity.chained(rows, "user_id", "event_id", "event_id", "event_type", "props")
    altered = sealed.withColumn("event_type", F.when(F.col("event_id") % 997 == 3, "altered").otherwise(F.col("event_type")))
    altered = altered.withColumn("previous_hash", F.when(F.col("event_id") % 1499 == 5, "0").otherwise(F.col("previous_hash")))
    return integrity.verified(altered, "user_id", "event_id", "event_id", "event_type", "props")


def audit_anchors(spark, sf_dir):
    """Anchors of each user's chain of events half-way, against a log somewhat later that was written anew without its large values."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "value")
    rows = rows.join(F.broadcast(rows.agg(F.max("event_id").alias("most"))))
    fields = ("event_id", "event_type", "props")
    published = integrity.anchors(integrity.chained(rows.where("event_id <= 0.5 * most"), "user_id", "event_id", *fields), "user_id", "event_id", *fields)
    later = integrity.chained(rows.where("event_id <= 0.55 * most and value <= 95"), "user_id", "event_id", *fields)
    return integrity.against_anchors(later, published, "user_id").join(published.select("user_id", "head_hash"), "user_id")


def retention_expired(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").cast("timestamp").alias("now"))
    out = integrity.expired(rows.join(F.broadcast(newest)), "ts", 7, F.col("now"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, embedding_tokens, distinctive_terms, content_terms, token_estimate, sentence_split, redact_identifiers, fingerprint, window_chunks, question_intents,
        follow_ups, contextualise, history_tail, session_summary, reconstruct_turns, judge_answers, score_summary, calibration, disagreements, term_coverage, vector_topk,
        vector_cells, sufficiency_gate, vector_profile, chain_verify, audit_anchors, retention_expired,
    )
}

TERM = L.TERM.replace("'", "''")
LIST = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"
TERMS = f"regexp_extract_all(lower(coalesce(text, '')), '{TERM}')"
KEPT = lambda terms, n, stop: f"list_filter({terms}, lambda w: length(w) >= {n} AND NOT list_contains({LIST(stop)}, w))"
DIGEST = lambda items: f"len({items}) AS n, sha256(array_to_string({items}, ' ')) AS sha"
ANY = lambda text, names: "(" + " OR ".join("contains(" + text + ", '" + n.replace("'", "''") + "')" for n in names) + ")"
SENTENCES = lambda t: f"list_filter(list_transform(string_split(regexp_replace(trim({t}, ' '), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ')), lambda p: p <> '')"
CONTENT = lambda t: KEPT(f"list_distinct(regexp_extract_all(lower({t}), '{TERM}'))", 3, L.FILLER)
TOPIC = lambda t: KEPT(f"regexp_extract_all(lower({t}), '{TERM}')", 4, L.GENERIC)
FOLLOWS = f"""(low <> '' AND (coalesce(list_contains({LIST(L.CONJUNCTIONS)}, terms[1]), false) OR {ANY("low", L.FOLLOW_UP)} OR (len(terms) <= 5 AND len(topic) = 0) OR (list_has_any(terms, {LIST(L.ANAPHORA)}) AND len(topic) <= 1)))"""
ASKED = f"""asked AS (SELECT *, {FOLLOWS} AS follows FROM (SELECT conv_id, turn, trim(text, ' ') AS text, lower(trim(text, ' ')) AS low, regexp_extract_all(lower(trim(text, ' ')), '{TERM}') AS terms,
  {TOPIC("trim(text, ' ')")} AS topic FROM conversations WHERE role = 'user' AND trim(text, ' ') <> ''))"""
PAIRS = "pairs AS (SELECT * FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role, lead(turn) OVER w AS answer_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
REL = lambda q, t: f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE round(len(list_intersect({q}, {t})) / len({q}), 6) END"
JUDGED = f"""{PAIRS}, ctx AS (SELECT p.conv_id, p.turn, coalesce(string_agg(c.text, chr(10)), '') AS context FROM pairs p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.role <> 'user' AND c.turn <> p.answer_turn GROUP BY ALL),
j0 AS (SELECT conv_id, turn, list_filter({CONTENT("text")}, lambda w: NOT list_contains({LIST(L.GENERIC)}, w)) AS q, {CONTENT("answer")} AS a, {CONTENT("context")} AS c,
  list_filter(list_transform({SENTENCES("answer")}, lambda s: {CONTENT("s")}), lambda w: len(w) >= 3) AS sets FROM pairs JOIN ctx USING (conv_id, turn)),
judged AS (SELECT conv_id, turn, CASE WHEN len(sets) = 0 THEN 0.0 ELSE round(len(list_filter(sets, lambda w: len(list_intersect(w, c)) / len(w) >= {L.GROUNDED})) / len(sets), 6) END AS groundedness,
  {REL("q", "c")} AS context_relevance, {REL("q", "a")} AS answer_relevance FROM j0)"""
KAPPA = """SELECT {0} AS lang, tp, fp, tn, fn, round((tp + tn) / n, 6) AS agreement, CASE WHEN pe >= 1 THEN 0.0 ELSE round(((tp + tn) / n - pe) / (1 - pe), 6) END AS kappa FROM (
  SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM (SELECT {0}, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn,
  count(*) FILTER (t AND NOT p) AS fn, count(*) AS n FROM r GROUP BY ALL))"""
TOPK = """scored AS (SELECT a.vec_id AS query_id, b.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5)"""
UNI = r"[\p{L}\p{M}\p{Nd}\p{Pc}"
FIELDS = lambda kind: f"length('' || event_id) || ':' || event_id || '|' || length({kind}) || ':' || {kind} || '|' || CASE WHEN props IS NULL THEN '-' ELSE length(props) || ':' || props END"
#: The chains of events said by recursion, a step a record.
SEALED = f"""s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, {FIELDS("event_type")} AS fields FROM events),
h AS (SELECT user_id, sequence, sha256(sequence || '|{L.GENESIS}|' || fields) AS record_hash FROM s WHERE sequence = 0 UNION ALL SELECT s.user_id, s.sequence, sha256(s.sequence || '|' || h.record_hash || '|' || s.fields) FROM h JOIN s ON s.user_id = h.user_id AND s.sequence = h.sequence + 1)"""
ORACLE_SQL = {
    "tokenize_terms": f"SELECT doc_id, {DIGEST(TERMS)} FROM documents",
    "embedding_tokens": f"SELECT doc_id, {DIGEST(KEPT(TERMS, 2, L.STOPWORDS))} FROM documents",
    "distinctive_terms": f"SELECT doc_id, {DIGEST('list_sort(' + KEPT('list_distinct(' + TERMS + ')', 5, L.GENERIC) + ')')} FROM documents",
    "content_terms": f"SELECT doc_id, {DIGEST('list_sort(' + KEPT('list_distinct(' + TERMS + ')', 3, L.FILLER) + ')')} FROM documents",
    "token_estimate": "SELECT lang, source, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END)::BIGINT AS tokens, count(*) AS n FROM (SELECT lang, source, coalesce(text, '') AS text FROM documents) GROUP BY ALL",
    "sentence_split": f"SELECT doc_id, {DIGEST(SENTENCES('text'))} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "redact_identifiers": rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_replace(text, '{UNI}.+-]+@{UNI}-]+\.{UNI}.-]+', '[email]', 'g') AS t1 FROM a),
c AS (SELECT *, regexp_replace(t1, '\b[A-CEGHJ-PR-TW-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D]\b', '[nino]', 'g') AS t2 FROM b),
d AS (SELECT *, regexp_replace(t2, '\b(?:\+?44|0)(?:\s?\d){{9,10}}\b', '[phone]', 'g') AS t3 FROM c),
e AS (SELECT *, regexp_replace(t3, '\b\d{{9,}}\b', '[digits]', 'g') AS t4 FROM d)
SELECT doc_id, t4 <> text AS changed, sha256(t4) AS sha FROM e""",
    "fingerprint": "SELECT doc_id, sha256(coalesce(text, '')) AS sha, substr(sha256(coalesce(text, '')), 1, 8) AS short FROM documents",
    "window_chunks": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), o AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, {L.CHUNK - L.OVERLAP})) AS "offset" FROM d),
w AS (SELECT doc_id, "offset", substr(text, "offset" + 1, {L.CHUNK}) AS chunk FROM o WHERE ("offset" = 0 OR "offset" - {L.CHUNK - L.OVERLAP} + {L.CHUNK} < length(text)))
SELECT doc_id, printf('s%05d', row_number() OVER (PARTITION BY doc_id ORDER BY "offset") - 1) AS id, "offset", length(chunk) AS chars, sha256(chunk) AS sha FROM w WHERE trim(chunk, ' ') <> ''""",
    "question_intents": "SELECT CASE " + " ".join(f"WHEN {ANY('lower(text)', k)} THEN '{n}'" for n, k in L.INTENTS) + " ELSE 'general' END AS intent, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "follow_ups": f"WITH {ASKED} SELECT conv_id, turn, follows FROM asked",
    "contextualise": f"""WITH {ASKED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM asked),
earlier AS (SELECT n.conv_id, n.turn, e.k, list_filter(e.topic, lambda t: NOT list_contains(n.terms, t)) AS new FROM numbered n JOIN numbered e ON n.conv_id = e.conv_id AND e.k BETWEEN n.k - 6 AND n.k - 1 WHERE n.follows AND NOT e.follows),
distinct_ AS (SELECT conv_id, turn, k, list_filter(new, lambda t, i: list_position(new, t) = i)[1:6] AS new FROM earlier WHERE len(new) > 0),
best AS (SELECT conv_id, turn, arg_max(new, k) AS new FROM distinct_ GROUP BY ALL)
SELECT n.conv_id, n.turn, CASE WHEN b.new IS NULL THEN n.text ELSE n.text || ' ' || array_to_string(b.new, ' ') END AS query, b.new IS NOT NULL AS used_history FROM numbered n LEFT JOIN best b USING (conv_id, turn)""",
    "history_tail": "SELECT conv_id, count(*) AS kept, min(turn) AS first_turn, sum(length(text))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 4 GROUP BY conv_id",
    "session_summary": r"""SELECT conv_id, CASE WHEN length(t) > 63 THEN substr(t, 1, 63) || '…' ELSE t END AS title, turns, questions, last_turn FROM (
SELECT conv_id, trim(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t, count(*) AS turns, count(*) FILTER (role = 'user') AS questions, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
ORDER BY conv_id DESC LIMIT 25""",
    "reconstruct_turns": f"WITH {PAIRS} SELECT conv_id, turn * 2 + i AS seq, CASE WHEN i = 0 THEN 'user' ELSE 'agent' END AS role, length(CASE WHEN i = 0 THEN text ELSE answer END) AS chars FROM pairs CROSS JOIN (VALUES (0), (1)) v(i)",
    "judge_answers": f"WITH {JUDGED} SELECT * FROM judged",
    "score_summary": f"""WITH {JUDGED}, s AS (UNPIVOT judged ON groundedness, context_relevance, answer_relevance INTO NAME name VALUE score),
m AS (SELECT name, round(sum(score::DECIMAL(20,6))::DOUBLE / count(*), 6) AS mean, count(*) FILTER (score = 1) AS "full", count(*) AS n FROM s GROUP BY name)
SELECT *, CASE WHEN mean >= 0.9 THEN 'good' WHEN mean >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM m""",
    "calibration": f"""WITH r AS (SELECT lang, quality = 1 AS t, n_chars >= 400 AS p FROM labels JOIN documents USING (doc_id)) {KAPPA.format("lang")} UNION ALL SELECT 'all', tp, fp, tn, fn, agreement, kappa FROM ({KAPPA.format("1").replace("AS lang", "AS one").replace("GROUP BY ALL", "")})""",
    "disagreements": "SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id) WHERE (n_chars >= 400)::INT <> quality",
    "term_coverage": f"""WITH a AS (SELECT item_id, {KEPT('list_distinct(' + TERMS + ')', 5, L.GENERIC)} AS terms FROM benchmark), w AS (SELECT item_id, len(terms) AS n_terms, unnest(terms) AS term FROM a),
t AS (SELECT doc_id, unnest({KEPT('list_distinct(' + TERMS + ')', 5, L.GENERIC)}) AS term FROM documents),
s AS (SELECT item_id, n_terms, doc_id, count(*) AS shared FROM w JOIN t USING (term) GROUP BY ALL)
SELECT item_id, doc_id, rank, shared, round(shared / n_terms, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s) WHERE rank <= 3""",
    "vector_topk": f"WITH {TOPK} SELECT * FROM top",
    "sufficiency_gate": f"""WITH {TOPK}, h AS (SELECT query_id, sum(score::DECIMAL(12,6)) FILTER (rank <= 3)::DOUBLE / 3 AS mean, max((b.label = a.label)::INT)::DOUBLE AS coverage FROM top t JOIN embeddings b USING (vec_id) JOIN embeddings a ON a.vec_id = t.query_id GROUP BY query_id)
SELECT query_id, coverage, round({L.SIMILARITY_WEIGHT} * mean + {L.COVERAGE_WEIGHT} * coverage, 6) AS score, CASE WHEN round({L.SIMILARITY_WEIGHT} * mean + {L.COVERAGE_WEIGHT} * coverage, 6) >= {L.SUFFICIENT} THEN 'generate' ELSE 'refine' END AS route FROM h""",
    "vector_profile": "SELECT vec_id, len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(list_min(embedding)::DOUBLE, 6) AS low, round(list_max(embedding)::DOUBLE, 6) AS high FROM embeddings",
    "chain_verify": f"""WITH RECURSIVE {SEALED},
w AS (SELECT user_id, event_id, sequence, CASE WHEN event_id % 1499 = 5 THEN 'previous hash differs' WHEN event_id % 997 = 3 THEN 'content differs from hash' END AS reason FROM s),
a AS (SELECT user_id, count(*) AS records, min(sequence) FILTER (reason IS NOT NULL) AS broken, arg_min(reason, sequence) FILTER (reason IS NOT NULL) AS reason FROM w GROUP BY user_id),
head AS (SELECT user_id, arg_max(record_hash, sequence) AS head FROM h GROUP BY user_id)
SELECT user_id, records, coalesce(broken, records) AS verified, coalesce(reason, '') AS reason, CASE WHEN broken IS NULL THEN head ELSE '' END AS head_hash FROM a JOIN head USING (user_id)""",
    "audit_anchors": f"""WITH RECURSIVE {SEALED}, top AS (SELECT max(event_id) AS most FROM events),
r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, {FIELDS("event_type")} AS fields FROM events, top WHERE event_id <= 0.55 * most AND value <= 95),
g AS (SELECT user_id, sequence, sha256(sequence || '|{L.GENESIS}|' || fields) AS record_hash FROM r WHERE sequence = 0 UNION ALL SELECT r.user_id, r.sequence, sha256(r.sequence || '|' || g.record_hash || '|' || r.fields) FROM g JOIN r ON r.user_id = g.user_id AND r.sequence = g.sequence + 1),
half AS (SELECT user_id, count(*) AS n FROM events, top WHERE event_id <= 0.5 * most GROUP BY user_id)
SELECT half.user_id, n AS anchored, h.record_hash AS head_hash, CASE WHEN g.record_hash IS NULL THEN 'truncated' WHEN g.record_hash <> h.record_hash THEN 'rewritten' ELSE 'matches' END AS status
FROM half JOIN h ON h.user_id = half.user_id AND h.sequence = n - 1 LEFT JOIN g ON g.user_id = half.user_id AND g.sequence = n - 1""",
    "retention_expired": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY event_type",
}
