"""Queries over what leaves the engine, the comparison of two indexes, and the report over all controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.functions import exports as X
from caselode.functions import lexicons as L
from caselode.operators import compare, ingest
from caselode.plans import evaluation, guard, retrieval
from caselode.plans.structure import acts
from caselode.session import checkpointed, read_table


def log_stamps(spark, sf_dir):
    """Stamps of events as seconds; every event also has one that is none."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.coalesce("props", F.lit("")))).alias("stamp"))
    return e.select("event_id", F.round(X.epoch(F.col("stamp")), 3).alias("seconds"))


def flat_metadata(spark, sf_dir):
    """Customers' metadata with a list, a map and missing values, flattened."""
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = read_table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    columns = {
        "name": F.col("c_name"), "balance": F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")), "tags": F.array(F.col("n_name"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, F.lit('in "debt"'))),
        "place": F.create_map(F.lit("nation"), F.col("n_name"), F.lit("debt"), F.when(F.col("c_acctbal") < 0, F.lit("yes"))),
    }
    kinds = {"name": "string", "balance": "bigint", "tags": "array<string>", "place": "map<string,string>"}
    return c.select("c_custkey", X.flat(columns, kinds).alias("m")).select("c_custkey", *[F.col("m")[k].alias(k) for k in columns], F.size("m").cast("long").alias("keys"))


def json_replies(spark, sf_dir):
    """Keys of the JSON inside replies that talk around it."""
    r = read_table(spark, sf_dir, "events").select(F.concat(F.lit("Sure: "), F.coalesce("props", F.lit("none")), F.lit("\nThat is all}.")).alias("reply"), F.concat(F.lit("Sure: "), F.coalesce("props", F.lit("none")), F.lit("\nThat is all.")).alias("good"))
    found = r.select(F.explode(F.array(F.struct(F.lit("trailing brace").alias("kind"), X.json_in(F.col("reply")).alias("j")), F.struct(F.lit("plain").alias("kind"), X.json_in(F.col("good")).alias("j")))).alias("x")).select("x.*")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("j").isNull()).alias("without"), F.count_if(X.is_json(F.col("j"))).alias("parsed"))


def uncited_contexts(spark, sf_dir):
    """Packed contexts without their marks."""
    return retrieval.packed_contexts(spark, sf_dir).select("query_id", F.sha2(X.uncited(F.concat("context", F.lit(" [open"))).cast("binary"), 256).alias("sha"))


def merged_stages(spark, sf_dir):
    """Stage times of orders' returned and other lines, merged."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("stage", F.col("l_linestatus")).groupBy("l_orderkey", "stage", (F.col("l_returnflag") == "R").alias("r")).agg(F.sum(F.col("l_quantity").cast("double")).alias("ms"))
    per = lines.groupBy("l_orderkey").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("r") == side, F.struct("stage", "ms")))).alias(name) for name, side in (("a", True), ("b", False))])
    return per.select("l_orderkey", F.explode(X.merged_ms(F.col("a"), F.col("b"))).alias("stage", "ms"))


def refusal_texts(spark, sf_dir):
    """What is said where evidence does not suffice after all attempts."""
    rows = retrieval.sufficiency_of_hits(spark, sf_dir).where("last_route = 'refuse'")
    return rows.select("item_id", X.refusal(F.col("score"), L.SUFFICIENT, F.lit(L.MAX_ATTEMPTS)).alias("answer"))


def compared_indexes(spark, sf_dir):
    """The same questions against fixed windows of the Acts and against their index: hits and citable hits, side by side."""
    docs = checkpointed(acts(spark, sf_dir))
    leaves, parents = retrieval._keyed(ingest.opened(spark, retrieval.published(spark, docs)))
    heads = leaves.where("heading <> ''").select("doc_id", "heading").distinct()
    questions = heads.select(F.concat_ws("/", "doc_id", "heading").alias("query_id"), F.concat(F.lit("Which customers have "), F.lower("heading"), F.lit("?")).alias("question"))
    return compare.summary(compare.compared(questions, compare.windows(docs), leaves, parents.select("parent_id", "citation", "breadcrumb", F.col("raw_text").alias("text"))))


def leaf_pages(spark, sf_dir):
    """The third page of ten leaves of each Act, in document order."""
    from_tree = retrieval.ranked_leaves(spark, sf_dir)
    return compare.page(from_tree, 10, 20).select("doc_id", "id", "place")


def control_report(spark, sf_dir):
    """One report over all controls: each one's rates, all together, the fence's effect over repeats, and the broker's guarantee."""
    return compare.control_report(guard.control_measurement(spark, sf_dir), guard.provenance_delta(spark, sf_dir), evaluation.broker_guarantee(spark, sf_dir))


QUERIES = {f.__name__: f for f in (log_stamps, flat_metadata, json_replies, uncited_contexts, merged_stages, refusal_texts, compared_indexes, leaf_pages, control_report)}

_CTX = retrieval.ORACLE_SQL["packed_contexts"]
ORACLE_SQL = {
    "log_stamps": "SELECT event_id, round(epoch_us(ts) / 1000000, 3) AS seconds FROM events UNION ALL SELECT event_id, 0.0 FROM events",
    "flat_metadata": """WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal >= 0 THEN '' || floor(c_acctbal)::BIGINT END AS balance, '[' || array_to_string(list_transform(list_sort(list_filter([n_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'in "debt"' END], lambda x: x IS NOT NULL)), lambda x: to_json(x)::VARCHAR), ', ') || ']' AS tags,
'{"debt": ' || CASE WHEN c_acctbal < 0 THEN '"yes"' ELSE 'null' END || ', "nation": ' || to_json(n_name)::VARCHAR || '}' AS place, CASE WHEN c_acctbal >= 0 THEN 4 ELSE 3 END AS keys FROM c""",
    "json_replies": """WITH e AS (SELECT coalesce(props, 'none') AS p FROM events), r AS (SELECT 'trailing brace' AS kind, 'Sure: ' || p || chr(10) || 'That is all}.' AS t FROM e UNION ALL SELECT 'plain', 'Sure: ' || p || chr(10) || 'That is all.' FROM e),
j AS (SELECT kind, CASE WHEN instr(t, '{') > 0 AND length(t) - instr(reverse(t), '}') + 1 > instr(t, '{') AND instr(t, '}') > 0 THEN substr(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) END AS j FROM r)
SELECT kind, count(*) AS n, count(*) FILTER (j IS NULL) AS without, count(*) FILTER (json_valid(j)) AS parsed FROM j GROUP BY kind""",
    "uncited_contexts": f"WITH c AS ({_CTX}) SELECT query_id, sha256(replace(regexp_replace(context || ' [open', '\\[[^\\]]*\\]', '', 'g'), '[', '')) AS sha FROM c",
    "merged_stages": "SELECT l_orderkey, l_linestatus AS stage, round(sum(l_quantity::DOUBLE), 3) AS ms FROM lineitem GROUP BY ALL",
    "refusal_texts": f"WITH s AS ({retrieval.ORACLE_SQL['sufficiency_of_hits']}) SELECT item_id, printf('I cannot answer this from the indexed document. Retrieval sufficiency scored %.2f against a threshold of %.2f, after %d refinement attempt(s), so any answer would not be supported by the source.', score, {L.SUFFICIENT}::DOUBLE, {L.MAX_ATTEMPTS}) AS answer FROM s WHERE last_route = 'refuse'",
    "leaf_pages": f"WITH {retrieval.NODES}, p AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS place FROM leaves) SELECT doc_id, id, place FROM p WHERE place BETWEEN 20 AND 29",
    "control_report": f"""WITH c AS ({guard.ORACLE_SQL["control_measurement"]}), p AS ({guard.ORACLE_SQL["provenance_delta"]}), b AS ({evaluation.ORACLE_SQL["broker_guarantee"]})
SELECT CASE WHEN control = 'combined' THEN 'combined' ELSE 'control' END AS section, control AS name, metric, value FROM (SELECT control, block_rate::DOUBLE AS block_rate, false_positive_rate::DOUBLE AS false_positive_rate, latency_ms::DOUBLE AS latency_ms, attacks::DOUBLE AS attacks, benign_runs::DOUBLE AS benign_runs FROM c) UNPIVOT (value FOR metric IN (block_rate, false_positive_rate, latency_ms, attacks, benign_runs))
UNION ALL SELECT 'provenance', CASE WHEN "on" THEN 'on' ELSE 'off' END, metric, value FROM (SELECT "on", mean::DOUBLE AS mean, low::DOUBLE AS low, high::DOUBLE AS high, deviation::DOUBLE AS deviation, repetitions::DOUBLE AS repetitions FROM p) UNPIVOT (value FOR metric IN (mean, low, high, deviation, repetitions))
UNION ALL SELECT 'broker', CASE WHEN broker THEN 'on' ELSE 'off' END, metric, value FROM (SELECT broker, payloads::DOUBLE AS payloads, escapes::DOUBLE AS escapes, ok::INT::DOUBLE AS ok FROM b) UNPIVOT (value FOR metric IN (payloads, escapes, ok))""",
}
