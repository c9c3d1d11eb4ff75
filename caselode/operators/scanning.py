"""Scans that say where they fired: questions are cut, blocks are dropped, answers are held back, source lines are named.

Every rule needs two signals. What a rule fired on is the first sentence that holds its needle, or the needle itself for a
tool's name. Null texts are empty and pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import spans as S
from caselode.functions import text as T


def _parts(text: Column) -> Column:
    cut = F.split(F.regexp_replace(text, r"([.;:])\s+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _first(text: Column, needles: Sequence[str]) -> Column:
    """The first sentence that holds a needle, else the text's first 200 characters."""
    return F.coalesce(F.get(F.filter(_parts(text), lambda s: T.any_of(F.lower(s), needles)), 0), F.substring(text, 1, 200))


def findings(text: Column, tools: Sequence[str] = L.TOOL_NAMES) -> Column:
    """rule and text of every rule that fires, in the order of the rules."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    addressed, named = F.lit(None).cast("string"), F.lit(None).cast("string")
    for phrase in reversed(L.SYSTEM_ADDRESS):
        addressed = F.when(low.contains(phrase), F.lit(phrase)).otherwise(addressed)
    for name in reversed(tools):
        named = F.when(low.contains(name), F.lit(name)).otherwise(named)
    spoken = F.coalesce(F.get(F.filter(_parts(text), lambda s: F.contains(F.lower(s), addressed)), 0), F.substring(text, 1, 200))
    rules = (
        ("override_instructions", T.near(low, L.OVERRIDE_VERBS, L.OVERRIDE_OBJECTS), _first(text, L.OVERRIDE_VERBS)),
        ("addressed_to_the_system", addressed.isNotNull(), spoken),
        ("prompt_extraction", T.near(low, L.EXTRACTION_VERBS, L.EXTRACTION_OBJECTS, 40), _first(text, L.EXTRACTION_OBJECTS)),
        ("names_a_tool", named.isNotNull(), named),
        ("imperative_with_recipient", F.exists(_parts(text), T.imperative_send), F.get(F.filter(_parts(text), T.imperative_send), 0)),
    )
    return F.array_compact(F.array(*[F.when(fires, F.struct(F.lit(rule).alias("rule"), where.alias("text"))) for rule, fires, where in rules]))


def _rules(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m.rule))), ", ")


def scanned_questions(rows: DataFrame, column: str = "question", tools: Sequence[str] = L.TOOL_NAMES) -> DataFrame:
    """rows with passed, reason, matched and cleaned: what fired is cut out of the question; where nothing can be cut, all of it goes."""
    rows = rows.withColumn("_found", findings(F.col(column), tools)).withColumn("_text", F.coalesce(column, F.lit("")))
    # the cuts one after the other, as one may take away what another would have found
    cut = F.aggregate("_found", F.col("_text"), lambda t, m: F.when(m.text != "", F.replace(t, m.text, F.lit(L.REDACTION))).otherwise(t))
    passed = F.size("_found") == 0
    reason = F.when(passed, "heuristic: no instruction-shaped text in the question").otherwise(F.concat(F.lit("heuristic: "), _rules(F.col("_found")), F.lit(" in the question")))
    rows = rows.withColumn("_cut", cut)
    cleaned = F.when(passed, F.col(column)).when(F.col("_cut") == F.col("_text"), L.REDACTION).otherwise(F.col("_cut"))
    return rows.withColumns({"passed": passed, "reason": reason, "matched": F.coalesce(F.get("_found", 0).text, F.lit("")), "cleaned": cleaned}).drop("_found", "_text", "_cut")


def scanned_blocks(blocks: DataFrame, tools: Sequence[str] = L.TOOL_NAMES) -> tuple[DataFrame, DataFrame]:
    """The blocks (request_id, place, block_id, text) that stay, and a row for each request: a block in which a rule fires is dropped whole,
    as a citation of what is left of it would look like attribution."""
    found = blocks.withColumn("_found", findings(F.col("text"), tools))
    flagged = F.size("_found") > 0
    rules = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("_found", lambda m: m.rule))))), ", ")
    per = found.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("dropped"), rules.alias("rules"), F.min_by(F.get("_found", 0).text, F.when(flagged, F.col("place"))).alias("first"),
        F.array_sort(F.collect_list(F.when(flagged, F.col("block_id")))).alias("flagged_ids"),
    )
    n = F.col("n").cast("string")
    reason = F.when(F.col("dropped") == 0, F.concat(F.lit("heuristic: "), n, F.lit(" retrieved block(s), none instruction-shaped"))).otherwise(F.concat(F.lit("heuristic: dropped "), F.col("dropped").cast("string"), F.lit(" of "), n, F.lit(" retrieved block(s) ("), F.col("rules"), F.lit(")")))
    return found.where(~flagged).drop("_found"), per.select("request_id", (F.col("dropped") == 0).alias("passed"), reason.alias("reason"), F.when(F.col("dropped") > 0, F.col("first")).otherwise("").alias("matched"), "flagged_ids")


def outbound(answer: Column, held: Column) -> Column:
    """passed, reason and matched of an answer against the request's vault (placeholder to value): personal data that the request did not
    hold is a judgement against the answer, never rewritten."""
    stripped = F.aggregate(F.map_keys(held), F.coalesce(answer, F.lit("")), lambda t, key: F.replace(t, key, F.lit("")))
    known = F.transform(F.map_values(held), lambda v: F.lower(v))
    leaks = F.filter(S.entities(stripped), lambda e: ~F.array_contains(known, F.lower(e.value)) & e.cls.isin(*L.PERSONAL))
    cls = F.get(leaks, 0).cls
    reason = F.concat(F.lit("outbound scan: the answer contains an unmasked "), cls, F.lit(" that was not in the request"))
    return F.struct((F.size(leaks) == 0).alias("passed"), F.coalesce(reason, F.lit("outbound scan: no unmasked PII in the answer")).alias("reason"), F.coalesce(F.concat(F.lit("<"), cls, F.lit(">")), F.lit("")).alias("matched"))


def numbered_lines(files: DataFrame, name: str, text: str) -> DataFrame:
    """name, n (from 1) and line of every line of files; carriage returns at line ends are dropped."""
    return files.select(F.col(name).alias("name"), F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def source_lines(spark: SparkSession, path: str, pattern: str = "*.py", skip: Sequence[str] = L.SKIPPED_PARTS) -> DataFrame:
    """Numbered lines of the files below a folder; those that are not UTF-8, or lie below a skipped folder, are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip])))
    return numbered_lines(kept.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null"), "path", "text")


def call_sites(lines: DataFrame, pattern: str = L.UNSAFE_LOAD, scanner: str = "scan_model", summary: str = "weights_only=False turns the restricted unpickler back off") -> DataFrame:
    """A finding for every line that holds the pattern, its subject file:line."""
    return lines.where(F.col("line").rlike(pattern)).select(F.lit(scanner).alias("scanner"), F.lit("FAIL").alias("severity"), F.concat_ws(":", "name", "n").alias("subject"), F.lit(summary).alias("summary"))


FINDING = ("scanner", "severity", "subject", "summary")


def found(rows: DataFrame, scanner: str, severity: Column, subject: Column, summary: Column) -> DataFrame:
    """rows as findings, those without a severity left out."""
    return rows.select(F.lit(scanner).alias("scanner"), severity.alias("severity"), subject.cast("string").alias("subject"), summary.alias("summary")).where("severity is not null")


def every_finding(manifests: DataFrame, unjustified: DataFrame, lock: DataFrame, surface: DataFrame, lines: DataFrame, pattern: str = L.UNSAFE_LOAD) -> DataFrame:
    """One union of what all scanners find: skills (manifests: id; unjustified: id, capability, unknown), lock entries (name, status), tool
    surfaces (name, finding) and source lines (name, n, line); what is in order gives a PASS of its own."""
    bad = unjustified.groupBy("id").agg(F.max("unknown").alias("unknown"), F.array_join(F.array_sort(F.collect_set("capability")), ", ").alias("capabilities"))
    skills = found(bad, "scan_skills", F.when(F.col("unknown"), "WARN").otherwise("FAIL"), F.col("id"), F.concat(F.lit("nothing in the description justifies "), F.col("capabilities")))
    fine = found(manifests.join(bad, "id", "left_anti"), "scan_skills", F.lit("PASS"), F.col("id"), F.lit("every capability is justified"))
    status = F.col("status")
    locked = found(lock, "scan_lock", F.when(status.isin("moved", "absent"), "FAIL").when(status == "unpinned", "WARN").otherwise("PASS"), F.col("name"), F.concat(F.lit("lock entry "), status))
    tools = found(surface, "scan_tool_surface", F.when(F.col("finding") == "not reviewed", "FAIL").otherwise("WARN"), F.col("name"), F.col("finding"))
    return skills.unionByName(fine).unionByName(locked).unionByName(tools).unionByName(call_sites(lines, pattern))
