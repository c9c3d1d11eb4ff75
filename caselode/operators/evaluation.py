"""Evaluation of recorded runs: request times, cost and time by layer, scored rows and gates, scan reports, settings, fences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions import spans as S
from caselode.functions.stats import exact_mean, with_ranks

#: Classes of entities that count as personal, and parameters that name a place outside.
PERSONAL = ("ni_number", "payroll_id", "phone", "person_name")
OUTSIDE = ("url", "host_path")


def zero() -> Column:
    return F.lit(0.0)


def stage_total(stages: Column) -> Column:
    """Sum of a map of stage times."""
    return F.round(F.aggregate(F.map_values(stages), zero(), lambda s, x: s + x), 3)


def non_generation(stages: Column, e2e: Column) -> Column:
    return F.round(F.greatest(zero(), e2e - F.coalesce(stages["generate"], zero())), 3)


def orchestration(stages: Column, e2e: Column) -> Column:
    """Time that no stage claims."""
    return F.round(F.greatest(zero(), e2e - stage_total(stages)), 3)


def formula_gap(e2e: Column, ttft: Column, itl: Column, tokens: Column) -> Column:
    """What is left beside the first token and the gaps between the others; may be negative."""
    return F.round(e2e - (ttft + itl * F.greatest(F.lit(0), tokens - 1)), 3)


def by_layer(events: DataFrame) -> DataFrame:
    """request, layer, cost_usd and latency_ms of control events (request, layer, cost_usd decimal, latency_ms)."""
    cost, time = F.sum(F.col("cost_usd").cast("decimal(28,8)")).cast("double"), F.sum(F.col("latency_ms").cast("decimal(28,3)")).cast("double")
    return events.groupBy("request", "layer").agg(F.round(cost, 8).alias("cost_usd"), F.round(time, 3).alias("latency_ms"))


def blocked_by(events: DataFrame) -> DataFrame:
    """request and its blocking layers, comma-joined, in the order in which each first blocked (events also have position, blocked)."""
    first = events.where("blocked").groupBy("request", "layer").agg(F.min("position").alias("position"))
    return first.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "layer"))), lambda x: x.layer), ",").alias("blocked_by"))


def layer_means(layers: DataFrame) -> DataFrame:
    """Mean time and cost of each layer over the runs that have a time for it."""
    runs = F.greatest(F.lit(1), F.count("latency_ms"))
    mean = lambda c, n: F.round(F.sum(F.col(c).cast("decimal(28,8)")).cast("double") / runs, n).alias(c)
    return layers.groupBy("layer").agg(mean("latency_ms", 3), mean("cost_usd", 8), F.count("latency_ms").alias("runs"))


def tally(runs: DataFrame) -> DataFrame:
    """One row of both rates over runs (benign, escapes_bare, contained, blocked); a rate of nothing is null."""
    attack, graded, harmless = ~F.col("benign"), ~F.col("benign") & F.col("escapes_bare"), F.col("benign")
    rate = lambda hit, base: F.round(F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0)), 4)
    return runs.agg(
        F.count_if(attack).alias("attacks"), F.count_if(graded).alias("gradeable"), F.count_if(graded & F.col("contained")).alias("contained"), rate(F.col("contained"), graded).alias("block_rate"),
        F.count_if(harmless).alias("benign"), F.count_if(harmless & F.col("blocked")).alias("false_positives"), rate(F.col("blocked"), harmless).alias("false_positive_rate"),
    )


def citation_hit(expected: Column, retrieved: Column) -> Column:
    """Whether every expected citation's provision is among the retrieved ones; only the retrieved side is trimmed."""
    head = lambda c: F.substring_index(c, "(", 1)
    there = F.transform(retrieved, lambda c: F.trim(head(c)))
    return (F.size(expected) > 0) & F.forall(expected, lambda c: F.array_contains(there, head(c)))


def shippable(groundedness: Column, coverage: Column) -> Column:
    """Supported and attributable."""
    return F.when(groundedness.isNotNull() & coverage.isNotNull(), F.least(groundedness, coverage))


def experiment(rows: DataFrame) -> DataFrame:
    """The summary of evaluated rows (should_refuse, known_failure, refused, citation_hit, cost_usd, e2e_ms): one row."""
    answerable = ~F.col("should_refuse") & ~F.col("known_failure")
    share = lambda hit, base, other: F.coalesce(F.round(F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0)), 4), F.lit(other))
    aggs = {
        "n": F.count(F.lit(1)), "answerable": F.count_if(answerable), "refusal_rows": F.count_if(F.col("should_refuse")), "known_failures": F.count_if(F.col("known_failure")),
        "citation_hit_rate": share(F.col("citation_hit"), answerable, 0.0), "refusal_accuracy": share(F.col("refused"), F.col("should_refuse"), 1.0),
        "cost_usd_total": F.round(F.coalesce(F.sum(F.col("cost_usd").cast("decimal(28,8)")).cast("double"), zero()), 6),
    }
    return with_ranks(rows, (), "e2e_ms", {"e2e_ms_p95": 0.95}, aggs).withColumn("e2e_ms_p95", F.round("e2e_ms_p95", 2))


def dimensions(rows: DataFrame, *names: str) -> DataFrame:
    """Mean, p10, minimum and number of the scores of answerable rows, by dimension; missing scores are left out."""
    some = rows.where("not should_refuse and not known_failure")
    long = some.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("name", "score")).where("score is not null")
    found = with_ranks(long, ("name",), "score", {"p10": 0.1}, {"mean": F.round(exact_mean(F.col("score")), 4), "low": F.round(F.min("score"), 4), "n": F.count("*")})
    return found.select("name", "mean", F.round("p10", 4).alias("p10"), "low", "n")


def intents(rows: DataFrame, *names: str) -> DataFrame:
    """Mean scores of answerable rows by intent; a missing score counts as 0."""
    named = F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("unknown")).alias("intent")
    return rows.where("not should_refuse and not known_failure").groupBy(named).agg(F.count("*").alias("n"), *[F.round(exact_mean(F.coalesce(n, zero())), 4).alias(n) for n in names])


def gates(observed: DataFrame, thresholds: dict[str, float], at_most: tuple[str, ...] = ()) -> DataFrame:
    """name, observed, threshold and passed of each gate with a threshold, and the row "all": passed if all are."""
    limit = F.create_map(*[x for n, v in thresholds.items() for x in (F.lit(n), F.lit(float(v)))])
    rows = observed.where(F.col("name").isin(*thresholds)).select("name", "observed", limit[F.col("name")].alias("threshold"))
    ok = F.when(F.col("name").isin(*at_most), F.col("observed") <= F.col("threshold")) if at_most else F.when(F.lit(False), F.lit(True))
    rows = rows.withColumn("passed", ok.otherwise(F.col("observed") >= F.col("threshold")))
    whole = rows.agg(F.lit("all").alias("name"), F.count_if("passed").cast("double").alias("observed"), F.lit(float(len(thresholds))).alias("threshold"))
    return rows.unionByName(whole.withColumn("passed", F.col("observed") == F.col("threshold")))


def scan_report(findings: DataFrame) -> DataFrame:
    """Counts by severity, first failure and verdict of findings (scanner, severity, subject), by scanner and for all of them."""
    both = findings.select(F.explode(F.array(F.col("scanner"), F.lit("all"))).alias("scanner"), "severity", "subject")
    count = [F.count_if(F.col("severity") == s).alias(s) for s in ("FAIL", "WARN", "PASS")]
    return both.groupBy("scanner").agg(*count, F.min(F.when(F.col("severity") == "FAIL", F.col("subject"))).alias("first_failure"), (F.count_if(F.col("severity") == "FAIL") == 0).alias("ok"))


def match_preset(state: Column, presets: dict[str, set[str]]) -> Column:
    """Name of the first preset (its switches that are on) that a map of switches equals on its own keys; else custom."""
    equal = lambda on: F.forall(F.map_entries(state), lambda e: e.value == e.key.isin(*on) if on else ~e.value)
    return F.coalesce(*[F.when(equal(sorted(on)), F.lit(name)) for name, on in presets.items()], F.lit("custom"))


def enabled(state: Column) -> Column:
    """The switches that are on, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.map_keys(F.map_filter(state, lambda _, v: v))), ",")


def carries_destination(params: Column, inside: tuple[str, ...]) -> Column:
    """Whether a call's parameters take data to a place that is not inside."""
    value = lambda k: F.coalesce(params[k], F.lit(""))
    domain = F.lower(F.substring_index(value("to"), "@", -1))
    return reduce(lambda a, b: a | b, [value(k) != "" for k in OUTSIDE], (domain != "") & ~domain.isin(*inside))


def carries_personal(params: Column) -> Column:
    """Whether a parameter's value holds a personal entity."""
    return F.exists(F.map_values(params), lambda v: F.exists(S.entities(v), lambda e: e.cls.isin(*PERSONAL)))


def offered(grants: DataFrame, principals: DataFrame, tools: DataFrame) -> DataFrame:
    """who and name of the tools offered to principals (who, broker): those minted for them under the broker, else all."""
    under = grants.join(principals.where("broker").select("who"), "who", "left_semi").select("who", "name")
    every = tools.agg(F.collect_set("name").alias("names"))  # the tool table, a handful of rows
    free = principals.where("not broker").join(F.broadcast(every)).select("who", F.explode("names").alias("name"))
    return under.unionByName(free)


def guaranteed(escaped: Column) -> list[Column]:
    """Number of decided calls, how many escaped, and whether none did, as aggregates."""
    return [F.count(F.lit(1)).alias("payloads"), F.count_if(escaped).alias("escapes"), (F.count_if(escaped) == 0).alias("ok")]


def fenced(text: Column, citation: Column, tier: Column, ingested: Column, nonce: Column, notes: dict[str, str]) -> Column:
    """Evidence between delimiters that carry the request's nonce; the citation stays in front. A missing tier is corpus, an unknown one an error."""
    own = F.coalesce(tier, F.lit("corpus"))
    known = F.create_map(*[x for n, v in notes.items() for x in (F.lit(n), F.lit(v))])[own]
    note = F.coalesce(known, F.raise_error(F.concat(F.lit("no note for the trust tier "), own)))
    opening = F.concat(F.lit("<evidence:"), nonce, F.lit(' trust="'), own, F.lit('" ingested="'), F.coalesce(ingested, F.lit("unknown")), F.lit('" note="'), note, F.lit('">'))
    cited = F.coalesce(F.nullif(citation, F.lit("")), F.lit("uncited"))
    return F.concat(F.lit("["), cited, F.lit("] "), opening, F.lit("\n"), F.trim(F.coalesce(text, F.lit(""))), F.lit("\n</evidence:"), nonce, F.lit(">"))


def annotations(rows: DataFrame, key: str, names: tuple[str, ...], route: str | None = None) -> DataFrame:
    """A row for each score of a row, by name, and one for its sufficiency, labelled by the route taken."""
    long = rows.select(key, F.explode(F.create_map(*[x for n in sorted(names) for x in (F.lit(n), F.col(n))])).alias("name", "score"), F.lit("").alias("label"))
    if route is None:
        return long
    return long.unionByName(rows.select(key, F.lit("sufficiency").alias("name"), F.col("sufficiency").alias("score"), F.col(route).alias("label")))


def caveat(rows: DataFrame) -> DataFrame:
    """Means of coverage and groundedness of healthy and degraded rows, their moves, and whether groundedness barely moved."""
    mean = lambda c, bad: F.coalesce(F.round(exact_mean(F.when(F.col("degraded") == bad, F.col(c))), 6), zero())
    out = rows.agg(*[mean(c, bad).alias(f"{c}_{name}") for c in ("citation_coverage", "groundedness") for name, bad in (("before", False), ("after", True))])
    drop = lambda c: F.col(f"{c}_before") - F.col(f"{c}_after")
    return out.withColumn("barely_moved", drop("groundedness") < drop("citation_coverage") / 3)
