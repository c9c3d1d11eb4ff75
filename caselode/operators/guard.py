"""Policy, supply-chain and containment operators: decisions as ordered CASE columns over joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T


def decisions(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool calls (tool, role, amount, age) decided in order: unknown, not granted, expired, over its limit, irreversible, allowed.

    tools: name, roles, ttl, limit_ (null: none), irreversible. A tool is granted to a role that it lists.
    """
    joined = calls.join(tools.withColumnRenamed("name", "_name"), F.col("tool") == F.col("_name"), "left")
    outcome = (
        F.when(F.col("_name").isNull(), "deny: unknown tool")
        .when(~F.array_contains("roles", F.col("role")), "deny: no grant")
        .when(F.col("age") > F.col("ttl"), "deny: grant expired")
        .when(F.col("amount") > F.col("limit_"), "deny: over the limit")
        .when(F.col("irreversible"), "needs approval")
        .otherwise("allow")
    )
    return joined.withColumn("outcome", outcome).select(*calls.columns, "outcome")


def minted(principals: DataFrame, tools: DataFrame) -> DataFrame:
    """Grants: each principal (who, roles) with each tool that shares a role; roles meet by equality, not by a cross product."""
    left = principals.select("who", F.explode("roles").alias("role"))
    right = tools.select("name", "ttl", "irreversible", F.explode("roles").alias("role"))
    return left.join(right, "role").select("who", "name", "ttl", "irreversible").distinct()


def rule_of_two(grants: DataFrame, private: list[str], outward: list[str]) -> DataFrame:
    """Lamp by principal from three properties: untrusted input (always), private data, outward action without approval."""
    sees, acts = F.bool_or(F.col("name").isin(*private)), F.bool_or(F.col("name").isin(*outward) & ~F.col("irreversible"))
    out = grants.groupBy("who").agg(sees.alias("private"), acts.alias("outward"))
    n = F.lit(1) + F.col("private").cast("int") + F.col("outward").cast("int")
    return out.withColumn("held", n).withColumn("lamp", F.when(n == 3, "red").when(n == 2, "amber").otherwise("green"))


def transfers(regions: DataFrame) -> DataFrame:
    """Each of the three transfers for each region (column region), permitted or not."""
    return regions.select("region", F.explode(T.words_of(L.TRANSFERS)).alias("transfer")).withColumn("permitted", F.col("region").isin(*L.PERMITTED_REGIONS))


def resolved(requests: DataFrame) -> DataFrame:
    """requests (provider, region) with the refusal, if any; never the nearest region instead."""
    spark = requests.sparkSession
    table = spark.createDataFrame([(p, list(r)) for p, r in L.PROVIDER_REGIONS.items()], "_provider string, regions array<string>")
    joined = requests.join(F.broadcast(table), F.col("provider") == F.col("_provider"), "left")
    why = F.when(~F.col("region").isin(*L.PERMITTED_REGIONS), "region not permitted").when(~F.array_contains("regions", F.col("region")), "provider not in region").otherwise("")
    return joined.select(*requests.columns, why.alias("refusal"))


def unjustified(manifests: DataFrame) -> DataFrame:
    """Capabilities (exploded from manifests: id, description, capabilities) that no word of the description justifies."""
    spark: SparkSession = manifests.sparkSession
    table = spark.createDataFrame([(c, list(w)) for c, w in L.JUSTIFIED_BY.items()], "_capability string, because array<string>")
    rows = manifests.select("id", T.words(F.col("description")).alias("words"), F.explode("capabilities").alias("capability"))
    joined = rows.join(F.broadcast(table), F.col("capability") == F.col("_capability"), "left")
    return joined.where(F.col("because").isNull() | ~F.arrays_overlap("words", "because")).select("id", "capability", F.col("because").isNull().alias("unknown"))


def lock_status(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Lock entries (name, pinned) against digests of files (name, sha): unpinned, absent, moved or ok."""
    joined = entries.join(files, "name", "left")
    return joined.select("name", F.when(F.col("pinned").isNull(), "unpinned").when(F.col("sha").isNull(), "absent").when(F.col("sha") != F.col("pinned"), "moved").otherwise("ok").alias("status"))


def surface_changes(runtime: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Names on one side only: at run time but not reviewed, or reviewed but gone."""
    new = runtime.join(reviewed, "name", "left_anti").withColumn("finding", F.lit("not reviewed"))
    return new.unionByName(reviewed.join(runtime, "name", "left_anti").withColumn("finding", F.lit("stale")))


def measured(runs: DataFrame, *by: str) -> DataFrame:
    """Block rate of attacks that escape bare, false-positive rate of benign runs, mean latency; empty groups give 0."""
    rate = lambda hit, base: F.round(F.coalesce(F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0)), F.lit(0.0)), 4)
    attack = ~F.col("benign") & F.col("escapes_bare")
    latency = F.round(F.sum(F.col("latency_ms").cast("decimal(20,6)")).cast("double") / F.count("latency_ms"), 3)
    return runs.groupBy(*by).agg(rate(F.col("blocked"), attack).alias("block_rate"), rate(F.col("blocked"), F.col("benign")).alias("false_positive_rate"), latency.alias("latency_ms"), F.count_if(attack).alias("attacks"), F.count_if(F.col("benign")).alias("benign_runs"))


def verdict(goal: Column, contained_by: Column, rewrote: Column, refused: Column) -> Column:
    """What contained a run, in order of attribution; escaped where nothing did."""
    return F.when(contained_by, "blocked").when(rewrote, "rewritten").when(refused, "refused").otherwise(F.concat(F.lit("escaped: "), goal))
