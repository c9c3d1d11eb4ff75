"""Cost model: token prices, five components, repricing. Money is DECIMAL throughout and rounded as each step says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import lexicons as L


def prices(spark: SparkSession) -> DataFrame:
    """The price table, nine models: USD per million tokens."""
    rows = spark.createDataFrame(list(L.PRICES), "model string, i string, o string, c string")
    return rows.select("model", *[F.col(a).cast("decimal(12,6)").alias(b) for a, b in (("i", "input"), ("o", "output"), ("c", "cached"))])


def priced(usage: DataFrame, model: str = "model") -> DataFrame:
    """usage with its model's prices, those of the fallback model where it has none."""
    spark = usage.sparkSession
    table = prices(spark)
    other = table.where(F.col("model") == L.FALLBACK_MODEL).select(*[F.col(c).alias(f"f_{c}") for c in ("input", "output", "cached")])
    found = usage.join(F.broadcast(table.withColumnRenamed("model", "_model")), F.col(model) == F.col("_model"), "left").join(F.broadcast(other))
    return found.select(*usage.columns, *[F.coalesce(c, f"f_{c}").alias(c) for c in ("input", "output", "cached")])


def usd(tokens: Column, price: Column) -> Column:
    """tokens at a price per million, 8 places."""
    return F.round(tokens.cast("decimal(20,0)") * price / F.lit(1_000_000).cast("decimal(10,0)"), 8).cast("decimal(28,8)")


def token_costs(usage: DataFrame) -> DataFrame:
    """usage (model, prompt, completion, cached_tokens) with input, cached, output and total USD; cached is part of prompt."""
    cached = F.least("cached_tokens", "prompt")
    parts = {"input_usd": usd(F.col("prompt") - cached, F.col("input")), "cached_usd": usd(cached, F.col("cached")), "output_usd": usd(F.col("completion"), F.col("output"))}
    out = priced(usage).withColumns(parts)
    return out.withColumn("total_usd", (F.col("input_usd") + F.col("cached_usd") + F.col("output_usd")).cast("decimal(28,8)")).select(*usage.columns, *parts, "total_usd")


def components(usage: DataFrame, infra: Column | None = None) -> DataFrame:
    """usage (with trace_bytes) and the five components of its bill, their total and the dominant one (first on ties)."""
    judge = F.when(F.col("model").isin(*L.REFERENCE_MODELS), L.JUDGE_MODEL).otherwise(F.col("model"))
    costs = token_costs(usage)
    judged = priced(costs.withColumn("_judge", judge), "_judge")
    ten = lambda c: F.round(c, 10).cast("decimal(28,10)")
    num = lambda x: F.lit(x).cast("decimal(20,10)")
    parts = {
        "generation_input": ten(F.col("input_usd") + F.col("cached_usd")),
        "generation_output": ten(F.col("output_usd")),
        "judge": ten((usd(F.col("prompt") + F.col("completion"), F.col("input")) + usd(F.lit(L.JUDGE_OUTPUT), F.col("output"))) * F.lit(L.JUDGE_RATE).cast("decimal(4,2)")),
        "trace_storage": ten(F.col("trace_bytes").cast("decimal(20,0)") * F.lit(str(float(L.STORAGE_USD) * int(L.MONTHS) / 1e9 * 1e9)).cast("decimal(6,3)") / F.lit(1_000_000_000).cast("decimal(10,0)")),
        "infrastructure": ten(num(L.INFRA_USD) if infra is None else infra),
    }
    out = judged.withColumns(parts)
    top = F.greatest(*L.COMPONENTS)
    dominant = F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in L.COMPONENTS])
    total = sum((F.col(c) for c in L.COMPONENTS[1:]), F.col(L.COMPONENTS[0])).cast("decimal(28,10)")
    return out.select(*usage.columns, *L.COMPONENTS, total.alias("component_usd"), dominant.alias("dominant"))


def reprice(usage: DataFrame, models: list[str], per_day: int = 1000) -> DataFrame:
    """All of usage priced once per model: tokens are summed first. Projection for 30 days, ratio to the first model."""
    spark = usage.sparkSession
    sums = usage.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("prompt", "completion", "cached_tokens")])
    table = prices(spark).where(F.col("model").isin(*models))
    bill = token_costs(sums.join(F.broadcast(table.select("model"))))
    first = bill.where(F.col("model") == models[0]).select(F.col("total_usd").alias("base"))
    total = F.col("total_usd").cast("double")
    return bill.join(F.broadcast(first)).select(
        "model", "n", F.round(total, 6).alias("total_usd"), F.round(total / F.col("n") * per_day * 30, 2).alias("per_month"), F.round(total / F.col("base").cast("double"), 3).alias("ratio")
    )


def reprice_components(usage: DataFrame, models: list[str], per_day: int = 1000) -> DataFrame:
    """All of usage under each model, component by component; tokens and bytes are summed first, infrastructure is by request."""
    size = F.coalesce("trace_bytes", F.lit(L.OVERHEAD_BYTES))
    sums = usage.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("prompt", "completion", "cached_tokens")], F.sum(size).alias("trace_bytes"))
    table = prices(usage.sparkSession).where(F.col("model").isin(*models)).select("model")
    requests = F.greatest(F.lit(1), F.col("n"))
    out = components(sums.join(F.broadcast(table)), F.lit(L.INFRA_USD).cast("decimal(20,10)") * requests)
    total = F.col("component_usd").cast("double")
    money = [F.round(total, 6).alias("total_usd"), F.round(total / requests, 8).alias("per_request_usd"), F.round(total / requests * per_day * 30, 2).alias("per_month")]
    return out.select("model", "n", *[F.col(c).cast("double").alias(c) for c in L.COMPONENTS], *money, "dominant")
