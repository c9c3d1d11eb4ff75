"""Statistics with the exact definitions that the panels need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch that brackets a rank: its error is a share of 1 / ACCURACY of the rows, the bracket MARGIN times as wide on either side.
ACCURACY, MARGIN = 10_000, 4


def nearest_rank(column: str, p: float) -> Column:
    """Nearest-rank percentile as an aggregate: the ceil(p * n)-th smallest value, 0 for none; never interpolated."""
    if not 0 < p <= 1:
        raise ValueError(f"p must lie in (0, 1], got {p}")
    return F.coalesce(F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY `{column}`)"), F.lit(0.0))


def with_ranks(df: DataFrame, by: Sequence[str], column: str, asks: dict[str, float], aggs: dict[str, Column] | None = None, rank: Callable[[Column, float], Column] | None = None) -> DataFrame:
    """by, the aggregates, and under each name of asks the nearest-rank percentile of column, exact, 0 where it has no value.

    ``nearest_rank`` holds all distinct values of a group in one task; this does not. A first pass takes, with the aggregates, a
    mergeable sketch that brackets each rank. A second counts what lies below each bracket and the values inside, about a
    thousandth of the rows; the rank is found among those. A bracket that missed its rank would be an error, not a wrong value.
    """
    rank = rank or (lambda n, p: F.ceil(n * p))
    ends = [x for p in asks.values() for x in (max(0.0, p - MARGIN / ACCURACY), min(1.0, p + MARGIN / ACCURACY))]
    sketch = F.percentile_approx(column, F.array(*[F.lit(x) for x in ends]), ACCURACY)
    aggs = aggs or {}
    kept = [f"_agg{i}" for i in range(len(aggs))]
    first = df.groupBy(*by).agg(*[a.alias(k) for a, k in zip(aggs.values(), kept, strict=True)], F.count(column).alias("_n"), sketch.alias("_ends"), F.min(column).alias("_least"), F.max(column).alias("_most"))
    names = first.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *kept, "_n", "_ends", "_least", "_most")
    rows = df.select(*by, F.col(column).alias("_v"))
    on = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    if not by:  # a table without rows has one group all the same
        rows = rows.unionByName(df.sparkSession.range(1).select(F.lit(None).cast(dict(rows.dtypes)["_v"]).alias("_v")))
    met = rows.join(names, on) if by else rows.join(F.broadcast(names))
    # a bracket that reaches an end of the ranks takes in that end's values
    low = [F.when(F.lit(ends[2 * i] <= 0), F.col("_least")).otherwise(F.col("_ends")[2 * i]) for i in range(len(asks))]
    high = [F.when(F.lit(ends[2 * i + 1] >= 1), F.col("_most")).otherwise(F.col("_ends")[2 * i + 1]) for i in range(len(asks))]
    places = F.array(*[F.when(F.col("_v") <= high[i], F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= low[i], F.col("_v")).alias("x"))) for i in range(len(asks))])
    counted = met.select(*by, *kept, "_n", F.explode_outer(F.array_compact(places)).alias("_p")).groupBy(*by, *kept, "_n", "_p.i", "_p.x").agg(F.count(F.lit(1)).alias("_c"))
    so_far = F.sum("_c").over(Window.partitionBy(*by, "i").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("_sum", so_far)

    missed = F.raise_error(F.lit("a bracket missed its rank"))
    wanted = F.coalesce(*[F.when(F.col("i") == i, F.greatest(F.lit(1), rank(F.col("_n"), p).cast("long"))) for i, p in enumerate(asks.values())])
    out = counted.withColumn("_x", F.when(F.col("_sum") >= wanted, F.when(F.col("x").isNull(), missed).otherwise(F.col("x"))))
    ranks = [F.min(F.when(F.col("i") == i, F.col("_x"))).alias(f"_r{i}") for i in range(len(asks))]
    out = out.groupBy(*by, *kept, "_n").agg(*ranks)
    zero = lambda i: F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col(f"_r{i}"), missed))
    return out.select(*by, *[F.col(k).alias(name) for k, name in zip(kept, aggs, strict=True)], *[zero(i).alias(name) for i, name in enumerate(asks)])


def exact_sum(column: Column, scale: int = 6) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum(column.cast(f"decimal(28,{scale})"))


def exact_mean(column: Column, scale: int = 6) -> Column:
    return exact_sum(column, scale).cast("double") / F.count(column)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, 0 where either is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
