"""For each of many term sets, the rows that share most terms with it: no join of common terms, no pairs shuffled.

The asked sets are the stated, small side. They go to the tasks in blocks of at most ``BLOCK`` pairs of set and term (or of one
set); a task counts, row by row, how often each set is met by the row's terms, and keeps its best ``k`` rows of each set. Only
these are shuffled and ranked: by terms shared, then by id. Rows that share nothing are no answers; null ids are left out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 500_000


def _block_of(asked: DataFrame, limit: int):
    """The number of blocks, and the column that deals sets to them."""
    sizes = asked.select("item", F.size("terms").alias("n"))
    n = max(1, -(-2 * (sizes.agg(F.sum("n")).head()[0] or 0) // limit))
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        full = sizes.groupBy(block.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets")).where((F.col("n") > limit) & (F.col("sets") > 1))
        if n == 1 or full.isEmpty():
            return n, block
        n *= 2


def most_shared(asked: DataFrame, rows: DataFrame, k: int, limit: int = BLOCK) -> DataFrame:
    """item, id, shared and rank of the k rows (id, terms) that share most terms with each asked set (item, terms); terms are distinct."""
    kinds, spark = (dict(asked.dtypes)["item"], dict(rows.dtypes)["id"]), rows.sparkSession
    n, block = _block_of(asked, limit)
    parts = []
    for b in range(n):
        sets = asked.where(block == b).collect()  # at most limit terms, or one set
        holders: dict[str, list[int]] = defaultdict(list)
        for place, r in enumerate(sets):
            for term in r.terms:
                holders[term].append(place)
        of = {t: np.array(p) for t, p in holders.items()}
        if of:
            names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(sets)], f"place long, item {kinds[0]}")
            parts.append(_tasks_best(rows, of, len(sets), k, kinds[1]).join(F.broadcast(names), "place").drop("place"))
    if not parts:
        return spark.createDataFrame([], f"item {kinds[0]}, id {kinds[1]}, shared long, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("shared"), "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "id", "shared", "rank")


def _tasks_best(rows: DataFrame, of: dict[str, np.ndarray], sets: int, k: int, kind: str) -> DataFrame:
    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        table = pd.concat(found, ignore_index=True).sort_values(["place", "shared", "id"], ascending=[True, False, True])
        return table[table.groupby("place").cumcount() < k]

    def run(batches):
        least, found, held = np.ones(sets, np.int64), [], 0
        for batch in batches:
            places, ids, shares = [], [], []
            for key, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met = [of[t] for t in terms or () if t in of]
                if met and key is not None:
                    count = np.bincount(np.concatenate(met), minlength=sets)
                    good = np.flatnonzero(count >= least)
                    places.append(good)
                    shares.append(count[good])
                    ids += [key] * len(good)
            if ids:
                found.append(pd.DataFrame({"place": np.concatenate(places), "id": ids, "shared": np.concatenate(shares)}))
                held += len(ids)
            if held > 4 * k * sets + 100_000:
                found = [best(found)]
                held = len(found[0])
                kth = found[0].groupby("place").shared.agg(["count", "min"])
                full = kth[kth["count"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if found:
            schema = pa.schema([("place", pa.int64()), ("id", batch.schema.field(0).type), ("shared", pa.int64())])
            yield from pa.Table.from_pandas(best(found), preserve_index=False).select(schema.names).cast(schema).to_batches()

    return rows.select("id", "terms").mapInArrow(run, f"place long, id {kind}, shared long")
