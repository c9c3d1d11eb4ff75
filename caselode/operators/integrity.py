"""Hash chains, their anchors, and retention.

A record's hash covers its sequence, the hash before it and its fields, so writing a chain goes record by record: tasks stream
through sorted chains and hold one hash. Checking is parallel, as each record stores the hash before it. An anchor is what a
chain came to at some time, kept where the log's writer cannot reach it: a log that was rewritten as a whole verifies, but no
longer has its anchor's hash in the anchor's place.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions import lexicons as L

ANCHOR_NOTE = "Publish this to a separately controlled system. A checkpoint stored beside the log it protects is a demonstration, not a control."


def payload(*columns: str) -> Column:
    """The fields of a record as one text; each stands after its length, so that no two records have one form. Null is a dash."""
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def sealed(sequence: int, previous: str, fields: str) -> str:
    return hashlib.sha256(f"{sequence}|{previous}|{fields}".encode()).hexdigest()


def record_hash(*fields: str) -> Column:
    """What ``sealed`` gives, as a column over sequence, previous_hash and the fields."""
    return F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "previous_hash", payload(*fields)), 256)


def chained(rows: DataFrame, chain: str, order: str, *fields: str) -> DataFrame:
    """Rows with sequence, record_hash and previous_hash; one chain per key, the first link is the genesis hash."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    names = rows.columns

    def run(batches):
        key, sequence, head = object(), 0, L.GENESIS
        for batch in batches:
            out = []
            for of, fields in zip(batch.column(names.index(chain)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if of != key:
                    key, sequence, head = of, 0, L.GENESIS
                hashed = sealed(sequence, head, fields)
                out.append((sequence, hashed, head))
                sequence, head = sequence + 1, hashed
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]], [*names, "sequence", "record_hash", "previous_hash"])

    ready = rows.withColumn("_fields", payload(*fields)).repartition(chain).sortWithinPartitions(chain, order)
    return ready.mapInArrow(run, f"{kinds}, sequence long, record_hash string, previous_hash string")


def verified(records: DataFrame, chain: str, order: str, *fields: str) -> DataFrame:
    """Per chain: records, those before the first break, and the break's reason; intact chains give their head hash."""
    w = Window.partitionBy(chain).orderBy(order)
    place = (F.row_number().over(w) - 1).cast("long")
    reason = (
        F.when(F.col("record_hash").isNull(), "unreadable record")
        .when(F.col("sequence") != F.col("_place"), "sequence differs from position")
        .when(F.col("previous_hash") != F.coalesce(F.col("_before"), F.lit(L.GENESIS)), "previous hash differs")
        .when(F.col("record_hash") != record_hash(*fields), "content differs from hash")
    )
    checked = records.withColumns({"_place": place, "_before": F.lag("record_hash").over(w)}).withColumn("_reason", reason)
    broken = F.min(F.when(F.col("_reason").isNotNull(), F.struct("_place", "_reason")))
    out = checked.groupBy(chain).agg(F.count("*").alias("records"), broken.alias("b"), F.max_by("record_hash", "_place").alias("head"))
    return out.select(chain, "records", F.coalesce("b._place", "records").alias("verified"), F.coalesce("b._reason", F.lit("")).alias("reason"), F.when(F.col("b").isNull(), F.col("head")).otherwise("").alias("head_hash"))


def anchors(records: DataFrame, chain: str, order: str, *fields: str) -> DataFrame:
    """What to publish of each chain: records, head_hash ("" if the chain is broken), chain_ok and where it belongs."""
    found = verified(records, chain, order, *fields)
    return found.select(chain, "records", "head_hash", (F.col("reason") == "").alias("chain_ok"), F.lit(ANCHOR_NOTE).alias("note"))


def against_anchors(records: DataFrame, published: DataFrame, chain: str) -> DataFrame:
    """Each published anchor against a later log: matches, rewritten (another hash in its place), truncated (no record there) or
    unusable (anchored when the chain was broken)."""
    at = published.select(chain, F.col("records").alias("anchored"), "head_hash", "chain_ok", (F.col("records") - 1).alias("sequence"))
    found = at.join(records.select(chain, "sequence", "record_hash"), [chain, "sequence"], "left")
    status = F.when(~F.col("chain_ok"), "unusable").when(F.col("record_hash").isNull(), "truncated").when(F.col("record_hash") != F.col("head_hash"), "rewritten").otherwise("matches")
    return found.select(chain, "anchored", status.alias("status"))


def expired(rows: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows older than the days; rows whose time cannot be read are passed over. Reported, never deleted."""
    if days < 1:
        raise ValueError("days must be positive")
    return rows.where(F.col(ts).cast("timestamp") < now - F.expr(f"INTERVAL {days} DAYS"))
