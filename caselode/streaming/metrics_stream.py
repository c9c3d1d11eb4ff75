"""Streaming panels over the metrics log: event-time windows with late rows kept aside, and bounded histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caselode.functions.lexicons import GENESIS
from caselode.operators import integrity

LOG = "seq long, session string, intent string, value double, ts timestamp"


def log_stream(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """New JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).json(path)


def windowed(stream: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Rows, total and highest value by window and intent; a window is final once the watermark passes it."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "intent")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"), F.max("value").alias("high"))
        .select("window.start", "intent", "n", "total", "high")
    )


def sessions(stream: DataFrame, watermark: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity gap."""
    return stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("n")).select("session", "w.start", "w.end", "n")


def bounded_history(stream: DataFrame, keep: int = 40) -> DataFrame:
    """After each batch, each session's last rows by seq: state holds no more than that."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held = sorted([*held, *f["seq"].tolist()])[-keep:]
        state.update((held,))
        yield pd.DataFrame({"session": [key[0]], "kept": [len(held)], "first_seq": [held[0]], "last_seq": [held[-1]]})

    return stream.groupBy("session").applyInPandasWithState(step, "session string, kept long, first_seq long, last_seq long", "seqs array<long>", "update", GroupStateTimeout.NoTimeout)


def sealed_stream(stream: DataFrame, chain: str, order: str, *fields: str) -> DataFrame:
    """Appends a stream's rows to hash chains, as ``integrity.chained`` does for a table: the state of a chain is its next sequence and
    its head hash, so a restarted query goes on where it stopped. Within a batch rows go by ``order``; later batches follow."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, head = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(frames)).sort_values("order", kind="stable")
        out = []
        for place, row_fields in zip(rows["order"].tolist(), rows["fields"].tolist(), strict=True):
            hashed = integrity.sealed(sequence, head, row_fields)
            out.append((key[0], place, sequence, hashed, head))
            sequence, head = sequence + 1, hashed
        state.update((sequence, head))
        yield pd.DataFrame(out, columns=["chain", "order", "sequence", "record_hash", "previous_hash"])

    ready = stream.select(F.col(chain).alias("chain"), F.col(order).alias("order"), integrity.payload(*fields).alias("fields"))
    kinds = dict(ready.dtypes)
    out = f"chain {kinds['chain']}, order {kinds['order']}, sequence long, record_hash string, previous_hash string"
    return ready.groupBy("chain").applyInPandasWithState(step, out, "sequence long, head string", "append", GroupStateTimeout.NoTimeout)
