import json

import pytest
from pyspark.sql import functions as F

from caselode.operators import integrity
from caselode.streaming.metrics_stream import log_stream, sealed_stream

ROWS = [(c, i, f"v|{i}" if i % 3 else None, i % 5) for c in ("a", "b", "hot") for i in range(40 if c == "hot" else 7)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(ROWS, "chain string, seq long, v string, w int").repartition(4)


def test_anchors_show_a_rewritten_log(spark, log):
    seal = lambda d: integrity.chained(d, "chain", "seq", "v", "w")
    published = integrity.anchors(seal(log.where("seq < 20")), "chain", "seq", "v", "w").cache()
    assert {(r.chain, r.records, r.chain_ok) for r in published.collect()} == {("a", 7, True), ("b", 7, True), ("hot", 20, True)} and "separately controlled" in published.head().note
    later = {r.chain: r.status for r in integrity.against_anchors(seal(log), published, "chain").collect()}
    assert later == {"a": "matches", "b": "matches", "hot": "matches"}
    forged = seal(log.withColumn("w", F.when((F.col("chain") == "hot") & (F.col("seq") == 3), 99).otherwise(F.col("w"))).where("chain <> 'b' or seq < 3"))
    assert {r.reason for r in integrity.verified(forged, "chain", "seq", "v", "w").collect()} == {""}  # it verifies
    assert {r.chain: r.status for r in integrity.against_anchors(forged, published, "chain").collect()} == {"a": "matches", "b": "truncated", "hot": "rewritten"}
    broken = integrity.anchors(seal(log).withColumn("w", F.lit(0)), "chain", "seq", "v", "w")
    assert {r.status for r in integrity.against_anchors(seal(log), broken, "chain").collect()} == {"unusable"}


def test_records_with_bars_do_not_collide(spark):
    df = spark.createDataFrame([("x|y", "z"), ("x", "y|z"), (None, "z"), ("", "z"), ("-", "z")], "a string, b string")
    assert df.select(integrity.payload("a", "b")).distinct().count() == 5


def test_a_stream_appends_to_its_chains_over_batches_and_a_restart(spark, log, tmp_path):
    source, want = tmp_path / "in", {(r.chain, r.seq): (r.sequence, r.record_hash, r.previous_hash) for r in integrity.chained(log, "chain", "seq", "v", "w").collect()}
    source.mkdir()

    def add(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("chain", "seq", "v", "w"), r, strict=True))) for r in rows))

    def run():
        stream = sealed_stream(log_stream(spark, str(source), "chain string, seq long, v string, w int"), "chain", "seq", "v", "w")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)

    add("1.json", [r for r in ROWS if r[1] < 5])
    run()
    add("2.json", [r for r in ROWS if 5 <= r[1] < 20])
    run()  # a new query from the old one's checkpoint
    add("3.json", [r for r in ROWS if r[1] >= 20])
    run()
    got = {(r.chain, r.order): (r.sequence, r.record_hash, r.previous_hash) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
