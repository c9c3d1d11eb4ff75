import hashlib
import json

import pytest
from pyspark.sql import functions as F

from caselode.functions import exports as X
from caselode.operators import compare, golden, guard
from caselode.plans.exports import compared_indexes
from caselode.sources import index_tables, jsonl


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).head()[0]


def test_texts(spark):
    texts = {"[a [b] c": " c", "x [s.1] y [s.2(1)]": "x  y ", "open [never": "open never", "] stray [ok]": "] stray ", "two\n[l\nm] lines": "two\n lines", "": ""}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.uncited(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == texts
    for reply, want in {'ok {"a": {"b": 1}} fine': '{"a": {"b": 1}}', "none": None, "} {": None, "a {x} b }": "{x} b }"}.items():
        assert one(spark, X.json_in(F.col("t")), t=reply) == want
    for text, fine in {'{"a": 1}': True, '{"a": 1} x': False, '{"a": 1}, {"b": 2}': False, "[1, 2]": True, "null": True, "": False, "{": False}.items():
        assert one(spark, X.is_json(F.col("t")), t=text) is fine, text
    assert one(spark, X.epoch(F.col("t")), t="2024-01-01T00:00:01.5Z") == 1704067201.5 and one(spark, X.epoch(F.col("t")), t="soon") == 0
    assert one(spark, X.refusal(F.lit(0.123), 0.45, F.lit(2)), t="").startswith("I cannot answer this from the indexed document. Retrieval sufficiency scored 0.12 against a threshold of 0.45, after 2 refinement")


def test_attributes_and_metadata(spark):
    df = spark.createDataFrame([(["b", 'q"x', None, "a"], {"k": "v", "a": None}, "s" * 5000, None)], "l array<string>, m map<string,string>, s string, n int")
    columns, kinds = {c: F.col(c) for c in df.columns}, dict(df.dtypes)
    flat = df.select(X.flat(columns, kinds)).head()[0]
    assert flat == {"l": json.dumps(sorted(["b", 'q"x', "a"])), "m": json.dumps({"a": None, "k": "v"}), "s": "s" * 5000}
    row = df.select(*[X.attribute(F.col(c), t).alias(c) for c, t in df.dtypes]).head()
    assert len(row.s) == 4096 and row.l == ["b", 'q"x', None, "a"] and row.m == '{"a": null, "k": "v"}' and row.n is None
    assert one(spark, X.merged_ms(F.create_map(F.lit("a"), F.lit(1.0004)), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(0.5))), t="") == {"a": 3.0, "b": 0.5}


def test_strict_logs_refuse_what_follows_a_value(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1}\n{"a": 2} junk\n\n')
    good, skipped = jsonl.read_tolerant(spark, str(tmp_path), "a int")
    assert [r.a for r in good.collect()] == [1] and skipped.head().skipped == 1
    with pytest.raises(Exception, match="unreadable line in .*log.json"):
        jsonl.read_strict(spark, str(tmp_path), "a int").collect()


def test_baselines_carry_thresholds_over(spark, tmp_path):
    rows = spark.createDataFrame([("d", "g002", True), ("d", "g001", True), ("", "k001", True), ("d", "g003", False)], "doc_id string, id string, known_failure boolean")
    path = f"{tmp_path}/base"
    first = golden.write_baseline(rows, path, {"corpus_sha": "abc", "index_version": "v1"})
    assert first["known_failures"] == ["d/g001", "d/g002", "k001"] and first["generated_for"] == {"corpus_sha": "abc", "index_version": "v1"}
    again = golden.write_baseline(rows.where("id = 'g001'"), path, {"corpus_sha": "abc", "index_version": "v2"})
    assert again["known_failures"] == ["d/g001"] and again["quality_thresholds"] == first["quality_thresholds"] and again["sequence"] == 2
    assert {(r.id, r.drift) for r in golden.drift(rows, rows.where("id <> 'g003'").unionByName(rows.where("id = 'k001'"))).collect()} == {("g003", "stale"), ("k001", "missing")}


def test_lock_file_and_status(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/m.bin").write_bytes(b"one")
    entries = index_tables.lock_entries(spark, str(tmp_path), "me")
    row = entries.head()
    assert (row["name"], row.pinned, row.pinned_by) == ("m.bin", hashlib.sha256(b"one").hexdigest(), "me")
    kept = spark.createDataFrame([tuple(row)], entries.schema)
    (tmp_path / "a/m.bin").write_bytes(b"two")
    now = index_tables.lock_entries(spark, str(tmp_path), "me").select("name", F.col("pinned").alias("sha"))
    assert guard.lock_status(kept, now).head().status == "moved"


def test_two_indexes_side_by_side(spark, sf_dir):
    rows = compared_indexes(spark, sf_dir).collect()
    by = {p: [r for r in rows if r.pipeline == p] for p in ("simple", "hierarchical")}
    assert len(by["simple"]) == len(by["hierarchical"]) > 0
    assert all(r.citable == 0 and r.hits == 3 for r in by["simple"]) and all(0 < r.citable == r.hits <= 3 for r in by["hierarchical"])
    df = spark.range(35).select(F.lit("d").alias("doc_id"), F.col("id").alias("ordinal"))
    assert [r.ordinal for r in compare.page(df, 10, 30).collect()] == [30, 31, 32, 33, 34]
    with pytest.raises(ValueError):
        compare.page(df, 0, 0)
