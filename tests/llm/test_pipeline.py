import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from caselode.llm.common import documents  # noqa: E402
from pipeline_brute import brute_toxic, classes_of, pieces_of  # noqa: E402
from test_pii import brute as spans_of  # noqa: E402


def test_stages_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, read = docs.columns, docs
    kept = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, sf_dir).cache()
        assert out.columns == columns
        rows = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(rows) and set(rows) <= set(kept)
        if name == "toxicity":
            assert brute_toxic(kept, set(kept) - set(rows))
        elif name == "exact dedup":
            assert set(rows) == {max(d for d in kept if kept[d].text == t) for t in {r.text for r in kept.values()}}
        elif name == "near dedup":
            groups = classes_of(kept)
            assert all(len(g & set(rows)) == 1 for g in groups)
        elif name == "pii":
            assert set(rows) == set(kept)
            assert all(not spans_of(r.text) and r.n_chars == len(r.text) for r in rows.values())
            assert all(rows[d].text == kept[d].text for d in rows if not spans_of(kept[d].text))
        kept, read = rows, out
    pieces = corpus_pipeline.STAGES[-1][1](spark, read, sf_dir).collect()
    assert pieces_of(pieces) == set(kept)


def test_run_gives_what_the_stages_give(spark, sf_dir):
    read = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES:
        read = stage(spark, read, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32"]
    whole = lambda df: df.groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, whole(corpus_pipeline.run(spark, sf_dir)))) == sorted(map(tuple, whole(read)))
    assert set(key) <= set(read.columns)


def test_odd_rows_go_through_all_stages(spark, sf_dir):
    odd = [(900_001, None), (900_002, ""), (900_003, "same text here"), (900_003, "same text here"), (900_004, "same text here"), (None, "no id at all"), (900_005, "long words go on " * 20_000), (900_006, "write to kim@example.org now")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = documents(spark, sf_dir).limit(60).unionByName(docs).selectExpr("*", "doc_id AS sha", "1 AS hot_id", "'x' AS class_id", "2 AS spans")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, sf_dir).cache(), stage(spark, empty, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "sha", "hot_id", "class_id", "spans"] and empty.isEmpty(), name
    left = {r.doc_id: r.text for r in docs.where("doc_id > 900000 or doc_id is null").collect()}
    assert left.keys() == {900_002, 900_004, None, 900_005, 900_006} and left[900_006] == "write to [EMAIL] now" and left[900_005] == "long words go on " * 20_000
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("doc_id = 900002").head().length == 1 and corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).isEmpty()
