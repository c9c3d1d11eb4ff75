import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from caselode.llm.exact_dedup import deduplicate, mark


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, sha string, group_size int")


ROWS = [(1, "a", "x", 1), (2, "a", "y", 2), (None, "a", "z", 3), (3, None, "x", 4), (4, "", None, 5), (5, "A", "x", 6), (5, "A", "x", 6), (6, "long " * 30_000, "x", 7)]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for doc, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_mark_edges(spark):
    assert sorted(map(tuple, mark(frame(spark, ROWS)).collect()), key=str) == brute(ROWS)


def test_mark_with_hot_and_ordinary_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", "s", 0) for i in range(6000)]
    assert sorted(map(tuple, mark(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_deduplicate_keeps_one_whole_row_of_each_text(spark):
    rows = ROWS + [(i, "hot", "s", i) for i in range(100, 3000)] + [(2999, "hot", "s", 2999)]
    got = deduplicate(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "sha", "group_size"]
    assert sorted((r.doc_id, r.text[:5], r.group_size) for r in got.withColumn("text", F.coalesce("text", F.lit(""))).collect()) == [(2, "a", 2), (4, "", 5), (5, "A", 6), (6, "long ", 7), (2999, "hot", 2999)]


def test_empty_table(spark):
    assert mark(frame(spark, [])).count() == 0
    assert deduplicate(frame(spark, [])).count() == 0


def test_deduplicate_with_clashing_columns(spark):
    names = ["hot_sha", "hot_id", "_hot_sha", "_hot_id", "row", "place", "keep_id", "n"]
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}", *[f"{c}{i}" for c in names]) for i in range(3000)], ["doc_id", "text", *names])
    got = deduplicate(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in df.where("text <> 'hot' or doc_id = 2999").collect())
