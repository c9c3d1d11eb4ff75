import random

import numpy as np

from caselode.llm.substring_dedup import GEAR, LONGEST, REACH, chunks, cuts, gear, op5_substring_dedup, repeats, without_repeats


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(draw.randrange(2, 9))) for _ in range(n))


def test_gear_against_the_rolling_form():
    data = np.frombuffer(random.Random(1).randbytes(400), np.uint8)
    got, table = gear(data), [int(g) for g in GEAR]
    for i in range(len(data)):
        assert int(got[i]) == sum(table[data[i - j]] << j for j in range(min(REACH, i + 1))) % 2**64


def test_cuts_are_whole_bounded_and_resist_shifts():
    draw = random.Random(2)
    for text in (words(draw, 2000), "é" * 5000, "🙂" * 900, "a", "aé"):
        raw = text.encode()
        ends = cuts(np.frombuffer(raw, np.uint8))
        parts = [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert "".join(parts) == text and max(len(p.encode()) for p in parts) <= LONGEST + 3
    text = words(draw, 2000)
    split = lambda t: {t.encode()[a:b] for a, b in (lambda e: zip([0, *e[:-1]], e, strict=True))(cuts(np.frombuffer(t.encode(), np.uint8)))}
    a, b = split(text), split(text[:5000] + "inserted" + text[5000:])
    assert len(a - b) <= 4


def test_planted_passages_are_found_and_clean_texts_left(spark):
    draw = random.Random(5)
    passages = [words(draw, 55) for _ in range(12)]
    rows, holds = [], {}
    for i in range(150):
        text = words(draw, draw.randrange(0, 300))
        if i % 3 == 0:
            p = draw.randrange(12)
            holds.setdefault(p, []).append(i)
            at = draw.randrange(len(text) + 1)
            text = text[:at] + " " + passages[p] + " " + text[at:]
        rows.append((i, text, 1))
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)).collect()
    later = {d for own in holds.values() for d in own[1:]}
    assert {r.doc_id for r in got} == later
    for r in got:
        p = next(p for p, own in holds.items() if r.doc_id in own)
        assert r.first_doc_id in holds[p] and r.first_doc_id < r.doc_id
        assert rows[r.doc_id][1][r.start : r.start + r.length] == rows[r.first_doc_id][1][r.first_start : r.first_start + r.length]
        assert rows[r.doc_id][1][r.start : r.start + r.length] in " " + passages[p] + rows[r.doc_id][1].partition(passages[p])[2]


def test_documents_against_strings(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op5_substring_dedup(spark, sf_dir).collect()
    assert got
    for r in got:
        part = texts[r.doc_id][r.start : r.start + r.length]
        assert part == texts[r.first_doc_id][r.first_start : r.first_start + r.length] and (r.first_doc_id, r.first_start) < (r.doc_id, r.start)
        assert r.n_words >= 15 and len(part) == r.length
    copies = {d for d, t in texts.items() if len(t.split()) > 60 and any(t == u for e, u in texts.items() if e < d)}
    assert copies <= {r.doc_id for r in got}


def test_owners_of_mixed_passages_and_repeats_within_a_document(spark):
    draw = random.Random(11)
    a, b, c, own = (words(draw, n) for n in (40, 40, 40, 50))
    gap = lambda: words(draw, 30)
    rows = [(1, a), (2, f"{gap()} {b} {a} {c}"), (3, f"{gap()} {b} {a} {c} {gap()}"), (4, f"{own} {gap()} {own} {gap()} {own}"), (5, f"{b} {gap()} {a}")]
    texts = dict(rows)
    got = repeats(spark.createDataFrame(rows + rows[:2], "doc_id long, text string")).collect()
    for r in got:
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.first_doc_id][r.first_start : r.first_start + r.length]
    of = lambda d: sorted((r.first_doc_id, r.n_words) for r in got if r.doc_id == d)
    assert [d for d, _ in of(1)] == [] and [d for d, _ in of(2)] == [1]
    assert [d for d, _ in of(3)] == [2] and of(3)[0][1] > 95
    assert [d for d, _ in of(4)] == [4, 4] and [d for d, _ in of(5)] == [1, 2]


def test_different_texts_of_one_id(spark):
    draw = random.Random(12)
    p, q = words(draw, 60), words(draw, 60)
    rows = [(1, p), (2, "x " + p), (2, q + " " + p), (2, q + " " + p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (r,) = repeats(df).collect()
    searched = [t for d, t in rows if d == 2 and t[r.start : r.start + r.length] == p[r.first_start : r.first_start + r.length]]
    assert searched and r.first_doc_id == 1
    left = [x.text for x in without_repeats(df).where("doc_id = 2").collect()]
    assert len(left) == 3 and sum(t in left for _, t in rows[1:]) in (1, 2)


def test_without_repeats_null_repeated_and_no_rows(spark):
    draw = random.Random(8)
    p, q, r = words(draw, 60), words(draw, 40), words(draw, 40)
    rows = [(1, p, "k"), (2, q + " " + p + " " + r, None), (None, p, "k"), (3, None, "k"), (4, "", "k"), (2, q + " " + p + " " + r, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_runs string")
    got = without_repeats(df)
    assert got.columns == df.columns
    texts = sorted((str(x.doc_id), x.text) for x in got.collect() if x.text)
    assert texts[0] == ("1", p) and texts[-1] == ("None", p) and texts[1] == texts[2]
    assert texts[1][1].startswith(q) and texts[1][1].endswith(r) and len(texts[1][1]) < len(q) + len(r) + 150
    assert repeats(df.limit(0)).count() == 0 and without_repeats(df.limit(0)).count() == 0 and chunks(df.limit(0)).count() == 0
