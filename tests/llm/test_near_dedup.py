import random
from collections import Counter

import numpy as np
import pytest

from caselode.llm import near_dedup
from caselode.llm.near_dedup import classes, components, dart_signatures, forest, planes, may_reach, without_near_copies


def brute_set(text):
    """Runs of words with their counts."""
    words = (text or "").lower().split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute_classes(rows):
    """Smallest-label components of all pairs at 0.8 or above, or equal."""
    sets, label = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or sets[i] and sets[i].keys() & sets[j].keys() and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for (doc, _), x in zip(rows, label, strict=True):
        groups.setdefault(x, set()).add(doc)
    return {frozenset(g) for g in groups.values()}


def got_classes(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    for r in rows:
        assert r.kept == (r.doc_id == r.class_id) and r.class_id in groups[r.class_id]
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("weighted", [False, True])
def test_signature_agreement_is_the_weighted_jaccard(weighted):
    draw = np.random.default_rng(4)
    keys = draw.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (draw.choice([0.3, 1, 2.5, 7], 300) if weighted else np.ones(300) for _ in "ab")
    a[:60], b[-40:] = 0, 0
    size = 4000
    s, t = drawn = dart_signatures([(keys[w > 0], w[w > 0]) for w in (a, b)], size)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s == t).mean() - want) < 0.035
    x, y = (p.view(np.uint64) for p in planes(drawn))
    half = len(x) // 2
    differ = sum(int(u).bit_count() for u in (x[:half] ^ y[:half]) | (x[half:] ^ y[half:]))
    assert abs(differ / size - 0.75 * (1 - want)) < 0.035 and differ <= may_reach(size, want)
    assert np.array_equal(dart_signatures([(keys[b > 0], b[b > 0])], size)[0], t)


def test_classes_against_all_pairs(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(25):
        base = draw.choices(words, k=draw.randrange(30, 160))
        for _ in range(draw.randrange(1, 9)):
            text = list(base)
            for _ in range(draw.randrange(0, 4)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b", "A b", "a c", "", None, "  \n", "one two three four five", "long words here " * 20_000])]
    got = classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and got_classes(got) == brute_classes(rows)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got_classes(classes(df).collect()) == brute_classes(rows)
    assert without_near_copies(df).count() == len(brute_classes(rows))


def test_hot_group_and_chain(spark):
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 120] + [f"x{i}"] + base[i % 120 + 1 :])) for i in range(400)]
    assert {frozenset(g) for g in got_classes(classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())} == {frozenset(range(400))}


def test_counts_as_weights(spark):
    rows = [(1, "a b c d e " * 30), (2, "a b c d e " * 29), (3, "a b c d e " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in classes(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.class_id for r in classes(df, weights="set").collect()} == {1}


def test_hot_bucket_whose_leader_is_far_from_its_members(spark, monkeypatch):
    """A passage that all share, alone in the leaders: two groups and many loners in the same buckets, in blocks of a few."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    common, draw = [f"c{i}" for i in range(40)], random.Random(5)
    own = lambda n, k: [f"o{n}_{i}" for i in range(k)]
    texts = [" ".join(common + own(i, 30)) for i in range(12)]
    for group in (100, 200):
        base = common + own(group, 60)
        for _ in range(8):
            text = list(base)
            text[draw.randrange(40, 100)] = f"x{draw.random()}"
            texts.append(" ".join(text))
    rows = list(enumerate(texts))
    got = got_classes(classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=40, rows=2).collect())
    assert got == brute_classes(rows) and {len(g) for g in got} == {1, 8}


def test_recall_by_similarity(spark):
    """Pairs at each band of similarity from 0.8: at least 0.99 of them are found."""
    draw, rows, want = random.Random(8), [], {}
    for i in range(300):
        words = [f"p{i}_{j}" for j in range(120)]
        other = list(words)
        for at in range(draw.randrange(1, 13)):  # neighbouring words cost one run each
            other[at] = f"q{i}_{at}"
        a, b = brute_set(" ".join(words)), brute_set(" ".join(other))
        s = (a & b).total() / (a | b).total()
        if s >= 0.8:
            want[i] = s
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        pairs = [i for i, s in want.items() if lo <= s < hi]
        assert len(pairs) > 20 and sum(found[2 * i + 1] == 2 * i for i in pairs) >= 0.99 * len(pairs)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "else")]
    assert got_classes(classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == {frozenset({1, 2, 3}), frozenset({4})}


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)], "a long, b long")
    assert {r.id: r.label for r in forest(chain).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 3)]
    got = {r.id: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_null_repeated_clashing_and_no_rows(spark):
    rows = [(None, "a b c", "k", 1), (None, None, "k", 1), (1, "a b c", None, 2), (1, "a b c", None, 2), (2, "q", "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, gone_id int")
    assert sorted(map(tuple, classes(df).collect()), key=str) == sorted([(1, 1, True, 1)] * 2 + [(2, 2, True, 2)] + [(None, None, True, None)] * 2, key=str)
    assert without_near_copies(df).columns == df.columns and without_near_copies(df).count() == 5
    assert classes(df.limit(0)).count() == 0 and without_near_copies(df.limit(0)).count() == 0
