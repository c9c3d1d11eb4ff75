import random

import numpy as np
import pytest
import xxhash

from caselode.llm import simhash
from caselode.llm.simhash import CUTS, REACH, compared, cut_for, grouped, hashes, linked, masks, near_pairs, op12_simhash, references, table


def plain(text):
    """Fingerprint of a text, bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(values, reach=REACH):
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= reach:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(values))]


def check(got, rows):
    assert len(got) == len(rows)
    prints = [plain(t) for _, t in rows]
    roots = components_of(prints)
    least = {}
    for (doc, _), r in zip(rows, roots, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    want = sorted((str(doc), f"{p:016x}", str(least.get(r))) for (doc, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op12_simhash(spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(30):
        base = draw.choices(words, k=draw.randrange(3, 300))
        for _ in range(draw.randrange(1, 7)):
            text = list(base)
            for _ in range(draw.randrange(3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((1000 - len(rows), " ".join(text)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one\ttwo"), (5, "one\ttwo"), (None, "one two"), (None, "alone here"), (6, "ÉCOLE İ one two three"), (7, "very long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("doc_id", "text", "1 AS fp", "2 AS id", "3 AS component_id")
    check(grouped(df).collect(), rows)
    check(grouped(df, full=3).collect(), rows)
    assert grouped(df.where("false")).collect() == []


@pytest.mark.parametrize("full,first", [(2048, 0), (4, 0), (1, 1), (1, len(CUTS) - 1)])
def test_links_of_crowded_fingerprints(spark, full, first):
    draw = np.random.default_rng(full)
    values = {int(x) for x in draw.integers(0, 2**64, 200, dtype=np.uint64)}
    for centre in draw.integers(0, 2**64, 6, dtype=np.uint64):
        for _ in range(60):
            bits = sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 8), replace=False))
            values.add(int(centre) ^ bits)
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long").repartition(3)
    got = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in linked(df, full, first).collect()]
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in got:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    want = components_of(values)
    assert [values.index(root(v)) for v in values] == want


def test_one_large_bucket_goes_on(spark):
    values = list(range(5000))  # all within the lowest 13 bits
    df = spark.createDataFrame([(v, 7) for v in values] + [(99, 8), (2**20, 8)], "fp long, key long").repartition(3)
    got = compared(df, 1000).collect()
    assert sorted(r.a for r in got if r.b is None) == values
    assert [r for r in got if r.b is not None] == []


def test_pairs_by_pivots():
    draw = np.random.default_rng(1)
    fp = np.unique(np.concatenate([draw.integers(0, 2**64, 300, dtype=np.uint64), np.uint64(12345) ^ (np.uint64(1) << draw.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 200, dtype=np.uint64))]))
    bucket = draw.integers(0, 3, len(fp))
    keep, simhash.PAIRS = simhash.PAIRS, 50
    try:
        got = {tuple(sorted((int(i), int(j)))) for x, y in near_pairs(fp, bucket, references()) for i, j in zip(x, y, strict=True)}
    finally:
        simhash.PAIRS = keep
    assert got == {(i, j) for j in range(len(fp)) for i in range(j) if bucket[i] == bucket[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= REACH}
    some = table(fp, references())
    i, j = np.triu_indices(len(fp), 1)
    far = np.abs(some[i].astype(int) - some[j]).max(axis=1) > REACH
    apart = np.bitwise_count(fp[i] ^ fp[j])
    assert far[apart > 16].mean() > 0.99 and (apart[far] > REACH).all()  # the table discards what is far apart, no link


def test_cuts():
    for m in CUTS:
        for mask in masks(m):
            assert 64 - int(mask).bit_count() <= -(-64 * REACH // m) + REACH
    assert max(64 - int(x).bit_count() for x in masks(CUTS[-1])) == 16
    assert cut_for(0) == 0 and cut_for(2**22) == 1 and cut_for(2**60) == len(CUTS) - 1
    assert len(hashes(b"a b c d e")) == 2 and len(hashes(b"a")) == 1 and len(hashes(b" ")) == 0
