import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from caselode.llm.ranked_search import Best, accumulated, op11_ranked_search, ranked, shared


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, top=50):
    """Scores of all pairs, one after the other."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_registered_query(spark, sf_dir):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]
    found = op11_ranked_search(spark, sf_dir)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == plain(read("documents", "doc_id"), read("benchmark", "item_id"))


@pytest.mark.parametrize("block_terms,cells,top", [(200_000, 4_000_000, 50), (40, 300, 3), (1, 1, 1)])
def test_odd_rows(spark, block_terms, cells, top):
    draw = random.Random(block_terms)
    words = ["the", "of", "Élan", "a1", "1", "x", *[f"w{i}" for i in range(60)]]
    text = lambda k: draw.choice([" ", ", ", "-", "_"]).join(draw.choices(words, weights=[40, 30, 9, 5, 5, 5] + [1] * 60, k=k))
    docs = [(i, text(draw.randrange(0, 60))) for i in range(120)]
    docs += [(200, docs[7][1]), (201, docs[7][1]), (201, docs[7][1]), (202, None), (203, ""), (204, "... --"), (None, "the w1 w2"), (205, "THE the İ the " * 30_000)]
    items = [(i, text(draw.randrange(1, 25))) for i in range(25)] + [(3, "the w5 w5"), (None, "x of"), (90, None), (91, "nowhere"), (92, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS score", "3 AS term").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS block", "2 AS n").repartition(2)
    assert got(ranked(d, i, top=top, block_terms=block_terms, cells=cells)) == plain(docs, items, top)
    assert got(ranked(d.where("false"), i)) == got(ranked(d, i.where("false"))) == []


def test_sharing_graph():
    draw = random.Random(2)
    sets = {k: draw.sample([f"t{i}" for i in range(40)], draw.randrange(1, 25)) for k in range(30)}
    g = shared(sets)

    def under(node):
        base = len(g.terms)
        return [g.terms[node].decode()] if node < base else under(g.left[node - base]) + under(g.right[node - base])

    ends = [*g.starts[1:], len(g.parts)]
    for item, a, b in zip(g.items, g.starts, ends, strict=True):
        assert sorted(t for p in g.parts[a:b] for t in under(p)) == sorted(sets[item])
    assert len(g.left) > 0 and len(g.parts) + len(g.left) < sum(map(len, sets.values()))  # fewer sums than without sharing
    assert shared({1: ["b", "a"], 2: ["a", "b"]}).parts.tolist() == [2, 2]


def test_accumulators_and_best():
    g = shared({"x": ["a", "b", "c"], "y": ["a", "b"], "z": ["c"]})
    place = {t.decode(): i for i, t in enumerate(g.terms)}
    term = np.array([place["a"], place["b"], place["c"], place["a"]])
    scores = accumulated(g, term, np.array([0, 0, 0, 2]), np.array([1, 10, 100, 2**60]), 3)
    assert scores.tolist() == [[111, 0, 2**60], [11, 0, 2**60], [100, 0, 0]]
    best = Best(1, 2)
    for at in ([9, 8], [7, 6], [5, 10]):
        best.add(np.array([[5, 5]]), np.array(at))
    best.add(np.array([[6, 0]]), np.array([50, 1]))
    best.settle()
    assert list(zip(best.score.tolist(), best.id.tolist(), strict=True)) == [(6, 50), (5, 5)]
