import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark import SparkContext
from pyspark.sql import SparkSession
from pyspark.sql.classic.dataframe import DataFrame

from caselode.llm import collocations as module
from caselode.llm.collocations import LONGEST, PARTS, Trie, collocations, op13_collocations, walked


def plain(rows, least=30, top=2000):
    """The same by dictionaries of phrases."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in phrases.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], c)
        scored = []
        for p, a in phrases.items():
            if 100 * inside[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_registered_query(spark, sf_dir):
    found = op13_collocations(spark, sf_dir)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(found) == plain(rows) != []


@pytest.mark.parametrize("bound", [2**21, 60, 1])
def test_odd_rows(spark, bound):
    draw = random.Random(7)
    words = ["the", "THE", "of", "Élan", "a-b", " ", *[f"w{i}" for i in range(40)]]
    rows = []
    for _ in range(200):
        text = draw.choice(["", "\t", "x "]).join(w + draw.choice([" ", "  ", "\t", ", ", "\n", "\r\n"]) for w in draw.choices(words, weights=[60, 20, 40, 20, 10, 5] + [2] * 40, k=draw.randrange(60)))
        rows.append((draw.choice(["en", "fr", None, "und"]), text))
    rows += [("en", None), ("en", ""), ("xx", "..."), ("en", "of the of the " * 20_000), ("de", "one two three four five. " * 40)] + [("en", "same row here again")] * 30
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS key", "2 AS f", "3 AS phrase").repartition(5)
    assert got(collocations(df, bound=bound)) == plain(rows)
    assert got(collocations(df, bound=bound, least=9, top=7)) == plain(rows, 9, 7)
    assert got(collocations(df.where("false"), bound=bound)) == []


def test_trie():
    draw = np.random.default_rng(5)
    two = np.unique(np.concatenate([np.column_stack([draw.integers(1, 50, 800), draw.integers(1, 2**20, 800)]), np.column_stack([np.full(300, 7), np.arange(1, 301)])]), axis=0)
    three = np.column_stack([two[::3], draw.integers(1, 100, len(two[::3]))])
    trie = Trie([two, three])
    base, check = trie.arrays()
    assert len(np.unique(np.concatenate(trie.of))) == len(two) + len(three)
    state = {tuple(p): s for m, of in zip((two, three), trie.of, strict=True) for p, s in zip(m.tolist(), of.tolist(), strict=True)}
    ids = np.concatenate([np.concatenate([r, [0]]) for r in three] + [draw.integers(0, 60, 5000)]).astype(np.int32)
    for level, (at, states) in enumerate(walked(base, check, ids, LONGEST)):
        want = {i: state[t] for i in range(len(ids) - level) if (t := tuple(ids[i : i + level + 1].tolist())) in state}
        if level:
            assert dict(zip(at.tolist(), states.tolist(), strict=True)) == want
    assert level == LONGEST - 1


def many_words(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["en", "fr"]), " ".join(f"w{int(draw.paretovariate(0.6)) % 400}" for _ in range(60))) for _ in range(150)]
    return rows, spark.createDataFrame(rows, "lang string, text string").repartition(5)


def test_driver_sees_no_words_and_no_tries(spark, monkeypatch):
    rows, df = many_words(spark)
    want = plain(rows, 5)
    assert len(want) > 4 * PARTS

    def refused(*args, **kwargs):
        raise AssertionError("passes through the driver what grows with the texts")

    collect, sizes = DataFrame.collect, []
    with monkeypatch.context() as m:
        for owner, name in ((DataFrame, "toArrow"), (DataFrame, "toPandas"), (DataFrame, "toLocalIterator"), (SparkSession, "createDataFrame"), (SparkContext, "broadcast"), (Trie, "__init__")):
            m.setattr(owner, name, refused)
        m.setattr(DataFrame, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
        found = collocations(df, least=5)
    assert got(found) == want
    assert sizes and max(sizes) <= PARTS


def test_shared_folder_that_is_not_mounted(spark, monkeypatch):
    rows, df = many_words(spark)
    asked = []
    monkeypatch.setattr(module, "scratch", lambda spark, name: asked.append(name) or f"hdfs://name/{name}")
    assert got(collocations(df, least=5)) == plain(rows, 5)
    assert asked


def test_more_phrases_than_the_bound_of_words(spark, monkeypatch):
    draw, counted, sizes = random.Random(4), module.plain_counts, []
    rows = [("en", " ".join(f"w{draw.randrange(12)}" for _ in range(80))) for _ in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = plain(rows, 5)
    assert len(want) > 144
    monkeypatch.setattr(module, "plain_counts", lambda texts, some: sizes.append(some) or counted(texts, some))
    monkeypatch.setattr(module, "FLUSH", 500)
    assert got(collocations(df, least=5, bound=20)) == want
    assert sizes == [(1,)]  # phrases by tries, not by shuffles
