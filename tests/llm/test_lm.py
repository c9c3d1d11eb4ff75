import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from caselode.llm import lm
from caselode.llm.lm import discounts, op1_lm_scoring, scored, token_hashes, train


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


class Brute:
    def __init__(self, texts, order):
        self.order, self.vocabulary = order, {t for x in texts for t in tokens(x)}
        counts = Counter()
        for x in texts:
            own = ["<s>"] * (order - 1) + tokens(x)
            counts.update(tuple(own[i : i + order]) for i in range(len(own) - order + 1))
        self.levels = {order: counts}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.d, self.after = {}, {}
        for k, own in self.levels.items():
            of = Counter(own.values())
            self.d[k] = discounts(of[1], of[2], of[3], of[4])
            self.after[k] = defaultdict(list)
            for g, c in own.items():
                self.after[k][g[:-1]].append(c)

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.vocabulary) + 1)
        seen = self.after[k].get(gram[:-1])
        if not seen:
            return lower
        d, c = self.d[k], self.levels[k][gram]
        return max(c - d[min(c, 3)], 0) / sum(seen) + sum(d[min(x, 3)] for x in seen) / sum(seen) * lower

    def score(self, text):
        own = ["<s>"] * (self.order - 1) + tokens(text)
        own = [t if t in self.vocabulary or t == "<s>" else "<unk>" for t in own]
        return sum(math.log10(self.p(tuple(own[i : i + self.order]))) for i in range(len(own) - self.order + 1))


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("shard", [40, 10**6])
def test_scores_against_brute_force(spark, order, shard):
    draw = random.Random(order)
    texts = [" ".join(draw.choice("the the the a of Cat dog é x\x1cy runs".split(" ")) for _ in range(draw.randrange(0, 30))) for _ in range(60)]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order, shard)
    brute = Brute(texts, order)
    assert model.vocabulary.total == sum(len(tokens(t)) for t in texts) and model.vocabulary.size == len(brute.vocabulary)
    new = texts[:20] + ["the unseen cat", "", "of of of", "new words only"]
    rows = scored(spark.createDataFrame(list(enumerate(new)), "k long, text string"), model).collect()
    for r in rows:
        assert r.n_tokens == len(tokens(new[r.k])) and r.score == pytest.approx(brute.score(new[r.k]), rel=1e-9)
        assert r.n_known == sum(t in brute.vocabulary for t in tokens(new[r.k]))
    context = ("the",) * (order - 1)
    assert sum(brute.p((*context, t)) for t in [*brute.vocabulary, "<unk>"]) == pytest.approx(1)


def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(t for d, x in texts.items() if not held[d] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    rows = op1_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel=1e-9)
    assert np.mean([r.score - r.base_score > 0 for r in rows if not r.held_out]) > 0.9


def test_null_long_and_no_rows(spark, tmp_path):
    rows = [(None, None, "x", "k"), (1, "", None, "k"), (1, "", None, "k"), (2, "long Words " * 40_000, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, score string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op1_lm_scoring(spark, str(tmp_path)).collect(), key=str)
    assert [r.n_tokens for r in got] == [1, 1, 80_001, 1] and all(math.isfinite(r.score) for r in got)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op1_lm_scoring(spark, f"{tmp_path}/none").count() == 0
    none = train(spark.createDataFrame([], "text string"))
    assert scored(spark.createDataFrame([(1, "a b")], "k long, text string"), none).head().score == 0


@pytest.mark.parametrize("block", [1, 8, 1 << 16])
def test_equal_words_and_no_others_have_equal_hashes(monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block, raising=False)
    draw = random.Random(block)
    long = ["x" * n for n in (63, 64, 65, 66, 5000)] + ["y" * 64 + end for end in ("", "a", "b", "ab", "ba")]
    words = ["a", "A", "aa", "ab", "ba", "é", "É", "中🙂", "\x00", "a\x00", "\x00a", "\x1c", "\x85", "\xa0", "\u2028", "ÿ", "end", *long]
    texts = ["", " ", "\n\x0b\x0c\r\t ", "a", " a ", *["".join(draw.choice(words) + draw.choice(" \t\n\x0b\x0c\r") * draw.randrange(1, 3) for _ in range(draw.randrange(60))) for _ in range(80)], ""]
    found, at = {}, 0
    hashes, lengths = token_hashes(texts)
    assert lengths.tolist() == [len(tokens(t)) for t in texts]
    for text, n in zip(texts, lengths.tolist(), strict=True):
        for word, x in zip(tokens(text), hashes[at : at + n].tolist(), strict=True):
            assert found.setdefault(word, x) == x
        at += n
    assert at == len(hashes) and len(set(found.values())) == len(found)
    assert [len(x) for x in token_hashes([])] == [0, 0]


def test_hashing_keeps_no_words():
    import tracemalloc

    token_hashes(["warm up"])
    tracemalloc.start()
    token_hashes([" ".join(f"w{i}" for i in range(50_000))])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 200_000
