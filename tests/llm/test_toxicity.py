from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from caselode.llm.common import documents
from caselode.llm.toxicity import DECAY, REACH, by_length, features, letters, nystroem_svm, gapped, op6_toxicity, predict, tokens, train, without_toxic


def brute(word):
    found = Counter()
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < REACH:
            found[word[i] + word[j] + word[k]] += DECAY ** (k - i + 1)
    norm = np.sqrt(sum(v * v for v in found.values()))
    return {k: v / norm for k, v in found.items()}


@pytest.mark.parametrize("word", ["idiot", "aaa", "banana", "x" * 200, "éàü🙂abc", "worthlessness"])
def test_features_against_brute_force(word):
    ((n, at, codes),) = by_length([word])
    row, keys, weights = features(codes, n)
    spelt = lambda k: "".join(chr((int(k) >> s) & 0x1FFFFF) for s in (42, 21, 0))
    assert {spelt(k): pytest.approx(w) for k, w in zip(keys, weights, strict=True)} == brute(word)


def test_margins_of_gapped_insults():
    bad = [(w, 5.0) for w in ("idiot", "moron", "worthless")]
    good = [(w, 3.0) for w in ("the", "thing", "order", "another", "worth", "mother", "edition", "pilot", "more")]
    model = nystroem_svm(bad, good)
    margin = lambda t: model.text_margins([t])[0]
    worst_good = max(margin(w) for w, _ in good)
    for t in ("you IDIOT!", "an i.d.i.o.t", "i d i o t", "idxiot", "m*o*r*o*n", "worth#less"):
        assert margin(t) > worst_good, t
    assert margin("") == margin("...") == model.bias


def test_tokens_and_letters():
    assert tokens("a b c d then e f") == ["a", "b", "c", "d", "then", "e", "f", "abcd"]
    assert letters("I.d-1#iOt") == "idiot"


def test_held_out_accuracy(spark, sf_dir):
    path = "/root/testdata/sf0.1"
    rows = op6_toxicity(spark, path).join(documents(spark, path, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_inserted_letters_with_the_query_model(spark):
    path = "/root/testdata/sf0.1"
    model = train(documents(spark, path), documents(spark, path, "labels"))
    toxic = lambda texts: model.score(model.text_margins(texts)) >= 0.5
    assert toxic(["you idiot", "you idxiot", "you are a stuupid person", "i.d.i.o.t", "what a cl.own", "an id iot", "s c u m"])[[0, 1, 2, 3, 4, 6]].all()
    once = [w[:i] + c + w[i:] for w in ("idiot", "stupid", "clown") for i in range(1, len(w)) for c in "xqe"]
    assert toxic(once).mean() >= 0.9
    plain = ["pilot", "a good idea", "the study of ideology", "audit", "studio", "town crowd", "cupid"]
    assert not toxic(plain).any()


def test_gapped_forms():
    forms = gapped("idiot")
    assert len(forms) == 5 and forms == gapped("idiot") and len(forms[-1]) == 9 and forms[-1][::2] == "idiot"
    assert all(len(f) == 6 and any(f[:i] + f[i + 1 :] == "idiot" for i in range(6)) for f in forms[:-1])


def test_edges(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number {i}", "l") for i in range(60)] + [(None, "vile", None), (99, None, "l"), (99, "", "l"), (100, "kind " * 30_000 + "vilest", "l")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)] + [(None, 1, 1), (5, None, 0), (700, 1, 0), (4, 0, 0)], "doc_id long, toxic int, score int")
    got = predict(docs, labels).collect()
    assert len(got) == 64
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and not by_id[None].held_out and by_id[100].predicted == 1 and by_id[99].predicted == 0
    assert all(by_id[i].predicted == i % 2 for i in range(60))
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() == 30
    assert {r.score for r in predict(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert predict(docs.limit(0), labels.limit(0)).count() == 0
