import hashlib
import random

import numpy as np

from caselode.llm.fingerprints import Prefix, edit, fingerprint_chain, likeness, smallest


def test_spans_and_extensions_against_strings():
    draw = random.Random(3)
    for _ in range(60):
        a, b = ("".join(draw.choice("abé🙂") for _ in range(draw.randrange(0, 90))) for _ in "ab")
        b = b[:20] + a[: draw.randrange(0, 90)]
        x, y = Prefix(a), Prefix(b)
        for _ in range(20):
            i, j = draw.randrange(len(a) + 1), draw.randrange(len(b) + 1)
            n = draw.randrange(0, min(len(a) - i, len(b) - j) + 1)
            assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])
            same = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert x.common(i, y, j) == same
        text, values, sketch = edit(x, y)
        half = len(a) // 2
        assert text == a[: len(a) - half] + b[:half]
        whole = Prefix(text)
        assert values == whole.span(0, whole.n) and np.array_equal(sketch, smallest([whole.mixed]))


def test_likeness_follows_the_span_sets():
    draw = random.Random(5)
    a, b = ("".join(draw.choice("abcdefghijklmnop") for _ in range(4000)) for _ in "ab")
    s = lambda t: smallest([Prefix(t).mixed])
    assert likeness(s(a), s(a)) == 1 and likeness(s(a), s(b)) == 0 and likeness(s(""), s("")) == 1 and likeness(s(""), s(a)) == 0
    assert abs(likeness(s(a), s(a[:2000] + b[2000:])) - 0.5) < 0.2


def test_chain_against_brute_force(spark):
    draw = random.Random(7)
    rows = [(i * 3 - 50, "".join(draw.choice("ab é\n🙂") for _ in range(draw.randrange(0, 60))), "e") for i in range(300)]
    rows[7] = (rows[7][0], None, "e")
    rows[9] = (rows[9][0], "x" * 90_000, "e")
    got = {r.doc_id: r for r in fingerprint_chain(spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for (doc, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        text, after, r = text or "", after or "", got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1 or text != edited)
    by_text = {}
    for doc, text, _ in rows:
        assert by_text.setdefault(text or "", got[doc].fingerprint) == got[doc].fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_null_repeated_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprint_chain(make([])).count() == 0
    assert [(r.doc_id, r.near_next) for r in fingerprint_chain(make([(4, "only one")])).collect()] == [(4, 1.0)]
    got = fingerprint_chain(make([(None, "b"), (1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 1), (False, 1), (True, 0), (True, 1)]
