import random

import pytest

from caselode.operators.overlap import most_shared


@pytest.mark.parametrize("limit", [500_000, 40])
def test_most_shared(spark, limit):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["common"]
    sets = [(i, sorted(set(draw.choices(words, k=draw.randrange(1, 9))) | {"common"} if i % 2 else set(draw.choices(words, k=4)))) for i in range(25)] + [(90, ["nowhere"]), (91, [])]
    rows = [(f"r{i:03d}", sorted(set(draw.choices(words, k=draw.randrange(0, 20))))) for i in range(200)] + [("same", ["common"]), ("same", ["common"]), (None, ["common"]), ("none", None)]
    want = set()
    for item, terms in sets:
        scored = sorted((-len(set(terms) & set(t or ())), i) for i, t in rows if i is not None and set(terms) & set(t or ()))
        want |= {(item, i, -s, r + 1) for r, (s, i) in enumerate(scored[:3])}
    a = spark.createDataFrame(sets, "item long, terms array<string>")
    b = spark.createDataFrame(rows, "id string, terms array<string>").repartition(4)
    assert {tuple(r) for r in most_shared(a, b, 3, limit).collect()} == want
    assert most_shared(a, b.where("false"), 3, limit).count() == most_shared(a.where("false"), b, 3, limit).count() == 0
