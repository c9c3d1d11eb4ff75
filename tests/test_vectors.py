import numpy as np
import pytest
from pyspark.sql import functions as F

from caselode.operators import vectors


def brute(asked, rows, k, itself=True):
    out = set()
    for q, v in asked:
        scored = []
        for i, w in rows:
            if w is None or len(w) != len(v) or (not itself and i == q):
                continue
            n = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((-round(min(1.0, max(0.0, float(np.dot(v, w) / n) if n else 0.0)), 6), i))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def got(df):
    return {(r.query_id, r.id, r.score, r["rank"]) for r in df.collect()}


@pytest.fixture
def rows():
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(8, 12))
    out = [(f"v{i:04d}", (middle[i % 8] + 0.5 * draw.normal(size=12)).round(3).tolist()) for i in range(600)]
    out += [("same1", out[5][1]), ("same0", out[5][1]), ("zero", [0.0] * 12), ("short", [1.0, 2.0]), ("null", None)]
    return out


@pytest.mark.parametrize("block,cells", [(2048, 4_000_000), (7, 50)])
def test_exact(spark, rows, monkeypatch, block, cells):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELLS", cells)
    asked = rows[:20] + rows[-5:]
    df = spark.createDataFrame(rows, "id string, vector array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id string, vector array<double>")
    asked = [(i, v) for i, v in asked if v is not None]
    assert got(vectors.nearest(q, df, 4)) == brute(asked, rows, 4)
    assert got(vectors.nearest(q, df, 3, itself=False)) == brute(asked, rows, 3, False)
    assert got(vectors.nearest(q.where("false"), df, 3)) == got(vectors.nearest(q, df.where("false"), 3)) == set()


def sparse_rows(signs):
    draw, out = np.random.default_rng(5), []
    for i in range(500):
        v = np.zeros(128)
        v[:6] = np.array([3, 3, 3, 1, 0, 0]) * (i % 3 > 0)  # what very many share
        at = draw.integers(0, 128, 1 + i % 5)
        v[at] += 1 + np.log(draw.integers(1, 4, len(at)))
        if signs:
            v[at[:1]] *= -1
        out.append((f"v{(i * 7919) % 1000:04d}", v.round(3).tolist()))
    return out + [("same1", out[5][1]), ("same0", out[5][1]), ("zero", [0.0] * 128), ("short", [1.0, 2.0]), ("null", None)]


@pytest.mark.parametrize("chunk,block,run", [(4_000_000, 4_000_000, 256), (900, 300, 3)])
@pytest.mark.parametrize("signs", [False, True])
def test_sparse_questions(spark, monkeypatch, signs, chunk, block, run):
    for name, n in (("CHUNK", chunk), ("SPARSE", block), ("RUN", run), ("GROUPS", 2), ("CELLS", 128 * 40)):
        monkeypatch.setattr(vectors, name, n)
    rows = sparse_rows(signs)
    asked = rows[:60] + rows[-5:]
    df = spark.createDataFrame(rows + [("nan", [float("nan")] + [1.0] * 127)], "id string, vector array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id string, vector array<double>")
    assert vectors._sparse_nearest(q, df, 4, "id", "vector") is not None
    want = brute([(i, v) for i, v in asked if v is not None], [*rows, ("nan", [0.0] * 128)], 4)
    assert got(vectors.nearest(q, df, 4)) == want


def test_sparse_questions_read_the_rows_once(spark):
    rows = sparse_rows(False)[:500]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    q = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("query_id"), F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (i == F.pmod(F.col("id"), F.lit(128))).cast("double")).alias("vector"))
    found = vectors.nearest(q, df, 2)
    assert found._jdf.queryExecution().simpleString().count("MapInArrow") == 1  # more than two blocks of BLOCK before
    assert found.count() == 10_000


def test_cells_find_nine_in_ten(spark, rows, tmp_path):
    df = spark.createDataFrame([r for r in rows if r[1] is not None and len(r[1]) == 12], "id string, vector array<double>")
    vectors.write_cells(df, f"{tmp_path}/c", 16)
    stored = spark.read.parquet(f"{tmp_path}/c/cells")
    assert stored.count() == df.count() and stored.select("cell").distinct().count() > 8
    q = df.limit(60).select(F.col("id").alias("query_id"), "vector")
    some, every = ({(a, b) for a, b, *_ in got(f)} for f in (vectors.probed(q, f"{tmp_path}/c", 5, 5), vectors.nearest(q, df, 5)))
    assert len(some & every) >= 0.9 * len(every)
    assert got(vectors.probed(q, f"{tmp_path}/c", 5, 16)) == got(vectors.nearest(q, df, 5))  # all cells: exact


def test_registered_cells_find_nine_in_ten(spark):
    from caselode.plans.texts import vector_cells, vector_topk

    pairs = [{(r.query_id, r.vec_id) for r in f(spark, "/root/testdata/sf0.01").collect()} for f in (vector_cells, vector_topk)]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[1])
