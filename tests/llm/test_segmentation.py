import math
from itertools import product

import numpy as np
import pytest

from caselode.llm import segmentation
from caselode.llm.segmentation import Lattice, Lattices, Sampler, decode, encode, mode_of, op4_segmentation, piece_model


@pytest.fixture(scope="module")
def sampler():
    return Sampler(piece_model())


def all_ways(text, v):
    """Every segmentation of a text and its probability, by plain recursion."""

    def go(i):
        if i == len(text):
            yield (), 0.0
            return
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece in v.ids:
                head = (v.ids[piece],)
            elif j == i + 1:
                head = tuple(v.bytes[b] for b in piece.encode())
            else:
                continue
            for rest, x in go(j):
                yield head + rest, x + sum(v.logs[k] for k in head)

    ways = dict(go(0))
    top = max(ways.values())
    total = top + math.log(sum(math.exp(x - top) for x in ways.values()))
    return {w: math.exp(x - total) for w, x in ways.items()}


@pytest.mark.parametrize("text", [" the", " idiot", " é中🙂", "\n\x00a", " Ab▁c", "   x"])
def test_lattice_against_all_ways(sampler, text):
    want = all_ways(text, sampler.vocabulary)
    lattice = Lattice(text, sampler.vocabulary)
    way, log_p = lattice.first()
    assert math.exp(log_p) == pytest.approx(max(want.values())) and want[tuple(lattice.ids(way))] == pytest.approx(max(want.values()))
    ids, x, others = mode_of(text, sampler.vocabulary)
    assert others == pytest.approx(1 - max(want.values()), abs=1e-12)
    assert math.exp(x) == pytest.approx(max(want.values())) and want[tuple(np.frombuffer(ids, "<u4").tolist())] == pytest.approx(max(want.values()))
    rng = np.random.default_rng(1)
    barred = []
    for _ in range(min(len(want), 6)):
        drawn = lattice.draw(rng, barred)
        assert drawn not in barred and math.exp(lattice.log_p(drawn)) == pytest.approx(want[tuple(lattice.ids(drawn))])
        barred.append(drawn)
        left = sum(p for w, p in want.items() if w not in {tuple(lattice.ids(b)) for b in barred})
        assert lattice.left(barred) == pytest.approx(left, rel=1e-6, abs=1e-30)
    if len(want) > 1:
        other, x = lattice.draw_other(rng)
        assert other != way and math.exp(x) == pytest.approx(want[tuple(lattice.ids(other))])


def test_chunks_cut_no_piece(sampler):
    v = sampler.vocabulary
    for text in (" it's an old-time <tag> text.\nwith  spaces, é中🙂", " " + "".join(map(chr, range(32, 300)))):
        cuts, at = set(), 0
        parts = v.chunks(text)
        assert "".join(parts) == text
        for p in parts:
            at += len(p)
            cuts.add(at)
        assert all(not cuts & set(range(i + 1, j)) for i in range(len(text)) for j in range(i + 2, len(text) + 1) if text[i:j] in v.ids)


def test_samples_follow_the_law_of_drawing_without_replacement(sampler):
    text = "in thea"
    ways = {}
    for parts in product(*[all_ways(c, sampler.vocabulary).items() for c in sampler.vocabulary.chunks(" " + text)]):
        ways[tuple(i for w, _ in parts for i in w)] = math.prod(p for _, p in parts)
    assert sum(ways.values()) == pytest.approx(1)
    rounds, first, second = 4000, {}, {}
    sharp = max(ways, key=ways.get)
    for r in range(rounds):
        got = [tuple(np.frombuffer(s[0], "<u4").tolist()) for s in sampler.samples(r, text, 2)]
        assert len(set(got)) == 2 and all(g in ways for g in got)
        first[got[0]] = first.get(got[0], 0) + 1
        second[tuple(got)] = second.get(tuple(got), 0) + 1
    assert first[sharp] / rounds == pytest.approx(ways[sharp], abs=0.03)
    for (a, b), n in second.items():
        if n > 100:
            assert n / rounds == pytest.approx(ways[a] * ways[b] / (1 - ways[a]), abs=0.03)


def test_inclusion_scores_estimate_the_whole_sum(sampler):
    text = "he is in an of"
    sums = [sum(math.exp(x - q) for _, x, _, q in sampler.samples(r, text, 3)) for r in range(1500)]
    assert np.mean(sums) == pytest.approx(1, abs=0.08)


def test_values_fall_and_few_ways_are_all_given(sampler):
    got = sampler.samples(3, "the old man " * 50, 4)
    assert [s[2] for s in got] == sorted((s[2] for s in got), reverse=True) and len({s[0] for s in got}) == 4
    few = sampler.samples(0, "\x00", 9)
    assert len(few) == 1 and few[0][3] == 0.0
    assert sampler.samples(5, "same key", 2) == sampler.samples(5, "same key", 2)


def test_round_trip_null_repeated_long_and_no_rows(spark):
    texts = [None, "", " ", "  a\nb\t c ", "x▁y ▁", "\x00\x01", "中🙂 é ﬁ①", "x" * 30_000, "🙂" * 3000, "word and " * 20_000]
    rows = [(i, t, "i") for i, t in enumerate(texts)] + [(None, "null key", "i"), (3, texts[3], "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(df, piece_model(), 2), piece_model()).collect()
    by = {r[0]: r[1] or "" for r in rows}
    assert all(r.decoded == by[r.doc_id] and r.log_inclusion <= 0 and r.log_p <= 0 for r in got)
    assert {r.doc_id for r in got} == set(by) and sum(r.doc_id == 3 for r in got) == 4 and sum(r.doc_id == 0 for r in got) == 1
    assert encode(df.limit(0), piece_model()).count() == 0


def test_documents(spark, sf_dir):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_segmentation(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)


def lattices_of(chunks, v):
    starts = np.cumsum([0, *map(len, chunks)])[:-1]
    return Lattices(np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32), starts, v)


CHUNKS = [" the", " idiot", " é中🙂", "\n\x00a", " the", " Ab▁c", "   x", " another", " idiot", " " + "abcdefgh" * 40]


@pytest.mark.parametrize("clash", [False, True])
def test_lattices_in_arrays_against_one_at_a_time(sampler, monkeypatch, clash):
    v = sampler.vocabulary
    if clash:  # every chunk of one length has the same hash
        monkeypatch.setattr(segmentation, "mix", lambda x: np.zeros_like(x))
    many = lattices_of(CHUNKS, v)
    monkeypatch.undo()
    for chunk, code in zip(CHUNKS, many.codes.tolist(), strict=True):
        one = Lattice(chunk, v)
        own, q = slice(many.start[code], many.start[code] + many.size[code]), many.begins[code]
        assert math.isclose(many.log_mode[q], one.mode_log, rel_tol=1e-9, abs_tol=1e-9)
        assert many.other[q] == pytest.approx(one.others, rel=1e-9, abs=1e-300)
        assert one.log_p(many.numbers(many.way[own])) == pytest.approx(one.mode_log, rel=1e-9)
        assert many.edges(code, many.numbers(many.way[own])).tolist() == many.way[own].tolist()
    assert clash or many.codes[0] == many.codes[4] and many.codes[1] == many.codes[8]


def test_ways_drawn_beside_the_likeliest_follow_their_law(sampler):
    v, rounds = sampler.vocabulary, 20_000
    many = lattices_of([" in", " idiot"], v)
    for code, chunk in zip(many.codes.tolist(), (" in", " idiot"), strict=True):
        want = all_ways(chunk, v)
        del want[max(want, key=want.get)]
        edges, start, size, log_p = many.others_drawn(np.full(rounds, code), np.arange(rounds).astype(np.uint64) * np.uint64(977))
        seen = {}
        for a, n, x in zip(start.tolist(), size.tolist(), log_p.tolist(), strict=True):
            way = tuple(many.ids[edges[a : a + n]].tolist())
            assert math.exp(x) == pytest.approx(want[way], rel=1e-6)
            seen[way] = seen.get(way, 0) + 1
        assert all(seen.get(w, 0) / rounds == pytest.approx(p / sum(want.values()), abs=0.02) for w, p in want.items())


def test_samples_do_not_depend_on_the_texts_beside_them(sampler):
    texts = ["in the\nend", "", "an old 中🙂 man", "the idiot " * 30, "in the\nend"]
    together = sampler.sampled([1, 2, None, 4, 1], texts, 3)
    assert together == [sampler.samples(key, text, 3) for key, text in zip([1, 2, None, 4, 1], texts, strict=True)]
    assert together[0] == together[4]


def test_a_worker_keeps_nothing_of_the_texts_that_it_has_seen(sampler):
    import tracemalloc

    rng = np.random.default_rng(0)
    sampler.samples(0, "warm up", 2)
    tracemalloc.start()
    for key in range(20):
        sampler.samples(key, " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (500, 9))), 2)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 200_000


def test_the_query_sends_rows_through_python_once(spark, sf_dir):
    plan = op4_segmentation(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_decoded_texts_of_encoding_are_those_of_decoding(spark):
    df = spark.createDataFrame([(1, "a\nb 中"), (2, None), (3, "the old man")], "doc_id long, text string")
    got = decode(encode(df, piece_model(), 3, decoded=True), piece_model(), text_col="again").collect()
    assert all(r.decoded == r.again for r in got) and {r.decoded for r in got} == {"a\nb 中", "", "the old man"}
