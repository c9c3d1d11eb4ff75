"""Toxicity by a subsequence string kernel support vector machine with Nyström landmarks.

Kernel: a word is mapped to its letter triples, in order and with gaps; a triple that spans s letters (at most ``REACH``)
weighs DECAY ** s, and vectors are scaled to length 1. Inserted letters, endings and gaps thus cost some weight but do
not hide a stem. Letters are compared in lower case, anything else inside a token is skipped ("i.d*i#o_t"), and runs of
three or more single letters count as one word.

Training: a labelled text is a bag of sentences, and these bags of words, of which one toxic word suffices. Spark counts, over the labelled training rows, in how
many toxic and other texts each word stands; the words most tied to toxic texts are the positive witnesses, frequent and
sampled words of other texts the negative ones. A positive word also stands with a letter put into each of its gaps, and
into all of them, so that the margin learns what inserted letters leave of it. ``LANDMARKS`` of both make the Nyström map K^(-1/2) k(word), on which a
squared-hinge linear SVM is fitted. Folding the weights back onto the triples leaves one table, so that a word costs as
many look-ups as it has triples. A text's margin is its highest word's; a logistic curve over the training texts' margins,
those beyond the hinge taken as at it, turns it into a score. ``MAX_LABELLED`` bounds the labelled rows learnt from (drawn by hash of the id); everything else
reads all rows.

Defined results: null and empty texts get the margin of a text without words; null ids are scored (as training rows,
held_out false) but never learnt from; a label that is null or has no document is ignored, of several labels for an id
the largest counts; without labels of both kinds every score is 0. A repeated row is scored again. Extra columns are
ignored.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, fresh, memory, slices, text_of, written

REACH, DECAY = 6, 0.6
LANDMARKS = 160
#: At most about so many labelled rows are learnt from.
MAX_LABELLED = 40_000
#: So many words of each side are candidates on the driver.
CANDIDATES = 4_000
#: Times that the words of other texts with the highest margins join the negative ones.
HARD_ROUNDS = 2
REMEMBERED = 400_000
SLICE = 128

SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def letters(token: str) -> str:
    return token if token.isalpha() and token.islower() else "".join(filter(str.isalpha, token.lower()))


def tokens(text: str) -> list[str]:
    """White-space tokens, and each run of single letters as one more."""
    return text.split() + [re.sub(r"\s+", "", m) for m in SPACED.findall(text)]


class Triples:
    """The places of a word's triples, by its length."""

    def __init__(self):
        self.by_length = {}

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.by_length:
            steps = [(0, a, b) for a, b in combinations(range(1, REACH), 2)]
            found = np.array([(i, i + a, i + b) for i in range(n) for _, a, b in steps if i + b < n], np.int64).reshape(-1, 3)
            weights = DECAY ** (found[:, 2] - found[:, 0] + 1.0)
            if n > 64:
                return found, weights
            self.by_length[n] = found, weights
        return self.by_length[n]


TRIPLES = Triples()


def by_length(words: list[str]):
    """Places in words, and letters as a matrix of code points, for each length."""
    groups = defaultdict(list)
    for at, w in enumerate(words):
        groups[len(w)].append(at)
    for n, at in groups.items():
        if n >= 3:
            step = max(1, 50_000 // n)
            for i in range(0, len(at), step):
                some = at[i : i + step]
                yield n, np.array(some), np.frombuffer("".join(words[x] for x in some).encode("utf-32-le"), np.uint32).reshape(len(some), n).astype(np.int64)


def features(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, triple and weight of words of one length, each triple once per row, rows scaled to length 1."""
    places, weights = TRIPLES.of(n)
    keys = (codes[:, places[:, 0]] << 42) | (codes[:, places[:, 1]] << 21) | codes[:, places[:, 2]]
    order = np.argsort(keys, axis=1, kind="stable")
    keys, weights = np.take_along_axis(keys, order, 1), weights[order]
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    starts = np.flatnonzero(new.ravel())
    summed = np.add.reduceat(weights.ravel(), starts)
    row = starts // keys.shape[1]
    norm = np.sqrt(np.bincount(row, summed**2, len(codes)))
    return row, keys.ravel()[starts], summed / norm[row]


class Model:
    """Weights by triple, a bias, and the curve from margins to scores."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.keys, self.weights, self.bias, self.slope, self.shift = keys, weights, bias, slope, shift
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for n, at, codes in by_length(words):
            row, keys, weights = features(codes, n)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[at] += np.bincount(row, np.where(self.keys[place] == keys, self.weights[place] * weights, 0.0), len(codes))
        return out

    def text_margins(self, texts: list[str]) -> list[float]:
        split = [tokens(t) for t in texts]
        new = {t for own in split for t in own} - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {t for own in split for t in own}
        new = list(new)
        self.known.update(zip(new, self.margins([letters(t) for t in new]).tolist(), strict=True))
        return [max(map(self.known.__getitem__, own), default=self.bias) for own in split]

    def score(self, margins) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margins) + self.shift, -30, 30)))


def gapped(word: str) -> list[str]:
    """The word with a drawn letter in one of its gaps, for each gap, and with letters in all of them; seeded by the word."""
    draw = random.Random(word)
    more = lambda: draw.choice("abcdefghijklmnopqrstuvwxyz")
    return [word[:i] + more() + word[i:] for i in range(1, len(word))] + [word[0] + "".join(more() + c for c in word[1:])]


def with_gapped(positive: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Positive words and, with half their weight together, their gapped forms."""
    return positive + [(v, x / (2 * len(word))) for word, x in positive for v in gapped(word)]


def nystroem_svm(positive: list[tuple[str, float]], negative: list[tuple[str, float]], landmarks: int = LANDMARKS) -> Model:
    """Fits word margins from (word, weight) of both kinds, strongest first."""
    marks = [w for w, _ in positive[: landmarks // 2]] + [w for w, _ in negative[: landmarks - landmarks // 2]]
    words = [w for w, _ in positive + negative]
    label = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.array([x for _, x in positive + negative])
    weight /= np.where(label > 0, weight[label > 0].sum(), weight[label < 0].sum())

    def sparse(ws):
        for n, at, codes in by_length(ws):
            row, keys, values = features(codes, n)
            yield at, row, keys, values

    parts = list(sparse(marks))
    keys = np.unique(np.concatenate([k for _, _, k, _ in parts]))
    base = np.zeros((len(marks), len(keys)))
    for at, row, k, v in parts:
        base[at[row], np.searchsorted(keys, k)] = v
    cross = np.zeros((len(words), len(marks)))
    for at_of, row, k, v in sparse(words):
        place = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[place] == k
        ends = np.searchsorted(row, np.arange(row[-1] + 2))
        for r in range(row[-1] + 1):
            own = slice(ends[r], ends[r + 1])
            some = hit[own]
            cross[at_of[r]] = base[:, place[own][some]] @ v[own][some]
    values, vectors = np.linalg.eigh(base @ base.T)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)) * (values > 1e-9)) @ vectors.T
    z = np.hstack([cross @ root, np.ones((len(words), 1))])
    ridge = np.eye(z.shape[1]) * 1e-4
    ridge[-1, -1] = 1e-8
    v = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps of the squared hinge
        inside = label * (z @ v) < 1
        zi, wi = z[inside], weight[inside]
        new = np.linalg.solve(zi.T @ (zi * wi[:, None]) + ridge, zi.T @ (wi * label[inside]))
        if np.allclose(new, v, atol=1e-9):
            break
        v = 0.5 * v + 0.5 * new if _ > 15 else new
    return Model(keys, base.T @ (root @ v[:-1]), float(v[-1]))


def logistic(margin: np.ndarray, label: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that fits counted labels to margins (Platt's targets, Newton steps)."""
    ones, zeros = count[label == 1].sum(), count[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (count * (p - target)) + 1e-6 * beta
        hess = x.T @ (x * (count * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Learns from the labelled rows that are not held out; None without labels of both kinds."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_labelled / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")

    def count_words(batches):
        for batch in slices(batches, 16 * SLICE):
            counts = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {letters(t) for t in set(tokens(text))}:
                    if 3 <= len(w) <= 40:
                        counts[w][toxic > 0] += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "bad": pa.array([c[1] for c in counts.values()], pa.int64())})

    sizes = {bool(r.toxic > 0): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n1, n0 = sizes[True], sizes[False]
    counted = written(rows.mapInArrow(count_words, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")), "words")
    rate1, rate0 = (F.col("bad") + 0.5) / (n1 + 1), (F.col("clean") + 0.5) / (n0 + 1)
    tied = F.log(rate1 / rate0) * F.sqrt(F.col("bad"))
    strong = counted.where(f"bad >= 3 and bad * {n0} > 20 * clean * {n1}").orderBy(tied.desc(), "word").limit(CANDIDATES // 2).select("word", F.col("bad").cast("double").alias("x"))
    plain = counted.where(f"clean > 0 and bad * {n0} <= 3 * clean * {n1}")
    often = plain.orderBy(F.desc("clean"), "word").limit(CANDIDATES // 2).select("word", F.sqrt("clean").alias("x"))
    rare = plain.orderBy(F.xxhash64("word"), "word").limit(CANDIDATES).select("word", F.sqrt("clean").alias("x"))
    positive, negative = [tuple(r) for r in strong.collect()], list({r.word: tuple(r) for r in often.collect() + rare.collect()}.values())
    if not positive or not negative:
        return None
    positive = with_gapped(positive)
    model = nystroem_svm(positive, negative)
    for _ in range(HARD_ROUNDS):
        hardest = plain.withColumn("margin", word_margins(model)("word")).orderBy(F.desc("margin"), "word").limit(CANDIDATES // 2)
        known = {w for w, _ in negative}
        negative += [(r.word, r.x) for r in hardest.select("word", F.sqrt("clean").alias("x")).collect() if r.word not in known]
        model = nystroem_svm(positive, negative)
    packed = pickle.dumps(model)

    def margins(batches):
        own = loaded(packed)
        for batch in slices(batches, SLICE):
            m = np.round(own.text_margins(batch.column(0).to_pylist()), 2)
            yield pa.RecordBatch.from_pydict({"margin": pa.array(m, pa.float64()), "toxic": batch.column(1)})

    table = rows.mapInArrow(margins, "margin double, toxic int").groupBy("margin", "toxic").count().collect()
    model.slope, model.shift = logistic(np.clip([r.margin for r in table], -1, 1), np.array([int(r.toxic > 0) for r in table]), np.array([float(r["count"]) for r in table]))
    return model


def loaded(packed: bytes) -> Model:
    """One for all tasks that a worker runs, with the words that it remembers."""
    return memory(("toxicity", packed), lambda: pickle.loads(packed))


def word_margins(model: Model):
    @F.pandas_udf("double")
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(model.margins(words.tolist()))

    return run


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score between 0 and 1."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def run(batches: pd.Series) -> pd.Series:
        own, texts = loaded(packed), batches.tolist()
        found = [m for at in range(0, len(texts), SLICE) for m in own.text_margins(texts[at : at + SLICE])]
        return pd.Series(own.score(found), dtype=float)

    return docs.withColumn(score_col, run(text_of(text_col)))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, learnt from the labels of others."""
    out = scored(docs.select("doc_id", text_of().alias("text")), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be toxic."""
    score = fresh(docs, "toxic_score")
    return scored(docs, train(docs, labels), score_col=score).where(F.col(score) < 0.5).drop(score)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
