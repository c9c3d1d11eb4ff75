"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Tokens are the words of a text, A-Z in lower case, and one end. Words get 32-bit ids, their places in the sorted array
of 64-bit word hashes. n-grams are counted in three kinds of Spark jobs, each task handling arrays: tasks count what
they read and send one block per shard; a shard's task adds the blocks up, writes its sorted keys and counts to the
shared folder (under a temporary name, then renamed, so that a repeated task does no harm), and passes on, already
summed, its contexts (total and numbers of counts 1, 2, 3+) and its suffixes, whose types are the counts of the order
below. Shards are dealt by context; the contexts of frequent words are dealt further by the predicted word, so that no
word, however frequent, fills one shard. The driver sees a row of sums per shard, never an n-gram.

The arrays are opened with mmap by the workers that score, so spark.checkpoint.dir has to be a folder that all nodes
mount (file: or no scheme). A token's probability is discounted by D1, D2 or D3+ of its order, and the rest of its
context's mass goes to the order below, at last to a uniform share over V + 1 tokens.

Defined results: null and empty texts are one end; null ids are learnt from and not held out; a repeated row is scored
again and counted again in training. Without training rows every token gets the uniform share. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, scratch, slices, text_of, written

ORDER = 2
#: n-grams that a shard is meant to hold, and tokens that a task counts before it sends them on.
SHARD, FLUSH = 1_000_000, 4_000_000
#: Bytes of text that are hashed at a time, and of words that are hashed one by one.
BLOCK_BYTES, LONG = 1 << 16, 64
END = np.uint64(xxhash.xxh64_intdigest(b" end"))

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


#: A value for each byte, 0 for those between words, and one for each place in a word.
VALUES = np.array([0 if b in b" \t\n\v\f\r\xff" else xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
POWERS = np.cumprod(np.full(LONG + 1, _A | np.uint64(1)))
BETWEEN = VALUES == 0


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def gram_hash(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of an id matrix."""
    out = np.full(len(ids), np.uint64(ids.shape[1]))
    for column in ids.T:
        out = mix(out ^ column.astype(np.uint64))
    return out


def high(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def summed(keys: np.ndarray, *values: np.ndarray):
    """Sorted distinct keys, the place of each one's first row, and the sums of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[starts], order[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


def publish(path: str, array: np.ndarray) -> None:
    if len(array):
        with open(f"{path}.{os.getpid()}.part", "wb") as f:
            array.tofile(f)
        os.replace(f.name, path)


@lru_cache(100_000)
def opened(path: str, kind: str) -> np.ndarray:
    """A memory-mapped array; empty where nothing was published."""
    return np.memmap(path, kind, "r") if os.path.exists(path) else np.zeros(0, kind)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: sums of their bytes' values times powers by place, mixed; longer ones than LONG one by one."""
    out, long = np.zeros(len(starts), np.uint64), np.flatnonzero(ends - starts > LONG)
    cuts = np.searchsorted(starts, np.arange(0, len(raw), BLOCK_BYTES))
    cuts = np.unique(np.concatenate([[0, len(starts)], cuts, long, long + 1]))  # a long word is a block of its own
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if ends[a] - starts[a] <= LONG:
            own = raw[starts[a] : ends[b - 1]]
            first = starts[a:b] - starts[a]
            place = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
            # what lies between words counts nothing
            out[a:b] = np.add.reduceat(VALUES[own] * POWERS.take(place, mode="clip"), first)
    out = mix(out)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return out


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens one after the other, and the number of each text's tokens."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"\xff".join([*[t.encode() for t in texts], b""]).lower(), np.uint8)  # no text in UTF-8 has that byte
    gap = BETWEEN[raw]
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    n = np.diff(np.searchsorted(starts, np.flatnonzero(raw == 0xFF)), prepend=0)
    out = np.full(len(starts) + len(texts), END)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), n)] = word_hashes(raw, starts, ends)
    return out, n + 1


class Vocabulary:
    """Ids and counts of the training words: places in sorted arrays, one a shard, split by the hashes' highest bits."""

    def __init__(self, folder: str, bits: int, sizes: list[int], total: int):
        self.folder, self.bits, self.total = folder, bits, total
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.size = int(self.starts[-1])  # the id of unknown words; size + 1 stands before a text
        if self.size >= 2**32 - 2:
            raise ValueError("more than 2 ** 32 distinct tokens")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts, for sorted distinct hashes."""
        ids, counts = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(high(hashes, self.bits), np.arange(len(self.starts)))
        for shard in np.flatnonzero(np.diff(edges)):
            a, b = edges[shard], edges[shard + 1]
            at, hit = place(opened(f"{self.folder}/v-{shard}.key", "<u8"), hashes[a:b])
            if hit.any():
                ids[a:b][hit] = at[hit] + self.starts[shard]
                counts[a:b][hit] = opened(f"{self.folder}/v-{shard}.cnt", "<i8")[at[hit]]
        return ids, counts


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted wanted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def grams(ids: np.ndarray, lengths: np.ndarray, order: int, start: int) -> np.ndarray:
    """The id matrix of each token with the order - 1 ids before it, start standing before a text."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    index = np.arange(len(ids))
    columns = [np.where(index - back >= first, ids[np.maximum(index - back, 0)], start) for back in range(order - 1, 0, -1)]
    return np.stack([*columns, ids], axis=1)


def shards_of(ids: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """By context, and by the last word as well behind a hot word; single words by themselves."""
    if ids.shape[1] == 1:
        return high(gram_hash(ids), bits)
    salt = np.where(np.isin(ids[:, -2], hot), mix(ids[:, -1].astype(np.uint64)), np.uint64(0))
    return high(mix(gram_hash(ids[:, :-1]) ^ salt), bits)


BLOCK = "kind long, shard long, a binary, b binary, c binary, d binary, e binary"
_FIELDS = [x.split()[0] for x in BLOCK.split(", ")]


def blocks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(columns)], names=_FIELDS)


def dealt(kind: int, shard: np.ndarray, *arrays: np.ndarray):
    """One block for each shard."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)) if len(shard) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = order[a:b]
        yield (kind, int(shard[at[0]]), *[x[at].tobytes() for x in arrays], *[None] * (5 - len(arrays)))


def by_shard(batches, types: list[str]):
    """(shard, arrays) of blocks that come sorted by shard."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != now and held:
                yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = row["shard"]
            held.append([np.frombuffer(row[f], t) for f, t in zip("abcde", types, strict=False)])
    if held:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]


def gathered(df: DataFrame, kind: int, bits: int) -> DataFrame:
    return df.where(F.col("kind") == kind).repartition(2 << bits, "shard").sortWithinPartitions("shard")


def local_path(path: str) -> str:
    scheme, _, rest = path.rpartition("://") if "://" in path else path.rpartition("file:")
    if scheme not in ("", "file"):
        raise ValueError(f"workers cannot map files of {path}; spark.checkpoint.dir has to be a folder that all nodes mount")
    return rest


def flushed(texts, to_rows):
    """Calls to_rows with the tokens of many texts at a time."""
    held, n = [], 0
    for batch in slices(texts, 256):
        held.append(token_hashes(batch.column(0).to_pylist()))
        n += len(held[-1][0])
        if n >= FLUSH:
            yield to_rows(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held, n = [], 0
    if held:
        yield to_rows(*[np.concatenate(x) for x in zip(*held, strict=True)])


class Model:
    """Where the arrays lie, and the few numbers that go with them."""

    def __init__(self, vocabulary: Vocabulary, order: int, bits: int, hot: np.ndarray):
        self.vocabulary, self.order, self.bits, self.hot = vocabulary, order, bits, hot
        self.discounts: dict[int, np.ndarray] = {}  # by order: 0, D1, D2, D3+
        self.singles = np.zeros(4)  # total, N1, N2, N3+ of the lowest order

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of n-grams of one order."""
        order, keys, shard = ids.shape[1], gram_hash(ids), shards_of(ids, self.bits, self.hot)
        return self._find(f"g{order}", keys, shard, "<i8", 1)[:, 0]

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Total, N1, N2 and N3+ of what follows each row of ids."""
        keys = gram_hash(ids)
        return self._find(f"x{ids.shape[1] + 1}", keys, high(keys, self.bits), "<i8", 4)

    def _find(self, name: str, keys: np.ndarray, shard: np.ndarray, kind: str, width: int) -> np.ndarray:
        out = np.zeros((len(keys), width), np.int64)
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            base = f"{self.vocabulary.folder}/{name}-{shard[a]}"
            at, hit = place(opened(base + ".key", "<u8"), keys[a:b])
            if hit.any():
                out[order[a:b][hit]] = opened(base + ".cnt", kind).reshape(-1, width)[at[hit]]
        return out

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """P(last id | those before) for rows of order ids."""
        order = ids.shape[1]
        if order == 1:
            stats, lower = np.broadcast_to(self.singles, (len(ids), 4)), np.full(len(ids), 1 / (self.vocabulary.size + 1))
        else:
            stats, lower = self.contexts(ids[:, :-1]).astype(float), self.probabilities(ids[:, 1:])
        c, d = self.counts(ids), self.discounts[order]
        total = np.maximum(stats[:, 0], 1)
        rest = stats[:, 1:] @ d[1:] / total
        own = np.maximum(c - d[np.minimum(c, 3)], 0) / total
        return np.where(stats[:, 0] > 0, own + rest * lower, lower)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text: tokens, known ones, base score and model score (log10)."""
        hashes, lengths = token_hashes(texts)
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = self.vocabulary.find(distinct)
        v = self.vocabulary
        base = np.log10((counts + 0.5) / (v.total + 0.5 * (v.size + 1)))
        rows = grams(ids[back], lengths, self.order, v.size + 1)
        keys, first, again = np.unique(gram_hash(rows), return_index=True, return_inverse=True)
        model = np.log10(self.probabilities(rows[first])) if v.total else np.full(len(keys), -np.log10(v.size + 1))
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return np.stack([lengths, add((counts[back] > 0).astype(float)), add(base[back]), add(model[again])], axis=1)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1 to 4 times; the usual ones where they fail."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [0.0] + [k - (k + 1) * y * b / a if a and b else 0.5 * min(k, 2) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *[x if 0 < x < k else 0.5 * k for k, x in zip((1, 2, 3), raw[1:], strict=True)]])


def train(texts: DataFrame, order: int = ORDER, shard: int = SHARD) -> Model:
    """Counts the only column of texts; reads it twice."""
    spark = texts.sparkSession
    folder = local_path(scratch(spark, "lm"))
    os.makedirs(folder, exist_ok=True)

    # about six characters a token: this only decides how many shards there are
    n_words = (texts.agg(F.sum(F.length(texts.columns[0]))).head()[0] or 0) // 6
    bits = max(0, int(np.ceil(np.log2(max(1, n_words) / shard))))

    def word_counts(batches):
        def send(hashes, _):
            keys, counts = np.unique(hashes, return_counts=True)
            return blocks(list(dealt(0, high(keys, bits), keys, counts.astype("<i8"))))

        yield from flushed(batches, send)

    def vocabulary(batches):
        for s, (keys, counts) in by_shard(batches, ["<u8", "<i8"]):
            keys, _, counts = summed(keys, counts)
            publish(f"{folder}/v-{s}.key", keys)
            publish(f"{folder}/v-{s}.cnt", counts)
            often = np.argsort(-counts)[: 16 << bits if bits < 4 else 256]
            yield blocks([(len(keys), s, int(counts.sum()).to_bytes(8, "little"), often.astype("<i8").tobytes(), counts[often].tobytes(), None, None)])

    found = gathered(texts.mapInArrow(word_counts, BLOCK), 0, bits).mapInArrow(vocabulary, BLOCK).collect()
    sizes, total = [0] * (1 << bits), 0
    for r in found:
        sizes[r.shard] = r.kind
        total += int.from_bytes(r.a, "little")
    v = Vocabulary(folder, bits, sizes, total)
    hot = [np.frombuffer(r.b, "<i8")[np.frombuffer(r.c, "<i8") > total / (8 << bits)] + v.starts[r.shard] for r in found]
    model = Model(v, order, bits, np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.int64))
    packed = pickle.dumps(model)

    def gram_counts(batches):
        m = loaded(packed)

        def send(hashes, lengths):
            distinct, back = np.unique(hashes, return_inverse=True)
            rows = grams(m.vocabulary.find(distinct)[0][back], lengths, order, m.vocabulary.size + 1)
            _, first, counts = summed(gram_hash(rows), np.ones(len(rows), np.int64))
            rows = rows[first]
            return blocks(list(dealt(order, shards_of(rows, bits, m.hot), rows.astype("<u4"), counts.astype("<u4"))))

        yield from flushed(batches, send)

    level = texts.mapInArrow(gram_counts, BLOCK)
    stats: list = []
    for k in range(order, 0, -1):

        def add_up(batches, k=k):
            m = loaded(packed)
            for s, (ids, counts) in by_shard(batches, ["<u4", "<u4"]):
                ids = ids.reshape(-1, k).astype(np.int64)
                keys, first, counts = summed(gram_hash(ids), counts.astype(np.int64))
                ids = ids[first]
                publish(f"{folder}/g{k}-{s}.key", keys)
                publish(f"{folder}/g{k}-{s}.cnt", counts.astype("<i8"))
                seen = [counts == 1, counts == 2, counts >= 3]
                yield blocks([(100 + k, s, np.array([counts.sum(), *[x.sum() for x in seen], (counts == 3).sum(), (counts == 4).sum()], "<i8").tobytes(), *[None] * 4)])
                if k > 1:
                    contexts, _, *sums = summed(gram_hash(ids[:, :-1]), counts, *[x.astype(np.int64) for x in seen])
                    yield blocks(list(dealt(200, high(contexts, bits), contexts, *[x.astype("<i8") for x in sums])))
                    _, first, types = summed(gram_hash(ids[:, 1:]), np.ones(len(ids), np.int64))
                    suffix = ids[first, 1:]
                    yield blocks(list(dealt(k - 1, shards_of(suffix, bits, m.hot), suffix.astype("<u4"), types.astype("<u4"))))

        def add_contexts(batches, k=k):
            for s, (keys, *sums) in by_shard(batches, ["<u8", "<i8", "<i8", "<i8", "<i8"]):
                keys, _, *sums = summed(keys, *sums)
                publish(f"{folder}/x{k}-{s}.key", keys)
                publish(f"{folder}/x{k}-{s}.cnt", np.stack(sums, axis=1).ravel())
                yield blocks([(300, s, None, None, None, None, None)])

        level = written(gathered(level, k, bits).mapInArrow(add_up, BLOCK), "level")
        if k > 1:
            gathered(level, 200, bits).mapInArrow(add_contexts, BLOCK).count()
        rows = [np.frombuffer(r.a, "<i8") for r in level.where(F.col("kind") == 100 + k).select("a").collect()]
        all_, n1, n2, n3up, n3, n4 = np.sum(rows, axis=0).tolist() if rows else [0] * 6
        model.discounts[k] = discounts(n1, n2, n3, n4)
        if k == 1:
            model.singles = np.array([all_, n1, n2, n3up], float)
    return model


@lru_cache(2)
def loaded(packed: bytes) -> Model:
    return pickle.loads(packed)


def scored(df: DataFrame, model: Model) -> DataFrame:
    """For a frame whose last column is the text: its other columns, then tokens, known ones, base and model score."""
    packed = pickle.dumps(model)
    keys = df.columns[:-1]

    def run(batches):
        m = loaded(packed)
        for batch in slices(batches, 512):
            out = m.scores(batch.column(len(keys)).to_pylist())
            new = [pa.array(out[:, i].astype(np.int64)) for i in (0, 1)] + [pa.array(out[:, i]) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keys, "n_tokens", "n_known", "base_score", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1])
    return df.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    rows = documents(spark, sf_dir).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    model = train(rows.where("not held_out").select("text"))
    out = scored(rows, model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
