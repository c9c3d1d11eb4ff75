"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text is the set of its runs of ``SHINGLE`` lower-case words (a shorter text is one run). Each element throws darts: a
Poisson process over (weight, time, coordinate) that depends on the element alone, with weight cut into the dyadic
regions [0, 1), [1, 2), [2, 4), ... A text owns the darts below its elements' weights and keeps the earliest of each
coordinate; two texts agree in a coordinate with probability sum(min) / sum(max) of their weights. Darts are thrown only
up to the time by which all coordinates are likely to be hit, about t (ln t + 3) darts whatever the text's length, and
longer if one stays empty. An element weighs as often as it occurs, so that the threshold is on the weighted Jaccard
similarity, sum(min) / sum(max) of the counts; with ``weights="set"`` every element weighs 1.

``BANDS`` bands of ``ROWS`` coordinates are joined. Copies are first reduced to one text each. Every id is compared with
one leader, the smallest id that it shares a bucket with; verified links give a forest of components. Then the buckets
that hold more than one component are compared with their own member that shares most such buckets, across components only. Buckets that are still
mixed after that are compared in blocks of ``BLOCK`` members, again across components only.
A pair outside a component is first compared by two bits of each coordinate, and where these do not rule the threshold
out (four deviations), by the sets themselves. So no pair that shares a band is passed over, and no pair of a component is
looked at again. At 0.8 a pair is missed with probability (1 - 0.8 ** ROWS) ** BANDS, under 1e-4. Members of a bucket
that are in many pairs at once are split: the set of a hot leader is sent to many tasks, each with some of its pairs.

Defined results: null and empty texts are copies of each other and have no other links; rows without an id are never
linked and form classes of their own (class_id null, kept). Repeated rows get the same result each; rows with one id but
different texts share a class. Empty tables give no rows. Extra columns are ignored, or kept by ``without_near_copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import discard, documents, fresh, hot_keys, memory, slices, spread_join, text_of, written
from caselode.llm.exact_dedup import digest, mark_groups

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
BLOCK = 512
REMEMBERED = 600_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes() -> WordHashes:
    return memory("shingles", WordHashes)


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of words as sorted hashes, and how often each occurs."""
    words = text.lower().split()
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h, np.zeros(0)
    k = min(size, len(h))
    run = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        run = mix(run ^ h[i : len(h) - k + 1 + i])
    return np.unique(run, return_counts=True)


def darts(seed: np.ndarray, of: np.ndarray, limit: np.ndarray, end: np.ndarray, width: float, size: int):
    """Places, times and hashes of the darts of one region that lie below the limits: elements throw a few at a time, until
    their ends, those that throw about as often together."""
    often = np.digitize(end * width, (1.5, 6.0))
    for level, step in enumerate((1, 4, 12)):
        some = np.flatnonzero(often == level)
        s, row, top, last, time, n = seed[some], of[some], limit[some], end[some], np.zeros(len(some)), 0
        while len(s):
            a = mix(s[:, None] + np.arange(n + 1, n + step + 1, dtype=np.uint64) * _C)
            times = time[:, None] - np.cumsum(np.log(((a >> np.uint64(11)).astype(float) + 1) * 2.0**-53), axis=1) / width
            on = times < last[:, None]
            hit = np.flatnonzero(on.ravel())
            thrower, dart = hit // step, mix(a.ravel()[hit])
            place = row[thrower] * size + ((dart & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            own = (dart >> np.uint64(32)).astype(float) * (2.0**-32 * width) < top[thrower] if (top < width).any() else slice(None)
            yield place[own], times.ravel()[hit][own], dart[own]
            more = on[:, -1]
            s, row, top, last, time, n = s[more], row[more], top[more], last[more], times[more, -1], n + step


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The earliest dart of each coordinate, a row for each weighted set (keys, weights); all sets are thrown at once."""
    out = np.zeros((len(sets), size), np.uint64)
    todo = np.arange(len(sets))
    until = np.array([size * (np.log(size) + 3) / w.sum() for _, w in sets])
    while len(todo):
        key = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo])
        row = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        found, low, width, box = [], 0.0, 1.0, 0
        while len(inside := np.flatnonzero(weight > low)):
            seed = mix(key[inside] ^ mix(np.uint64([box]))[0])
            found += darts(seed, row[inside], weight[inside] - low, until[todo][row[inside]], width, size)
            low, width, box = low + width, low + width, box + 1
        place, time, dart = map(np.concatenate, zip(*found, strict=True))
        best = np.full(len(todo) * size, np.inf)
        np.minimum.at(best, place, time)
        first = time == best[place]
        signature = np.zeros(len(todo) * size, np.uint64)
        signature[place[first]] = dart[first]
        whole = np.isfinite(best).reshape(-1, size).all(axis=1)
        out[todo[whole]] = signature.reshape(-1, size)[whole]
        todo = todo[~whole]
        until[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band, by row of signatures."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands))
    for i in range(rows):
        key = mix(key ^ signatures.reshape(-1, bands, rows)[:, :, i])
    return key.view(np.int64)


def planes(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, packed: all lower bits, then all higher ones."""
    pad = np.pad(signatures, ((0, 0), (0, -signatures.shape[1] % 64)))
    # the coordinate took a dart's low bits, so these come from its high ones
    halves = [np.packbits((pad >> np.uint64(s) & np.uint64(1)).astype(np.uint8), axis=1) for s in (62, 63)]
    return np.concatenate(halves, axis=1).view(np.int64)


def may_reach(bits: int, threshold: float) -> int:
    """Coordinates in which two bits may differ at the threshold: the mean and four deviations."""
    p = 0.75 * (1 - threshold)
    return int(np.ceil(bits * p + 4 * np.sqrt(bits * p * (1 - p))))


def sketches(df: DataFrame, id_col: str, text_col: str, weights: str, bands: int, rows: int) -> DataFrame:
    """id, sha (of the text), its band keys and bit planes; none for texts without words."""

    def run(batches):
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            some = [i for i, (k, _) in enumerate(found) if len(k)]
            drawn = dart_signatures([(found[i][0], found[i][1].astype(float) if weights == "count" else np.ones(len(found[i][0]))) for i in some], bands * rows)
            out = [[[]] * len(found), [[]] * len(found)]
            for i, k, p in zip(some, band_keys(drawn, bands, rows), planes(drawn), strict=True):
                out[0][i], out[1][i] = k, p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.list_(pa.int64())) for x in out]], ["id", "sha", "bands", "planes"])

    rows_in = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), digest(text_of(text_col)).alias("sha"), text_of(text_col).alias("text"))
    return rows_in.mapInArrow(run, "id long, sha string, bands array<long>, planes array<long>")


def elements(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, weights: str) -> DataFrame:
    """id and keys, the elements of the texts with a wanted id; with weights="count" the n-th of equal ones is one of its own."""

    def run(batches):
        for batch in slices(batches):
            keys = []
            for text in batch.column(1).to_pylist():
                k, n = shingles(text)
                if weights == "count" and len(k):
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    k = np.repeat(k, n)
                    k = np.where(nth > 0, mix(k ^ mix(nth.astype(np.uint64))), k)
                keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return texts.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(run, "id long, keys array<long>")


def similar(a: str, b: str, threshold: float):
    """Whether the Jaccard similarity of two key columns reaches the threshold: both / (sum - both), the sets met once."""
    size = F.size(a) + F.size(b)
    return (F.least(F.size(a), F.size(b)) * (1 + threshold) >= threshold * size - 1e-9) & (F.size(F.array_intersect(a, b)) * (1 + threshold) >= threshold * size - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. An a in very many pairs has its set sent to several tasks."""
    hot = F.broadcast(hot_keys(pairs, "a").select("a", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    side = lambda s: sets.select(F.col("id").alias(s), F.col("keys").alias(f"k{s}"))
    left = side("a").join(hot, "a", "left").select("a", "ka", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    met = dealt.join(left.hint("merge"), ["a", "part"]).join(side("b").hint("merge"), "b")
    return written(met.where(similar("ka", "kb", threshold)).select("a", "b").distinct(), "links")


def forest(links: DataFrame) -> DataFrame:
    """id and label (smallest id) of every id in links (a, b), where a < b and no b occurs twice: labels of labels, until they stay."""
    roots = links.select(F.col("a").alias("id")).distinct().join(links.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.col("id").alias("label"))
    labels = written(links.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(roots), "labels")
    while True:
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = written(spread_join(labels, far, "label").select("id", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")), "labels")
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            return labels


def components(links: DataFrame) -> DataFrame:
    """id and label (smallest id) of every id in links (a, b): smallest labels pass along the links, then labels of labels."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label")), "labels")
    while True:
        near = spread_join(edges, labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old")), "labels")
        far = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = written(spread_join(step, far, "new").select("id", F.least("new", "far").alias("label"), "old"), "labels")
        if step.where("label < old").isEmpty():
            return step.select("id", "label")
        labels = step.select("id", "label")


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label, its components joined by further links (a, b): only the components are gone through again, not their members."""
    name = lambda df, s: df.join(label.select(F.col("id").alias(s), F.col("label").alias(f"l{s}")).hint("merge"), s, "left").withColumn(f"l{s}", F.coalesce(f"l{s}", s))
    named = written(name(name(links, "a"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "joined")
    new = components(named).select(F.col("id").alias("label"), F.col("label").alias("new"))
    every = label.unionByName(named.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left_anti").select("id", F.col("id").alias("label")))
    return written(every.join(new, "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")


def mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """key, id and label of the members (key, id) of buckets with more than one component."""
    named = members.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return written(named.join(several, "key", "left_semi"), "mixed")


def close(left: str, right: str, bands: int, rows: int, threshold: float):
    """Whether two bit planes leave the threshold possible."""
    half = -(-bands * rows // 64)
    a, b = F.col(left), F.col(right)
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i]).bitwiseOR(a[i + half].bitwiseXOR(b[i + half]))) for i in range(half)), F.lit(0))
    return differ <= may_reach(bands * rows, threshold)


def led(named: DataFrame, bits: DataFrame, likely) -> DataFrame:
    """Pairs (a, b) across components whose planes are likely, a the member of a bucket of both that is in most buckets: a text
    that others are varied from shares more with each than they share with one another."""
    often = named.groupBy("id").agg((-F.count("*")).alias("n"))
    ahead = named.join(often, "id").groupBy("key").agg(F.min(F.struct("n", "id", "label")).alias("lead")).select("key", F.col("lead.id").alias("a"), F.col("lead.label").alias("lead_label"))
    asked = written(spread_join(named, ahead, "key").where("label <> lead_label").select("a", F.col("id").alias("b")).distinct(), "asked")
    with_a = spread_join(asked, bits.select(F.col("id").alias("a"), F.col("planes").alias("planes_a")), "a")
    with_b = with_a.join(bits.select(F.col("id").alias("b"), F.col("planes").alias("planes_b")).hint("merge"), "b")
    return written(with_b.where(likely).select("a", "b").distinct(), "pairs")


def in_blocks(named: DataFrame, bits: DataFrame, sets: DataFrame, likely, threshold: float) -> DataFrame:
    """Links (a, b) across components that share a bucket. Members meet block by block: first their planes, which leaves the
    members that have a likely partner; only these meet with their sets, and the join yields links alone."""
    size = named.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("n_blocks"))
    rows = written(spread_join(named, size, "key").join(bits.hint("merge"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "n_blocks")), "blocks")

    def side(rows, s, block):
        return rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "id", "label", "planes")], *([F.col("keys").alias(f"keys_{s}")] if "keys" in rows.columns else []), block.alias(f"block_{s}"))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    same = (F.col("key_a") == F.col("key_b")) & (F.col("block_a") == F.col("block_b")) & (F.col("label_a") != F.col("label_b")) & likely
    hopeful = side(rows, "a", every).join(side(rows, "b", F.col("block")), same, "left_semi").select(F.col("key_a").alias("key"), F.col("id_a").alias("id")).distinct()
    left = written(rows.join(hopeful, ["key", "id"], "left_semi"), "hopeful")
    full = left.join(sets.join(left.select("id").distinct(), "id", "left_semi").hint("merge"), "id")
    near = F.when(likely, similar("keys_a", "keys_b", threshold)).otherwise(False)
    met = side(full, "a", every).join(side(full, "b", F.col("block")), same & (F.col("id_a") < F.col("id_b")) & near)
    return written(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "links")


def classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    weights: str = "count",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """id, class_id (an id of the class), kept (true for that id), copy_of (the id that stands for equal texts)."""
    made = written(sketches(df, id_col, text_col, weights, bands, rows), "sketches")
    marked = written(mark_groups(made.select("id", "sha"), "sha", "id").select("id", "sha", "keep_id"), "copies")
    single = made.dropDuplicates(["id", "sha"]).join(marked.where("id = keep_id").select("id", "sha").distinct().hint("merge"), ["id", "sha"], "left_semi")
    single = written(single.select("id", "bands", "planes"), "single")
    all_keys = single.select("id", F.explode("bands").alias("key"))
    leaders = all_keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader")
    buckets = written(all_keys.join(leaders, "key").select("key", "id", "leader"), "buckets")
    sets = written(elements(df, buckets.select("id").distinct(), id_col, text_col, weights).distinct(), "elements")
    first = written(buckets.where("leader < id").groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), "pairs")
    label = forest(verified(first, sets, threshold))
    bits = single.select("id", "planes")
    likely = close("planes_a", "planes_b", bands, rows, threshold)
    named = mixed(buckets.select("key", "id"), label)
    new = verified(led(named, bits, likely), sets, threshold)
    if not new.isEmpty():
        label = relabelled(label, new)
        named = mixed(named.select("key", "id"), label)
    rest = in_blocks(named, bits, sets, likely, threshold)
    if not rest.isEmpty():
        label = relabelled(label, rest)
    discard(made, single, buckets, sets, first, named)
    of = label.withColumnRenamed("id", "keep_id")
    linked = spread_join(marked.where("keep_id is not null").select("id", "keep_id"), marked.select("keep_id").distinct().join(of, "keep_id", "left"), "keep_id")
    found = linked.select("id", F.coalesce("label", "keep_id").alias("class_id"), F.col("keep_id").alias("copy_of"))
    none = df.where(F.col(id_col).isNull()).select(*[F.lit(None).cast("long").alias(c) for c in ("id", "class_id", "copy_of")])
    out = found.unionByName(none)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "copy_of")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, but for those that another row of their class stands for."""
    gone = fresh(df, "gone_id")
    dropped = classes(df, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    return df.join(dropped, F.col(id_col) == F.col(gone), "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return classes(documents(spark, sf_dir))
