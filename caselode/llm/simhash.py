"""SimHash near-duplicate components, by pivot distance tables within buckets of agreeing bits.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it; a shingle counts as often
as it occurs. Fingerprints at ``REACH`` differing bits or fewer are linked, and linked ones make components. All work
after the first pass is on distinct fingerprints, so copies cost nothing.

Distances to references say little about where a near-random fingerprint lies (all are about 32 bits from everything),
too little for a join. So fingerprints meet in buckets first: cut into m blocks of bits, two that differ in at most
``REACH`` bits agree in at least m - REACH blocks, and a bucket is a choice of so many blocks with what stands in them. In the
buckets, the table of the members' distances to the references (a column a pivot) discards every pair with a coordinate
that differs by more than ``REACH``, by the triangle inequality; the first coordinate is sorted, so that only a window of it
is looked at. Survivors are verified by their differing bits. A bucket gives a star for each of its own components, never
its pairs.

A bucket of more than ``FULL`` members is not compared: all its members go on to the next, finer cut in ``CUTS``, where any
two of them that are linked meet again. Buckets that hold a large share of the rows are told by a sketch of fixed size and
never leave their tasks; others are noticed as they stream by. The last cut leaves 16 free bits, so that a bucket there has
at most 65,536 members by construction; nothing is dropped or capped. The first cut is the coarsest whose keys are as many
as the fingerprints.

Defined results: null and empty texts, and those without words, have fingerprint zero, linked like any other; texts with
fewer words than a shingle are one shingle. Rows without an id get a fingerprint and the component of their
fingerprint, but are no component's smallest id (null where all its rows have none). Repeated rows get the same result
each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, slices, spread_join, text_of, written
from caselode.llm.near_dedup import components, mix

SHINGLE, REACH, SEED = 4, 4, 42
#: Numbers of blocks that the 64 bits are cut into, coarse to fine: 21, 27, 35, 42 and 48 bits of a key.
CUTS = (6, 7, 9, 12, 16)
#: Members of a bucket that are compared with one another in one task.
FULL = 2048
#: References of the distance table.
PIVOTS = 16
#: Pairs of a bucket that are looked at together.
PAIRS = 2_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined shingles, in order."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def simhash(found: np.ndarray) -> int:
    """Bits set in more than half of the hashes; hashes are taken in slices, so that a long text takes little memory."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and fp of every row, fp as a signed 64-bit number."""

    def run(batches):
        for batch in slices(batches):
            fp = np.array([simhash(hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


def references(n: int = PIVOTS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64))


def table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the references, a row for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ pivots).astype(np.uint8)


def masks(blocks: int, reach: int = REACH) -> np.ndarray:
    """The bits of every choice of all but ``reach`` of the blocks."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    of = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    return np.array([sum(c) for c in combinations(of, blocks - reach)], np.uint64)


def cut_for(n: int) -> int:
    """Place in CUTS of the first cut: the coarsest whose keys are at least as many as the fingerprints."""
    return next((i for i, m in enumerate(CUTS) if 2 ** (64 * (m - REACH) // m) >= n), len(CUTS) - 1)


def near_pairs(fp: np.ndarray, bucket: np.ndarray, pivots: np.ndarray, reach: int = REACH):
    """Places (i, j) of the pairs within a bucket at ``reach`` or fewer differing bits, in pieces: windows of the first
    coordinate of the distance table, then all its coordinates, then the bits."""
    coordinates = table(fp, pivots).astype(np.int16)
    at_first = bucket * 1024 + coordinates[:, 0]
    order = np.argsort(at_first, kind="stable")
    fp, coordinates, at_first = fp[order], coordinates[order], at_first[order]
    width = np.searchsorted(at_first, at_first + reach, side="right") - np.arange(len(fp)) - 1
    total = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(at, to), width[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], width[at:to])
        for c in range(1, len(pivots)):
            close = np.abs(coordinates[i, c] - coordinates[j, c]) <= reach
            i, j = i[close], j[close]
        real = np.bitwise_count(fp[i] ^ fp[j]) <= reach
        yield order[i[real]], order[j[real]]
        at = to


def stars(fp: np.ndarray, bucket: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first member of each component within a bucket to its other members."""
    label = np.arange(len(fp))
    pairs = list(near_pairs(fp, bucket, pivots))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            before = label.copy()
            np.minimum.at(label, a, before[b])
            np.minimum.at(label, b, before[a])
            label = label[label]
            if np.array_equal(label, before):
                break
    moved = label != np.arange(len(fp))
    return fp[label[moved]], fp[moved]


def bucketed(distinct: DataFrame, blocks: int) -> DataFrame:
    """fp and the key of each of its buckets; two buckets with one key by chance cost a comparison and give no link."""
    cut = masks(blocks)
    salt = mix(np.arange(len(cut), dtype=np.uint64))

    def run(batches):
        for batch in slices(batches, 4096):
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys = mix((fp[:, None] & cut) ^ salt).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp.view(np.int64), len(cut))), pa.array(keys.ravel())], ["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def compared(members: DataFrame, full: int | None) -> DataFrame:
    """a and b: a star for each component within a bucket; for members of buckets of more than ``full``, a alone."""
    pivots = references()

    def links(fp, key):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        bucket = np.repeat(np.arange(len(starts)), size)
        over = np.repeat(size > full, size) if full else np.zeros(len(fp), bool)
        several = ~over & np.repeat(size > 1, size)
        a, b = stars(fp[several], bucket[several], pivots)
        passed = fp[over]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, passed]).view(np.int64)), pa.array([*b.view(np.int64), *[None] * len(passed)], pa.int64())], ["a", "b"])

    def run(batches):
        held, large = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), None
        for batch in batches:
            fp, key = np.concatenate([held[0], batch.column(0).to_numpy().view(np.uint64)]), np.concatenate([held[1], batch.column(1).to_numpy()])
            if large is not None:  # the rest of a bucket that is already known to be over
                more = key == large
                yield pa.RecordBatch.from_arrays([pa.array(fp[more].view(np.int64)), pa.nulls(int(more.sum()), pa.int64())], ["a", "b"])
                fp, key = fp[~more], key[~more]
            if not len(key):
                continue
            open_ = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if full and len(key) - open_ > full:
                open_, large = len(key), key[-1]
            else:
                large = None
            if open_:
                yield links(fp[:open_], key[:open_])
            held = fp[open_:], key[open_:]
        if len(held[0]):
            yield links(*held)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def large_keys(members: DataFrame, full: int) -> DataFrame:
    """Keys that may hold more than ``full`` rows and a thousandth of all, by a sketch of fixed size; at most some thousands."""
    top = members.agg(F.expr("approx_top_k(key, 2000, 16000)").alias("top"), F.count(F.lit(1)).alias("n"))
    return top.select("n", F.explode("top").alias("t")).where((F.col("t.count") > full) & (F.col("t.count") * 1000 >= F.col("n"))).select(F.col("t.item").alias("key"))


def linked(distinct: DataFrame, full: int = FULL, first: int | None = None) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints (fp) that chains of at most REACH differing bits join."""
    todo, links = distinct, None
    for place in range(cut_for(distinct.count()) if first is None else first, len(CUTS)):
        members, last = bucketed(todo, CUTS[place]), place == len(CUTS) - 1
        passed = None
        if not last:
            large = written(large_keys(members, full), "large-keys")
            passed = members.join(F.broadcast(large), "key").select("fp")
            members = members.join(F.broadcast(large), "key", "left_anti")
        found = written(compared(members.select("fp", "key"), None if last else full), "bucket-links")
        some = found.where("b is not null")
        links = some if links is None else links.unionByName(some)
        if last:
            break
        todo = written(passed.unionByName(found.where("b is null").select(F.col("a").alias("fp"))).distinct(), "passed-on")
        if todo.isEmpty():
            break
    return links.distinct()


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: int = FULL) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id of the component) of every row."""
    marked = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    label = components(linked(distinct, full)).select(F.col("id").alias("fp"), "label")
    named = written(distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = written(spread_join(named, least, "label").select("fp", "component_id"), "components")
    return spread_join(marked, of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component."""
    return grouped(documents(spark, sf_dir))
