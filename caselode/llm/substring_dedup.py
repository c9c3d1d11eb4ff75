"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of the last ``REACH`` bytes is a sum of shifted table entries, so a cut depends on the bytes just before
it and on nothing else: after an insertion the cuts fall into step again. A cut is made where the five highest bits are
zero and the chunk has ``SHORTEST`` bytes; a chunk that would pass ``LONGEST`` bytes is cut at its last place with three
zero bits instead. Cuts never split a code point. Chunks meet by their 128-bit digest in a map-side combined aggregate,
which names the first place of each: the smallest document, and its first occurrence there. That place keeps the chunk;
every other place of it, in a later document or later in the same one, is a copy. Where a stretch of copies comes from
several documents, a copy is also tried against the documents of its ``NEAR`` neighbours on both sides, and counts as
theirs where the chunk stands at the right place there. Copies that follow one another in both texts are a run; a run
with ``WORDS`` words or more that lies in no longer one is a repeat, and first_doc_id holds the same text at first_start.
A passage is found by its whole chunks; what is left of it at either end, short of a chunk's cut, is not reported.

Defined results: null and empty texts have no chunks; rows without an id are neither searched nor compared; rows with
the same id count as one document, so repeated rows do not repeat each other, and where their texts differ only the one
with the smallest hash is searched and compared. Of nested runs the longest counts, of equal ones that of the smallest
document and place; runs from different documents may overlap. A passage shorter than a chunk that is said over and over
is no repeat. An empty table has no repeats. Extra columns are ignored; ``without_repeats`` keeps them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.llm.common import HOT_KEY, documents, fresh, slices, text_of, written

REACH, SHORTEST, LONGEST, WORDS = 16, 16, 64, 15
#: Copies so many chunks away lend their document.
NEAR = 8
GEAR = np.random.default_rng(20_240_601).integers(0, 2**64, 256, np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of GEAR[b] << distance over the last REACH bytes, by doubling."""
    h, m = GEAR[data], 1
    while m < REACH:
        shifted = np.zeros_like(h)
        shifted[m:] = h[:-m] << np.uint64(m) if len(h) > m else 0
        h, m = h + shifted, 2 * m
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, the last one at their end."""
    n = len(data)
    h = gear(data)
    whole = np.ones(n, bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    weak = np.flatnonzero((h >> np.uint64(61) == 0) & whole)
    strong = h[weak] >> np.uint64(59) == 0
    ends, last, backup = [], 0, 0

    def force(p):
        nonlocal last, backup
        while p - last > LONGEST:
            cut = backup if backup > last else last + LONGEST
            while cut < n and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= p:
                break
            ends.append(cut)
            last = cut

    for p, hard in zip((weak + 1).tolist(), strong.tolist(), strict=True):
        force(p)
        if p - last >= SHORTEST:
            if hard:
                ends.append(p)
                last = p
            else:
                backup = p
    force(n)
    if n > last:
        ends.append(n)
    return ends


def other_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and lo, the smallest hash, of the ids that have different texts. Written first, few rows let a join leave the texts where they are."""
    hashed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    return hashed.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("id", "lo")


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hi, lo (digest), doc, start, length (code points), words (begun in it) and at, the digest's first start in the text, of every chunk."""

    def run(batches):
        for batch in slices(batches):
            columns = [[] for _ in range(7)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                if not len(data):
                    continue
                ends = cuts(data)
                starts = [0, *ends[:-1]]
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~space
                begins[1:] &= space[:-1]
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])[[0, *ends]]
                places = upto((data & 0xC0) != 0x80)
                digests = [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)]
                first = {}
                at = [first.setdefault(d, p) for d, p in zip(digests, places[:-1].tolist(), strict=True)]
                halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)
                for column, values in zip(columns, (halves[:, 0], halves[:, 1], np.full(len(ends), key), places[:-1], np.diff(places), np.diff(upto(begins)), at), strict=True):
                    column.append(np.asarray(values, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in columns], ["hi", "lo", "doc", "start", "length", "words", "at"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    others = written(other_texts(df, id_col, text_col), "others")
    single = rows.join(others, (F.col("doc") == F.col("id")) & (F.xxhash64("text") != F.col("lo")), "left_anti")
    return single.mapInArrow(run, "hi long, lo long, doc long, start long, length long, words long, at long")


def consecutive(rows: DataFrame, keys: list[str]):
    """The same number for rows of the same keys that follow one another without a gap."""
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("run", F.col("start") - F.coalesce(F.sum("length").over(before), F.lit(0)))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Repeated spans: id, start, length (code points), n_words, n_chunks, first_doc_id and first_start, where the passage stays."""
    key = ["hi", "lo"]
    every = written(chunks(df, id_col, text_col), "chunks")
    met = every.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("at", "doc").alias("first_start"), F.max(F.col("at") < F.col("start")).alias("again"), F.count(F.lit(1)).alias("n"))
    shared = written(met.where("first < last or again").select(*key, "first", "first_start", "n"), "shared")
    hot = F.broadcast(shared.where(F.col("n") >= max(2, every.count() * HOT_KEY)))
    cold = every.join(hot.select(*key), key, "left_anti").join(shared.hint("merge"), key)
    places = cold.unionByName(every.join(hot, key)).select(*key, "doc", "start", "length", "words", "first", "first_start")
    places = written(places.repartition("doc").distinct(), "places")

    copies = consecutive(places.where("first < doc or first_start < start"), ["doc"]).withColumn("shift", F.col("start") - F.col("first_start"))
    stretch = Window.partitionBy("doc", "run")
    around = stretch.orderBy("start").rowsBetween(-NEAR, NEAR)
    long = copies.withColumn("all_words", F.sum("words").over(stretch)).where(F.col("all_words") >= words)
    own = written(long.withColumn("near", F.collect_set(F.struct("first", "shift")).over(around)).drop("run", "all_words"), "copies")
    lent = own.where(F.size("near") > 1).withColumn("of", F.explode("near")).where("of.first <> first or of.shift <> shift")
    lent = lent.select(*key, "doc", "start", "length", "words", F.col("of.first").alias("first"), F.col("of.shift").alias("shift"))
    holds = places.select(*key, F.col("doc").alias("first"), F.col("start").alias("first_start"))
    held = lent.withColumn("first_start", F.col("start") - F.col("shift")).join(holds.hint("merge"), [*key, "first", "first_start"], "left_semi")
    columns = ["doc", "start", "length", "words", "first", "shift"]
    runs = consecutive(own.select(*columns).unionByName(held.select(*columns)), ["doc", "first", "shift"])
    whole = runs.groupBy("doc", "first", "shift", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"))
    ahead = Window.partitionBy("doc").orderBy("start", F.desc("length"), "first", F.desc("shift")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("length")).over(ahead), F.lit(0))
    out = whole.where(F.col("n_words") >= words).withColumn("reached", reached).where("start + length > reached")
    return out.select(F.col("doc").alias(id_col), "start", "length", "n_words", "n_chunks", F.col("first").alias("first_doc_id"), (F.col("start") - F.col("shift")).alias("first_start"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of df, the repeated spans cut out of their texts; a row whose text was not searched stays as it is."""
    own, key, other, hashed = fresh(df, "own_runs"), fresh(df, "own_doc"), fresh(df, "other_doc"), fresh(df, "other_hash")
    per = repeats(df, id_col, text_col, words).groupBy(F.col(id_col).alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(own))
    others = written(other_texts(df, id_col, text_col), "others").select(F.col("id").alias(other), F.col("lo").alias(hashed))
    text = F.col(text_col)
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    keep = lambda acc, x: F.struct(
        F.concat(acc.out, piece(acc.at, x.start)).alias("out"), F.greatest(acc.at, x.start + x.length).alias("at")
    )
    cut = F.aggregate(own, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), keep, lambda a: F.concat(a.out, piece(a.at, F.length(text))))
    joined = df.join(per, F.col(id_col) == F.col(key), "left").join(others, F.col(id_col) == F.col(other), "left")
    searched = F.col(own).isNotNull() & (F.col(hashed).isNull() | (F.col(hashed) == F.xxhash64(text_of(text_col))))
    return joined.withColumn(text_col, F.when(searched, cut).otherwise(text)).select(*df.columns)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that a document with a smaller id, or the same one before, has as well."""
    return repeats(documents(spark, sf_dir))
