"""Document fingerprints from prefix polynomial hashes.

For every text two modular prefix arrays are built over its code points, P[i] = sum of c_j * B^j for j < i, modulo two
primes. Any span's value follows from two entries, so span equality costs O(1) and a longest common extension O(log n)
by binary search. A fingerprint is the length, the two whole-text values and a sketch: the ``KEEP`` smallest mixed
values of all spans of ``SPAN`` code points (a shorter text is one span). Likeness of two fingerprints is the Dice
coefficient of their span sets, estimated from the sketches' bottom-k overlap: 1 for equal texts, about a half for
texts that share a half.

``chain`` pairs each text with the following one by ascending id. Ids are cut at approximate quantiles into parts of
equal size; each part also gets a copy of the row that opens the next one, so that one shuffle of the texts suffices
and no task sees more than its parts.

Defined results: null and empty texts have an empty sketch, likeness 1 with each other and 0 with any other text. Rows
with equal ids follow each other in order of their text; null ids come first. A single document follows itself. An
empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, text_of

PRIMES, BASES = (2**31 - 1, 2**31 - 19), (911_382_323, 972_663_749)
SPAN, KEEP = 8, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """B^i and B^-i modulo a prime for as many i as asked for so far."""

    def __init__(self, base: int, prime: int):
        self.prime, self.steps = prime, (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.uint64) for _ in self.steps]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) <= n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, t * np.uint64(pow(s, m, self.prime)) % np.uint64(self.prime)]) for t, s in zip(self.tables, self.steps, strict=True)]
        return self.tables


POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


class Prefix:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for powers in POWERS:
            p, table = np.uint64(powers.prime), powers.upto(self.n + 1)[0]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * table[: self.n] % p) % p]))
        self.mixed = self._spans()

    def span(self, at: int, length: int) -> tuple[int, ...]:
        """The values of a span; equal spans have equal values wherever they lie."""
        return tuple((int(s[at + length]) - int(s[at])) * int(w.upto(at)[1][at]) % w.prime for s, w in zip(self.sums, POWERS, strict=True))

    def _spans(self) -> np.ndarray:
        """Mixed values of all spans of SPAN code points, by place."""
        if not self.n:
            return np.zeros(0, np.uint64)
        k, (s, w) = min(SPAN, self.n), (self.sums[0], POWERS[0])
        p = np.uint64(w.prime)
        value = (s[k:] + p - s[:-k]) % p * w.upto(self.n)[1][: self.n - k + 1] % p
        return mix(value * np.uint64(64) + np.uint64(k))

    def common(self, at: int, other: Prefix, other_at: int) -> int:
        """The length of the longest common extension of self from at and other from other_at."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.span(at, mid) == other.span(other_at, mid) else (low, mid - 1)
        return low


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    return x * _MIX


def smallest(parts: list[np.ndarray]) -> np.ndarray:
    """The KEEP smallest distinct values."""
    n = sum(map(len, parts))
    if n > 32 * KEEP:  # nearly always enough distinct values lie below this bound
        bound = np.uint64(int(2.0**64 * 8 * KEEP / n))
        low = np.unique(np.concatenate([x[x < bound] for x in parts]))
        if len(low) >= KEEP:
            return low[:KEEP]
    return np.unique(np.concatenate(parts))[:KEEP] if parts else np.zeros(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two span sets from their sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEEP]
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    j = float(both.mean())
    return 2 * j / (1 + j)


def written_out(n: int, values: tuple[int, ...], sketch: np.ndarray) -> str:
    """A fingerprint as text."""
    return f"{n:x}-{''.join(f'{v:08x}' for v in values)}-{sketch.astype('>u8').tobytes().hex()}"


def edit(a: Prefix, b: Prefix) -> tuple[str, tuple[int, ...], np.ndarray]:
    """a's last half replaced by b's first as many code points: the text, its values and its sketch, from both arrays."""
    half = a.n // 2
    keep, take = a.n - half, min(half, b.n)
    text = a.text[:keep] + b.text[:take]
    values = tuple((int(x[keep]) + int(y[take]) * int(w.upto(keep)[0][keep])) % w.prime for x, y, w in zip(a.sums, b.sums, POWERS, strict=True))
    if keep + take < 2 * SPAN or keep < SPAN or take < SPAN:
        return text, values, smallest([Prefix(text).mixed])
    seam = Prefix(text[keep - SPAN + 1 : keep + SPAN - 1]).mixed
    return text, values, smallest([a.mixed[: keep - SPAN + 1], seam, b.mixed[: take - SPAN + 1]])


def chain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, tail, id, text) in partitions; in each part, sorted by (tail, id, text), a row is followed by its next."""
    spark = df.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_col).isNull().alias("no_id"), text_of(text_col).alias("text"))
    cuts = F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)
    first, found = rows.agg(F.min("key"), cuts).head()
    bounds = np.unique(np.array(found or [], np.int64))
    bounds = bounds[bounds > (first if first is not None else 0)]

    @F.pandas_udf("array<long>")
    def parts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for key in batches:
            own = np.searchsorted(bounds, key.to_numpy(), side="right")
            opens = np.isin(key.to_numpy(), bounds)
            yield pd.Series([[p, p - 1] if o else [p, len(bounds)] if k == first else [p] for p, o, k in zip(own.tolist(), opens.tolist(), key.tolist(), strict=True)])

    dealt = rows.select("*", F.posexplode(parts_of("key")).alias("tail", "part"))
    return dealt.repartition("part").sortWithinPartitions("part", "tail", "key", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_next long"


def fingerprint_chain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its text with the next one's edit, and the likeness of both and of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = part = None  # last: (id, tail, Prefix, sketch)
        for batch in batches:
            out = []
            for p, tail, key, no_id, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if p != part:
                    part, last = p, None
                elif last and last[1]:  # only the first of the rows after the end is a next
                    continue
                now = Prefix(text)
                row = (None if no_id else key, tail, now, smallest([now.mixed]))
                if last:
                    doc, _, before, sketch = last
                    text, values, edited = edit(before, now)
                    out.append((doc, before.n, hashlib.sha256(text.encode()).hexdigest(), written_out(before.n, before.span(0, before.n), sketch), written_out(len(text), values, edited), likeness(sketch, edited), likeness(sketch, row[3]), before.common(0, now, 0)))
                last = row
            schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in RESULT.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return chain(df, id_col, text_col).select("part", "tail", "key", "no_id", "text").mapInArrow(run, RESULT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_chain(documents(spark, sf_dir))
