"""Packing of tokenised documents into fixed-length training sequences.

Bounded-space online packing: every task keeps ``windows`` open windows. A document's ids are cut into full sequences
and a remainder; the remainder goes where it fits best, and if it fits nowhere the fullest window is emitted and a new
one opened. What is still open when a task ends (at most ``windows`` windows) is merged in a second step: leftovers of
``GROUP`` neighbouring tasks are laid end to end and cut at the capacity, so that only the last sequence of each group
needs padding. A task holds its open windows and one document, whatever the size of the input.

Defined results: null and empty texts are one end id; null ids are carried along; a repeated row is packed again; an
empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, memory, slices, text_of, written

CAPACITY, END, WINDOWS = 2048, 1, 32
#: So many neighbouring tasks have their leftovers merged together.
GROUP = 16
#: A generation of words, or of their units, whose ids a worker remembers; it remembers two.
REMEMBERED = 500_000

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, task long, ids binary"


#: Words of printable ASCII and Latin-1 only: no normalisation joins or changes their letters but lower case.
PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+")
#: The tokenizer's own split of a word, within which its merges stay (fixed by the vocabulary file).
UNITS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: The model's letter for each byte: printable Latin-1 stands for itself, the others are numbered from 256 on.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordIds:
    """Ids of whole texts by a tokenizer whose words never join across ASCII white space; remembers words and their units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.units = Generations(self._word), Generations(self._unit)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids = self.words.__getitem__
        # a special token's string is found before words are
        return [self._encode(t) if "<|" in t else b"".join(map(ids, t.encode().split())) for t in texts]

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only
            return self.units[word.lower()]
        head = word[:-1]
        if head.isalpha() and 33 <= word[-1] <= 126 and not word[-1:].isdigit():
            return self.units[head.lower()] + self.units[word[-1:]]
        if PLAIN.fullmatch(word):
            return b"".join([self.units[u.encode()] for u in UNITS.findall(word.decode().lower())])
        return self._encode(word.decode())

    def _unit(self, unit: bytes) -> bytes:
        letters = unit.decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Generations(dict):
    """Values by key in two generations, made where missing: a full one becomes the old one, from which keys in use come back."""

    def __init__(self, make):
        self.old, self.make = {}, make

    def __missing__(self, key: bytes) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = self.copy()
            self.clear()
        self[key] = found
        return found


def word_ids(path: str) -> WordIds:
    """One for all tasks that a worker runs."""
    return memory(("ids", path), lambda: WordIds(path))


def _batches(rows: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _schema() -> pa.Schema:
    return pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in PIECE.split(", "))])


def pack(
    df: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    windows: int = WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    derive: dict[str, Column] | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    derive: further columns, computed from these; with keep_ids=False the ids are dropped once they are derived.
    """
    size, end_bytes = 4 * capacity, end.to_bytes(4, "little")

    def place(batches):
        schema, task = _schema(), TaskContext.get().partitionId()
        ids_of, open_, closed = word_ids(tokenizer), [], 0  # open_: [free bytes, pieces]

        def close(pieces):
            nonlocal closed
            closed, at = closed + 1, 0
            for doc, start, total, ids in pieces:
                yield (doc, start, len(ids) // 4, total, (task << 32) + closed - 1, at, None, ids)
                at += len(ids) // 4

        for batch in slices(batches):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                ids += end_bytes
                total = len(ids) // 4
                whole = len(ids) - len(ids) % size
                for at in range(0, whole, size):
                    out += close([(doc, at // 4, total, ids[at : at + size])])
                if rest := ids[whole:]:
                    piece = (doc, whole // 4, total, rest)
                    best = min((w for w in open_ if w[0] >= len(rest)), key=lambda w: w[0], default=None)
                    if best is None:
                        if len(open_) == windows:
                            open_.remove(fullest := min(open_, key=lambda w: w[0]))
                            out += close(fullest[1])
                        open_.append(best := [size, []])
                    best[0] -= len(rest)
                    best[1].append(piece)
                    if not best[0]:
                        open_.remove(best)
                        out += close(best[1])
            yield _batches(out, schema)
        yield _batches([(d, s, len(i) // 4, t, None, None, task, i) for _, pieces in open_ for d, s, t, i in pieces], schema)

    def merge(batches):
        schema, group, number, at = _schema(), None, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["task"] // GROUP != group:
                    group, number, at = row["task"] // GROUP, 0, 0
                ids, start = row["ids"], row["start"]
                while ids:
                    part, ids = ids[: size - 4 * at], ids[size - 4 * at :]
                    out.append((row["doc_id"], start, len(part) // 4, row["doc_tokens"], (1 << 62) + (group << 32) + number, at, None, part))
                    start, at = start + len(part) // 4, at + len(part) // 4
                    if at == capacity:
                        number, at = number + 1, 0
            yield _batches(out, schema)

    derive = derive or {}
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    placed = texts.mapInArrow(place, PIECE).withColumns(derive)
    if not keep_ids:
        placed = placed.withColumn("ids", F.when(F.col("task").isNotNull(), F.col("ids")))
    placed = written(placed, "windows")
    left = placed.where("task is not null").select(*[x.split()[0] for x in PIECE.split(", ")])
    merged = left.repartition(F.floor(F.col("task") / GROUP)).sortWithinPartitions("task", "doc_id", "start").mapInArrow(merge, PIECE).withColumns(derive)
    out = placed.where("task is null").unionByName(merged).drop("task")
    return out if keep_ids else out.drop("ids")


def padding(lengths: Column, capacity: int = CAPACITY) -> Column:
    """Padding of a sequence of that length: up to the capacity, none at a power of two."""
    return F.when(F.bit_count(lengths) == 1, 0).otherwise(capacity - lengths)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with the CRC-32 of its ids."""
    return packed_pieces(documents(spark, sf_dir))


def packed_pieces(docs: DataFrame) -> DataFrame:
    out = pack(docs, word_tokenizer(), derive={"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
