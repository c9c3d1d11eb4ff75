"""Phrase collocations: frequent phrases counted by double-array tries, level by level, all positions at once.

Words are counted first; a phrase can only be frequent if all its parts are, so texts are written once more as runs of the
ids of frequent words, and all later passes read these. A position is a candidate of k words where a frequent phrase of
k - 1 words starts and the next position starts one too (Apriori). Tasks name a candidate by the state of its first k - 1
words in the trie of frequent phrases and its last word, and send its count, capped at the least that is asked for, in
sorted blocks by shard; a shard adds the blocks up and keeps what reaches that least, which capping does not change. So
the candidates that are put into the next trie are few. At last there is one trie of all of them: numpy moves the
states of all positions on by one word, position arrays shrinking to those still alive; a task counts the
accepting states with bincount, and the tasks' counts are added up.

A trie is two arrays: from state s the digit d leads to base[s] + d if check[base[s] + d] is s. A word is ``DIGITS`` digits of
``BITS`` bits, so a state has at most 128 ways on. Frequent words are dealt to ``PARTS`` parts by hash, and the ids of a part
follow each other; phrases belong to the part of their first word. A task for each part numbers its words, builds its stretch
of the trie and names its phrases; these lie as files in the shared folder. A worker deals the positions of ``FLUSH`` words to
the parts of their words and walks one part's stretch after the other, mapped from its file, so it never holds a whole trie, however
many phrases there are. The driver sees the sizes of the parts, never a word, a phrase or a trie. Workers hold the frequent words, if
these are at most ``BOUND``, which is checked; otherwise, and if spark.checkpoint.dir is not a folder that all nodes mount, phrases
are counted by ordinary shuffles, as words are.

Defined results: null texts are empty and have no words; a null lang counts as ``und``. Repeated rows are counted each.
Equal scores are ordered by count and then by the phrase's UTF-8 bytes. Empty tables give no rows. Extra columns are
ignored, ids too.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.llm.common import documents, memory, scratch, slices, spread_join, text_of, written
from caselode.llm.lm import local_path, opened, publish
from caselode.llm.near_dedup import mix

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
#: Words that a worker may hold, and parts that words and phrases are dealt to.
BOUND, PARTS = 2**21, 64
DIGITS, BITS = 3, 7
#: Distinct words, and positions, that a task gathers before it sends counts on; words of text a shard is meant for.
WORDS, FLUSH, SHARD = 500_000, 2_000_000, 4_000_000

#: A-Z to a-z, piece ends to line feeds, tabs to spaces; 0xFF, which no UTF-8 text has, will mark piece ends.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_END = b"\xff"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with _END where a piece ends."""
    return text.translate(_FOLD).replace(b"\n", b" \xff ").split()


def texts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))


def plain_counts(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """lang, size, phrase (null: any) and f of all phrases of these sizes; tasks add up before the shuffle."""

    def run(batches):
        counts: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)

        def out():
            keys = [(lang, size, p, n) for (lang, size), c in counts.items() for p, n in c.items()]
            counts.clear()
            for at in range(0, len(keys), 50_000):
                lang, size, phrase, n = zip(*keys[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "f"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for size in sizes:
                    if size == 1:
                        found = Counter(words)
                        found.pop(_END, None)
                    else:
                        runs = zip(*(words[i:] for i in range(size)), strict=False)
                        found = Counter(b" ".join(r) for r in runs if _END not in r)
                    counts[lang, size].update(found)
                    counts[lang, size][None] += found.total()
            if sum(map(len, counts.values())) > WORDS:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, size int, phrase binary, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


class Vocabulary:
    """Where the frequent words lie; a part's words are sorted, and ids go up from part to part, from 1 on."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.total = folder, sum(sizes)
        self.starts = np.cumsum([1, *sizes])

    def table(self) -> pa.Table:
        """lang and phrase of all words in the order of their ids."""
        parts = [pa.ipc.open_file(pa.memory_map(f"{self.folder}/w-{p}")).read_all() for p in np.flatnonzero(np.diff(self.starts))]
        return pa.concat_tables(parts).combine_chunks()

    def ids(self) -> dict[str, dict[bytes, int]]:
        """Ids by language and word."""
        found: dict[str, dict[bytes, int]] = {}
        table = self.table()
        for i, (lang, word) in enumerate(zip(table["lang"].to_pylist(), table["phrase"].to_pylist(), strict=True), 1):
            found.setdefault(lang, {})[word] = i
        return found


def numbered(words: DataFrame, folder: str) -> Vocabulary:
    """The vocabulary of words (lang, phrase), written by parts."""

    def run(rows: pa.Table) -> pa.Table:
        part, rows = rows.column("part")[0].as_py(), rows.select(["lang", "phrase"]).sort_by([("lang", "ascending"), ("phrase", "ascending")])
        path = f"{folder}/w-{part}"
        with pa.OSFile(f"{path}.{os.getpid()}.part", "wb") as f, pa.ipc.new_file(f, rows.schema) as out:
            out.write_table(rows)
        os.replace(f"{path}.{os.getpid()}.part", path)
        return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([rows.num_rows], pa.int64())})

    dealt = words.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(PARTS)).alias("part"))
    sizes = dict(dealt.groupBy("part").applyInArrow(run, "part long, n long").collect())
    return Vocabulary(folder, [sizes.get(p, 0) for p in range(PARTS)])


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as runs of ids of frequent words, 0 between runs; runs of one word are left out."""

    def run(batches):
        known, none = memory((vocabulary.folder, "ids"), vocabulary.ids), {}
        for batch in slices(batches):
            parts = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = known.get(lang, none)
                words = words_of(text)
                parts += [np.fromiter((of.get(w, 0) for w in words), np.int32, len(words)), np.zeros(1, np.int32)]
            ids = np.concatenate([np.zeros(1, np.int32), *parts])
            alone = (ids[1:-1] != 0) & (ids[:-2] == 0) & (ids[2:] == 0) if len(ids) > 2 else np.zeros(0, bool)
            ids[1:-1][alone] = 0
            ids = ids[1:][(ids[1:] != 0) | (ids[:-1] != 0)]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])

    return rows.mapInArrow(run, "ids binary")


class Trie:
    """A double-array trie of phrases of word ids. ``of`` gives each phrase's state; state 1 is the root, 0 is nowhere."""

    def __init__(self, phrases: list[np.ndarray]):
        """phrases: matrices of word ids, one for each length; what they are prefixes of shares their states."""
        self.base, self.check = np.zeros(2 << BITS, np.int64), np.full(2 << BITS, -1, np.int64)
        self.check[:2] = -2  # taken
        self.used = len(self.base)
        self.draw = np.random.default_rng(1)
        digits = [np.stack([m >> (BITS * (DIGITS - 1 - d)) & ((1 << BITS) - 1) for m in x.T for d in range(DIGITS)], axis=1) if len(x) else np.zeros((0, DIGITS), np.int64) for x in phrases]
        at = [np.ones(len(x), np.int64) for x in digits]
        for depth in range(max((x.shape[1] for x in digits), default=0)):
            some = [i for i, x in enumerate(digits) if x.shape[1] > depth and len(x)]
            edge = np.concatenate([at[i] << BITS | digits[i][:, depth] for i in some])
            edges, inverse = np.unique(edge, return_inverse=True)
            states = self._placed(edges >> BITS, edges & ((1 << BITS) - 1))[inverse]
            for i, part in zip(some, np.split(states, np.cumsum([len(at[i]) for i in some])[:-1]), strict=True):
                at[i] = part
        self.of = at

    def _room(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1)])

    def _placed(self, parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """New states for edges (sorted by parent): crowded parents get a stretch of their own, the others try free places at random."""
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        size, owner = np.diff(np.append(first, len(parent))), parent[first]
        group = np.repeat(np.arange(len(first)), size)
        base = np.zeros(len(first), np.int64)
        crowded = size > 1 << (BITS - 3)
        start = self.used
        base[crowded] = start + np.arange(crowded.sum()) * (1 << BITS)
        low = start + int(crowded.sum()) * (1 << BITS)
        span = 4 * int(size[~crowded].sum()) + (1 << BITS)
        self.used = low + span + (1 << BITS)
        self._room(self.used)
        todo = ~crowded
        while todo.any():
            base[todo] = low + self.draw.integers(0, span, todo.sum())
            edges = np.flatnonzero(todo[group])
            slot = base[group[edges]] + digit[edges]
            ahead = np.full(len(edges), False)
            ahead[np.unique(slot, return_index=True)[1]] = True  # of two that want a place, the first
            bad = np.zeros(len(first), bool)
            bad[group[edges[~ahead | (self.check[slot] != -1)]]] = True
            won = todo & ~bad
            good = won[group[edges]]
            self.check[slot[good]] = parent[edges[good]]
            todo &= bad
        slot = base[group] + digit
        self.check[slot] = parent
        self.base[owner] = base
        return slot

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.base[: self.used].astype(np.int32), self.check[: self.used].astype(np.int32)


def moved(base: np.ndarray, check: np.ndarray, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states after one more word each; 0 where there is no way."""
    for d in range(DIGITS):
        to = base[states] + (words >> (BITS * (DIGITS - 1 - d)) & ((1 << BITS) - 1))
        states = np.where(check[to] == states, to, 0)
    return states


def walked(base: np.ndarray, check: np.ndarray, ids: np.ndarray, levels: int, at: np.ndarray | None = None):
    """For each number of words up to levels: the positions (of those in at, if given) from which so many lead to a state, and the states."""
    at = np.flatnonzero(ids) if at is None else at
    states = np.ones(len(at), np.int32)
    for level in range(levels):
        inside = at + level < len(ids)
        at, states = at[inside], states[inside]
        word = ids[at + level]
        states = np.where(word > 0, moved(base, check, states, word), 0)
        alive = states > 0
        at, states = at[alive], states[alive]
        yield at, states


def joined(batches):
    """Runs of ids, FLUSH positions or more at a time; each ends with a 0."""
    parts, n = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            parts.append(np.frombuffer(raw, np.int32))
            n += len(parts[-1])
            if n >= FLUSH:
                yield np.concatenate(parts)
                parts, n = [], 0
    if parts:
        yield np.concatenate(parts)


def summed(keys: np.ndarray, counts: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, at most ``most`` each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    total = np.add.reduceat(counts, starts) if len(starts) else counts[:0]
    return keys[starts], np.minimum(total, most) if most else total


def sent(keys: np.ndarray, counts: np.ndarray, shards: int):
    """A block of keys and counts for each shard."""
    shard = (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[s] : cuts[s + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([int(s)]), *[pa.array([x[mine].astype(np.int64).tobytes()], pa.binary()) for x in (keys, counts)]], BLOCK.split())


BLOCK, BLOCK_SCHEMA = "shard keys counts", "shard long, keys binary, counts binary"


class Tries:
    """Where the stretches of a trie lie, and where each begins once they are put one behind the other."""

    def __init__(self, folder: str, name: str, starts: np.ndarray, slots: list[int]):
        """starts: the first word id of each part. slots: lengths of the parts' arrays, 0 where a part has no phrase."""
        self.folder, self.name, self.starts = folder, name, starts
        self.begins = np.cumsum([0, *slots])

    def walked(self, ids: np.ndarray, levels: int):
        """For each part: itself, and ``walked`` from the positions of its words. States are those of its own stretch."""
        at = np.flatnonzero(ids)
        part = part_of(self.starts, ids[at]).astype(np.int16)
        at = at[np.argsort(part, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=PARTS))])
        for p in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.begins) > 0)):
            base, check = (np.asarray(opened(f"{self.folder}/{self.name}-{p}.{suffix}", "<i4")) for suffix in ("base", "check"))
            yield p, list(walked(base, check, ids, levels, at[cuts[p] : cuts[p + 1]]))

    def places(self, part: int, states: np.ndarray) -> np.ndarray:
        """Which of a part's phrases end in these states."""
        of = opened(f"{self.folder}/{self.name}-{part}.of", "<i4")
        by_state = np.argsort(of)
        return by_state[np.searchsorted(of, states - self.begins[part], sorter=by_state)]


def part_of(starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, x, side="right") - 1


def phrases_of(folder: str, part: int, size: int) -> np.ndarray:
    """A part's phrases of so many words, as rows of word ids."""
    return opened(f"{folder}/p{size}-{part}", "<i4").reshape(-1, size)


def published(folder: str, name: str, part: int, phrases: list[np.ndarray]) -> int:
    """Writes the stretch of a trie for these phrases of a part and tells its length; the same phrases give the same arrays."""
    trie = Trie(phrases)
    for suffix, array in zip(("base", "check", "of"), (*trie.arrays(), np.concatenate(trie.of)), strict=True):
        publish(f"{folder}/{name}-{part}.{suffix}", array.astype("<i4"))
    return trie.used


def added(blocks: DataFrame, least: int, starts: np.ndarray, shift: int = 0) -> DataFrame:
    """part, key and f of the keys whose counts in all blocks come to ``least`` or more; a shard has a bounded part of the text's positions.
    A key's part is where key >> shift lies between starts."""

    def run(rows: pa.Table) -> pa.Table:
        keys, counts = summed(*[np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("keys", "counts")])
        keys, counts = keys[counts >= least], counts[counts >= least]
        return pa.table({"part": part_of(starts, keys >> shift), "key": keys, "f": counts})

    return blocks.groupBy("shard").applyInArrow(run, "part long, key long, f long")


def capped(coded: DataFrame, vocabulary: Vocabulary, tries: Tries | None, size: int, least: int, shards: int) -> DataFrame:
    """part and key: state (of the first size - 1 words, the word itself if there is no trie) and last word of the candidates of
    size words that occur ``least`` times or more."""

    def run(batches):
        for ids in joined(batches):
            states = np.zeros(len(ids), np.int64)
            if tries is None:
                states[:] = ids
            else:
                for part, levels in tries.walked(ids, size - 1):
                    at, own = levels[-1]
                    states[at] = own + tries.begins[part]
            both = np.flatnonzero((states[:-1] > 0) & (states[1:] > 0))  # the next position starts a frequent phrase too
            keys, counts = np.unique(states[both] << (DIGITS * BITS) | ids[both + size - 1], return_counts=True)
            yield from sent(keys, np.minimum(counts, least), shards)

    starts = tries.begins if tries else vocabulary.starts
    return added(coded.mapInArrow(run, BLOCK_SCHEMA), least, starts, DIGITS * BITS).select("part", "key")


def extended(keys: DataFrame, vocabulary: Vocabulary, tries: Tries | None, size: int) -> Tries:
    """Writes the phrases of size words that keys name, and the trie of them, by parts."""
    folder, name = vocabulary.folder, f"t{size}"

    def run(rows: pa.Table) -> pa.Table:
        part, named = rows.column("part")[0].as_py(), np.sort(rows.column("key").to_numpy())
        state, last = named >> (DIGITS * BITS), named & ((1 << DIGITS * BITS) - 1)
        begins = phrases_of(folder, part, size - 1)[tries.places(part, state)] if tries else state[:, None]
        phrases = np.column_stack([begins, last])
        publish(f"{folder}/p{size}-{part}", phrases.astype("<i4"))
        return pa.table({"part": pa.array([part], pa.int64()), "slots": pa.array([published(folder, name, part, [phrases]) if size < LONGEST else 0], pa.int64())})

    slots = dict(keys.groupBy("part").applyInArrow(run, "part long, slots long").collect())
    return Tries(folder, name, vocabulary.starts, [slots.get(p, 0) for p in range(PARTS)])


def whole(spark: SparkSession, vocabulary: Vocabulary, longest: int) -> Tries:
    """The trie of all phrases of 2 to longest words."""
    folder = vocabulary.folder

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                phrases = [phrases_of(folder, part, size).astype(np.int64) for size in range(2, longest + 1)]
                slots = published(folder, "all", part, phrases) if len(phrases[0]) else 0
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([slots], pa.int64())], ["part", "slots"])

    slots = dict(spark.range(0, PARTS, 1, PARTS // 4).mapInArrow(run, "part long, slots long").collect())
    return Tries(folder, "all", vocabulary.starts, [slots[p] for p in range(PARTS)])


def trie_counts(coded: DataFrame, vocabulary: Vocabulary, tries: Tries, longest: int, shards: int) -> DataFrame:
    """lang, size, phrase and f of all phrases of the trie."""
    folder = vocabulary.folder

    def count(batches):
        for ids in joined(batches):
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part, levels in tries.walked(ids, longest):
                total = np.bincount(np.concatenate([states for _, states in levels[1:]]))
                some = np.flatnonzero(total)
                keys.append(some + tries.begins[part])
                counts.append(total[some])
            yield from sent(np.concatenate(keys), np.concatenate(counts), shards)

    def name(rows: pa.Table) -> pa.Table:
        part, table = rows.column("part")[0].as_py(), memory((folder, "words"), vocabulary.table)
        place, f, out = tries.places(part, rows.column("key").to_numpy()), rows.column("f").to_numpy(), []
        for size in range(2, longest + 1):
            phrases = phrases_of(folder, part, size)
            mine = (place >= 0) & (place < len(phrases))
            ids = phrases[place[mine]] - 1
            words = [table["phrase"].take(pa.array(x)).combine_chunks() for x in ids.T]
            columns = {"lang": table["lang"].take(pa.array(ids[:, 0])), "size": pa.array(np.full(len(ids), size, np.int32)), "phrase": pc.binary_join_element_wise(*words, b" "), "f": f[mine]}
            out.append(pa.table(columns))
            place = place - len(phrases)
        return pa.concat_tables(out)

    found = added(coded.mapInArrow(count, BLOCK_SCHEMA), 1, tries.begins)
    return found.groupBy("part").applyInArrow(name, "lang string, size int, phrase binary, f long")


def mapped_folder(spark: SparkSession) -> str | None:
    """A new folder that driver and workers open by its path; None if the shared folder is no such."""
    try:
        folder = local_path(scratch(spark, "tries"))
    except ValueError:
        return None
    os.makedirs(folder)
    return folder


def counted(df: DataFrame, lang_col: str, text_col: str, least: int = LEAST, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """lang, size, phrase (binary) and f of all phrases of 1 to LONGEST words with f of ``least`` or more; and lang and n, its words."""
    rows = texts(df, lang_col, text_col)
    singles = written(plain_counts(rows, (1,)).where((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    totals, words = singles.where("phrase is null").select("lang", F.col("f").alias("n")), singles.where("phrase is not null")

    if words.count() >= bound or not (folder := mapped_folder(df.sparkSession)):
        rest = plain_counts(rows, tuple(range(2, LONGEST + 1))).where((F.col("f") >= least) & F.col("phrase").isNotNull())
        return words.unionByName(written(rest, "phrases")), totals
    vocabulary = numbered(words, folder)
    if not vocabulary.total:
        return words, totals
    coded = written(encoded(rows, vocabulary), "encoded")
    shards = max(16, -(-(totals.agg(F.sum("n")).head()[0] or 0) // SHARD))
    longest, tries = 1, None
    for size in range(2, LONGEST + 1):
        keys = written(capped(coded, vocabulary, tries, size, least, shards), "candidates")
        if keys.isEmpty():
            break
        tries, longest = extended(keys, vocabulary, tries, size), size
    if longest < 2:
        return words, totals
    found = trie_counts(coded, vocabulary, whole(df.sparkSession, vocabulary, longest), longest, shards)
    return words.unionByName(written(found, "phrases")), totals


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, bound: int = BOUND) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of 2 to LONGEST words."""
    phrases, totals = counted(df, lang_col, text_col, least, bound)
    key = lambda lang, phrase: F.concat(F.encode(lang, "UTF-8"), F.unhex(F.lit("00FF")), phrase)
    named = phrases.select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "f", key(F.col("lang"), F.col("phrase")).alias("key"))
    f = written(named, "phrase-counts")
    many = f.where("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, length: key(F.col("lang"), F.array_join(F.slice("w", start, length), " ").cast("binary"))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = written(many.select("key", "lang", "phrase", "w", "size", F.col("f").alias("a"), cut).select("key", "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")), "cuts")
    left = written(spread_join(cuts, f.select(F.col("key").alias("first"), F.col("f").alias("l")), "first"), "cuts")
    both = spread_join(left, f.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = both.withColumns({"wide_a": wide("a") * 2_000_000, "wide_parts": wide("l") + wide("r")}).withColumn("score", F.expr("wide_a div wide_parts"))
    worst = scored.groupBy("key", "lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = [(start, length) for length in range(2, LONGEST) for start in range(1, LONGEST - length + 2)]
    inside = F.explode(F.array_compact(F.array(*[F.when(F.col("size") > max(length, start + length - 2), part(F.lit(start), F.lit(length))) for start, length in spans]))).alias("key")
    longer = many.where("size > 2").select(F.col("f"), inside).groupBy("key").agg(F.max("f").alias("longer"))
    kept = worst.join(longer, "key", "left").where(F.coalesce(wide("longer") * 100 < wide("a") * INSIDE, F.lit(True)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    placed = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return placed.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2,000 phrases of documents."""
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM words, range(1, 5) AS s(size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
many AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM many, range(1, 4) AS c(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = first JOIN f r ON r.lang = c.lang AND r.phrase = rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM many, range(1, 4) AS b(i), range(2, 4) AS c(k) WHERE k < size AND i + k - 1 <= size),
longer AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
