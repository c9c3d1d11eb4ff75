"""Ranked lexical search of many queries at once, their common subexpressions evaluated once.

Items are sets of terms, and many share some. In a block of items the sets, sorted by how many items hold a term, are
mined for shared parts: the adjacent pairs that two items or more hold become nodes of their own, most shared first, and
so on over the new nodes, until no pair is shared. What comes out is a directed graph: terms at the bottom, shared sets
above them, items on top, each a short list of nodes. A task then takes documents in slices: the terms' parts of the
scores are put into accumulators, one row a node and one column a document; a shared set's accumulators are made once,
level by level, as the sum of its two nodes, and serve all items above it.

Tasks keep the best ``TOP`` documents of each item; these, not the documents, are shuffled and ranked. Corpus counts (N, L,
df) are taken over all documents beforehand, from postings that are written once for each block of items. A block has at
most ``BLOCK_TERMS`` pairs of item and term unless a single item has more, which is checked; more items mean more blocks.

Defined results: null and empty texts have no terms: such documents do not count in N, such items have no result.
Items of one id are one item with the terms of all; a null item id is an id. Rows without a document id count in N, L
and df and are never returned. Repeated rows are documents of their own. Equal scores are ranked by id. Empty tables give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.llm.common import documents, slices, text_of, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Pairs of item and term in a block of items, and numbers that the accumulators of a slice hold.
BLOCK_TERMS, CELLS = 200_000, 4_000_000
#: Parts that the tasks' best documents of an item are ranked in before they meet.
PARTS = 32

#: A-Z to a-z, all other ASCII but letters and digits to spaces; bytes above stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item and term, each pair once."""
    folded = F.translate(text_of(text_col), string.ascii_uppercase, string.ascii_lowercase)
    return items.select(F.col(id_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), 0))).alias("term")).distinct()


def blocks(pairs: DataFrame, limit: int) -> DataFrame:
    """pairs with a block for each item: blocks of at most limit pairs, or of a single item."""
    sizes = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    n = max(1, -(-2 * (sizes.agg(F.sum("n")).head()[0] or 0) // limit))
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n)) if n > 1 else F.lit(0).cast("long")
        full = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).where((F.col("n") > limit) & (F.col("items") > 1))
        if n == 1 or full.isEmpty():
            return pairs.withColumn("block", block)
        n *= 2


@dataclass
class Sharing:
    """What a block of items is computed by. Nodes 0 to terms - 1 are terms; node i above them is left[i] + right[i]."""

    terms: list[bytes]
    left: np.ndarray
    right: np.ndarray
    levels: list[np.ndarray]
    items: list
    parts: np.ndarray
    starts: np.ndarray


def shared(sets: dict) -> Sharing:
    """The sharing graph of items: sets maps each item to its terms."""
    held = Counter(t for terms in sets.values() for t in terms)
    order = sorted(held, key=lambda t: (-held[t], t))
    place = {t: i for i, t in enumerate(order)}
    lists = [sorted(place[t] for t in terms) for terms in sets.values()]
    left, right, level = [], [], [0] * len(order)
    while True:
        pairs = Counter(p for x in lists for p in zip(x, x[1:], strict=False))
        fresh: dict[tuple[int, int], int] = {}
        changed = False
        for i, x in enumerate(lists):
            out, at = [], 0
            while at < len(x):
                pair = tuple(x[at : at + 2])
                # of two pairs that overlap, the one that more items hold
                if len(pair) == 2 and pairs[pair] > 1 and (at + 2 >= len(x) or pairs[pair] >= pairs[(x[at + 1], x[at + 2])]):
                    if pair not in fresh:
                        fresh[pair] = len(level)
                        left.append(pair[0])
                        right.append(pair[1])
                        level.append(1 + max(level[pair[0]], level[pair[1]]))
                    out.append(fresh[pair])
                    at += 2
                    changed = True
                else:
                    out.append(x[at])
                    at += 1
            lists[i] = out
        if not changed:
            break
    level = np.array(level, np.int64)
    levels = [np.flatnonzero(level == n) for n in range(1, level.max(initial=0) + 1)]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    return Sharing([t.encode() for t in order], np.array(left, np.int64), np.array(right, np.int64), levels, list(sets), np.concatenate([np.array(x, np.int64) for x in lists]), starts)


def postings(docs: DataFrame, graph: Sharing, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), and the places and counts of those terms that items ask for; none for texts without terms."""
    place = {t: i for i, t in enumerate(graph.terms)}

    def run(batches):
        for batch in slices(batches):
            ids, n, terms, counts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.translate(_FOLD).split()
                if words:
                    found = Counter(words)
                    asked = [(place[w], c) for w, c in found.items() if w in place]
                    ids.append(key)
                    n.append(len(words))
                    terms.append([p for p, _ in asked])
                    counts.append([c for _, c in asked])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2n + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def accumulated(graph: Sharing, term: np.ndarray, column: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Scores, a row for each item and a column for each document: parts go into the terms' rows, shared sets are added up once."""
    rows = np.zeros((len(graph.terms) + len(graph.left), width), np.int64)
    rows[term, column] = part
    base = len(graph.terms)
    for level in graph.levels:
        rows[level] = rows[graph.left[level - base]] + rows[graph.right[level - base]]
    return np.add.reduceat(rows[graph.parts], graph.starts, axis=0)


class Best:
    """The best documents of each item that a task has seen, at most ``top`` an item once ``settle`` has run."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.least[:, None])
        self.waiting.append((item, ids[column], scores[item, column]))
        if sum(len(x[0]) for x in self.waiting) > 2 * self.top * len(self.least):
            self.settle()

    def settle(self) -> None:
        item, key, score = (np.concatenate(x) for x in zip((self.item, self.id, self.score), *self.waiting, strict=True))
        order = np.lexsort((key, -score, item))
        item, key, score = item[order], key[order], score[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        full = place == self.top - 1
        self.least[item[full]] = score[full]  # an equal score with a smaller id may still come
        keep = place < self.top
        self.item, self.id, self.score, self.waiting = item[keep], key[keep], score[keep], []


def best_of_tasks(posted: DataFrame, graph: Sharing, w: np.ndarray, n: int, total: int, top: int, cells: int) -> DataFrame:
    """place (of the item), id and score of the best documents of each task."""
    width = max(1, cells // (len(graph.terms) + len(graph.left)))

    def run(batches):
        best = Best(len(graph.items), top)
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                long = part.column(1).to_numpy()
                if 50 * n * int(long.max()) < 2**63:
                    m = 50 + 50 * n * long // total
                else:
                    m = np.array([50 + 50 * n * int(x) // total for x in long])
                ids, lists = part.column(0).to_numpy(), part.column(2)
                column = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
                term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[column]))
                best.add(accumulated(graph, term, column, value, len(ids)), ids)
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.id), pa.array(best.score)], ["place", "id", "score"])

    return posted.where("id is not null and size(terms) > 0").mapInArrow(run, "place int, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS, cells: int = CELLS) -> DataFrame:
    """item, rank (from 1), id and score of the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    pairs = written(blocks(written(item_terms(items, item_id, item_text), "item-terms"), block_terms), "item-blocks")
    kind = dict(pairs.dtypes)["item"]
    results = []
    for (block,) in sorted(pairs.select("block").distinct().toLocalIterator()):
        sets: dict = {}
        for item, term in pairs.where(F.col("block") == block).select("item", "term").collect():  # at most block_terms, or one item
            sets.setdefault(item, []).append(term)
        graph = shared(sets)
        posted = written(postings(docs, graph, doc_id, doc_text), "postings")
        n, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        df = np.zeros(len(graph.terms), np.int64)
        for term, count in posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = count
        if not n:
            continue
        found = best_of_tasks(posted, graph, weights(df, n), n, total, top, cells)
        names = spark.createDataFrame(list(enumerate(graph.items)), f"place int, item {kind}")
        results.append(found.join(F.broadcast(names), "place").select("item", "id", "score"))
    if not results:
        return spark.createDataFrame([], f"item {kind}, rank int, id long, score long")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    order = (F.desc("score"), F.asc("id"))
    some = every.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("item", "rank", "id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    found = ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


OP11_SQL = r"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM items JOIN dfs USING (term), corpus),
long AS (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // total) AS m FROM lengths, corpus),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM weighed JOIN tfs USING (term) JOIN long USING (doc_id) GROUP BY item_id, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
