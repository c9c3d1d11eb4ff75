"""Nearest vectors: an exact search by blocks of matrix products, and an index of coarse cells that looks at few of the rows.

The questions are the stated, small side: they go to the tasks in blocks of at most ``BLOCK`` vectors, however many there
are. A task multiplies each batch of rows with the block and keeps the best ``k`` of each question; only these are shuffled
and ranked. Scores are cosines, cut to [0, 1] and rounded to six places, as ranks depend on them; equal scores are ranked by
id. Null vectors, and those of another length than the question's, are no answers; a zero vector scores 0.

Questions that are mostly zeros, as hashed words are, go as their other numbers, up to ``SPARSE`` of them a block, so that the rows are
read once for very many questions. A task takes rows of ``CHUNK`` such numbers at a time, each different vector once. Dimensions that
one in ``FREQUENT`` of them has are multiplied once for all questions that agree there but for a factor; the others are added from lists
of the rows that have them. What may be among the best by these single-precision sums is computed again in double precision.

The index deals rows to the nearest of some centres, which are fitted on at most ``SAMPLE`` rows drawn by their ids' hashes;
every row is indexed. A cell that holds a large share of the rows is many files, so no task reads a cell alone. A question
looks at the cells of its ``probes`` nearest centres; only the files of probed cells are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.session import checkpointed

#: Question vectors in a block, numbers of a matrix product, rows that centres are fitted on, and rounds of fitting.
BLOCK, CELLS, SAMPLE, ROUNDS = 2048, 4_000_000, 20_000, 12
#: Numbers other than zero in a block of sparse questions and in a chunk of rows; the share of rows that makes a dimension frequent.
SPARSE, CHUNK, FREQUENT = 4_000_000, 4_000_000, 8
#: Groups of questions whose frequent dimensions are multiplied at a time, rows of which only the best is looked at first.
GROUPS, RUN = 32, 256


def units(vectors) -> np.ndarray:
    """Vectors of one length, each divided by its norm; zero vectors stay."""
    m = np.asarray(vectors, np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm == 0, 1, norm)[:, None]


def _best(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(found, ignore_index=True).sort_values(["question", "score", "id"], ascending=[True, False, True])
    return rows[rows.groupby("question").cumcount() < k]


def _tasks_best(rows: DataFrame, asked: np.ndarray, wanted: list[set] | None, k: int, id_col: str, vector_col: str, skip: list | None) -> DataFrame:
    """question (its place in the block), id and score of each task's k best rows for each question."""
    width, kind = asked.shape[1], dict(rows.dtypes)[id_col]
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *([F.col("cell")] if wanted else [])]

    def run(batches):
        found, held = [], 0
        least = np.full(len(asked), -1.0)
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(-1).to_numpy()
            for at in range(0, batch.num_rows, step := max(1, CELLS // max(len(asked), width))):
                some = np.flatnonzero(lengths[at : at + step] == width) + at
                if not len(some):
                    continue
                part = batch.take(pa.array(some))
                ids = part.column(0).to_pylist()
                score = asked @ units(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)).T
                score = np.round(np.clip(np.nan_to_num(score), 0, 1), 6)
                if wanted:
                    cell = part.column(2).to_numpy()
                    score = np.where(np.stack([np.isin(cell, list(w)) for w in wanted]), score, -2)
                if skip:
                    mine = {x: i for i, x in enumerate(ids)}
                    for q, x in enumerate(skip):
                        if x in mine:
                            score[q, mine[x]] = -2
                question, column = np.nonzero((score >= least[:, None]) & (score >= 0))
                found.append(pd.DataFrame({"question": question, "id": [ids[c] for c in column], "score": score[question, column]}))
                held += len(question)
                if held > 4 * k * len(asked) + 100_000 or len(found) == 1:
                    found = [_best(found, k)]
                    held = len(found[0])
                    kth = found[0].groupby("question").score.agg(["count", "min"])
                    full = kth[kth["count"] == k]
                    least[full.index.to_numpy()] = full["min"].to_numpy()
        if found:
            yield from pa.Table.from_pandas(_best(found, k), preserve_index=False).select(["question", "id", "score"]).cast(pa.schema([("question", pa.int64()), ("id", batch.schema.field(0).type), ("score", pa.float64())])).to_batches()

    return rows.select(*columns).mapInArrow(run, f"question long, id {kind}, score double")


def _blocks(questions: DataFrame):
    """(ids, vectors) of the questions, block by block."""
    n = -(-2 * questions.count() // BLOCK) or 1
    while n > 1 and not questions.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("b")).count().where(F.col("count") > BLOCK).isEmpty():
        n *= 2
    for b in range(n):
        rows = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).where("vector is not null").collect()  # at most BLOCK
        for width in sorted({len(r.vector) for r in rows}):
            same = [r for r in rows if len(r.vector) == width]
            yield [r.query_id for r in same], units([r.vector for r in same])


def _ranked(spark: SparkSession, parts: list[DataFrame], k: int, query_kind: str, id_kind: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"query_id {query_kind}, id {id_kind}, score double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Lists:
    """Sparse vectors one behind the other: where each begins, its dimensions and its numbers."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, values: np.ndarray):
        self.starts, self.at, self.values = np.concatenate([[0], np.cumsum(sizes)]), at, values

    def __len__(self) -> int:
        return len(self.starts) - 1

    def taken(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each number of these vectors the place of its vector in some, and its own place."""
        sizes = self.starts[some + 1] - self.starts[some]
        ends = np.cumsum(sizes)
        return np.repeat(np.arange(len(some)), sizes), np.repeat(self.starts[some] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)

    def only(self, some: np.ndarray) -> Lists:
        _, place = self.taken(some)
        return Lists(self.starts[some + 1] - self.starts[some], self.at[place], self.values[place])


def _finite(m: np.ndarray) -> np.ndarray:
    """Vectors with a number that is none or has no bound score 0, as zero vectors do."""
    return np.where(np.isfinite(m).all(axis=1)[:, None], m, 0)


def _chunks(batches, width: int):
    """ids and unit vectors of the rows of this width, in chunks of about CHUNK numbers."""
    ids, sizes, at, values, n = [], [], [], [], 0
    for batch in batches:
        lengths = batch.column(1).value_lengths().fill_null(-1).to_numpy()
        for start in range(0, batch.num_rows, step := max(1, CELLS // width)):
            some = np.flatnonzero(lengths[start : start + step] == width) + start
            if not len(some):
                continue
            part = batch.take(pa.array(some))
            m = units(_finite(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)))
            row, column = np.nonzero(m)
            ids.append(part.column(0))
            sizes.append(np.bincount(row, minlength=len(m)))
            at.append(column.astype(np.int32))
            values.append(m[row, column])
            n += len(row) + len(m)
            if n > CHUNK:
                yield pa.chunked_array(ids).combine_chunks(), Lists(*map(np.concatenate, (sizes, at, values)))
                ids, sizes, at, values, n = [], [], [], [], 0
    if ids:
        yield pa.chunked_array(ids).combine_chunks(), Lists(*map(np.concatenate, (sizes, at, values)))


def _different(rows: Lists, k: int) -> tuple[Lists, Lists]:
    """The different vectors of rows, and of each the first k places that it has."""
    seen: dict[bytes, int] = {}
    at, values, s = rows.at.tobytes(), rows.values.tobytes(), rows.starts.tolist()
    of = np.array([seen.setdefault(at[4 * a : 4 * b] + values[8 * a : 8 * b], len(seen)) for a, b in zip(s, s[1:], strict=False)])
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(seen) + 1))
    sizes = np.minimum(np.diff(first), k)
    kept = np.arange(len(order)) - np.repeat(first[:-1], np.diff(first)) < k
    return rows.only(order[first[:-1]]), Lists(sizes, order[kept], np.zeros(0))


def _patterns(asked: Lists, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different parts that questions have in the frequent dimensions, divided by their largest number; which one each question has, and that number."""
    place = np.full(frequent.max(initial=0) + 1 if len(frequent) else 1, -1)
    place[frequent] = np.arange(len(frequent))
    seen, of, factor = {}, np.zeros(len(asked), np.int64), np.ones(len(asked))
    for begin in range(0, len(asked), 4096):
        some = np.arange(begin, min(begin + 4096, len(asked)))
        question, number = asked.taken(some)
        dim = asked.at[number]
        inside = (dim < len(place)) & (place[np.minimum(dim, len(place) - 1)] >= 0)
        m = np.zeros((len(some), max(1, len(frequent))))
        m[question[inside], place[dim[inside]]] = asked.values[number[inside]]
        most = np.abs(m).max(axis=1)
        factor[some] = np.where(most > 0, most, 1)
        m = np.round(m / factor[some, None], 9) + 0.0
        of[some] = [seen.setdefault(r.tobytes(), len(seen)) for r in m]
    return np.frombuffer(b"".join(seen), np.float64).reshape(len(seen), -1), of, factor


def _found(asked: Lists, rows: Lists, owned: Lists, width: int, k: int, least: np.ndarray):
    """question, places and scores of the k best rows of each question that are no worse than least, which goes up to the k-th score."""
    n = len(rows)
    order = np.argsort(rows.at, kind="stable")
    begins = np.searchsorted(rows.at[order], np.arange(width + 1))
    row, value = np.repeat(np.arange(n), np.diff(rows.starts))[order], rows.values[order].astype(np.float32)
    frequent = np.flatnonzero(np.diff(begins) * FREQUENT > n)
    often = np.zeros(width, bool)
    often[frequent] = True
    dense = np.zeros((max(1, len(frequent)), n), np.float32)
    for i, d in enumerate(frequent):
        dense[i, row[begins[d] : begins[d + 1]]] = value[begins[d] : begins[d + 1]]
    patterns, of, factor = _patterns(asked, frequent)
    runs, sums = -(-n // RUN), None
    sums = np.full(runs * RUN, -np.inf, np.float32)
    members, spread = owned.starts, np.zeros(width)
    by_group = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[by_group], np.arange(len(patterns) + 1))
    for first in range(0, len(patterns), GROUPS):
        products = patterns[first : first + GROUPS].astype(np.float32) @ dense
        for g, base in enumerate(products, first):
            for q in by_group[cuts[g] : cuts[g + 1]]:
                own = slice(asked.starts[q], asked.starts[q + 1])
                at, values = asked.at[own], asked.values[own]
                sums[:n] = base
                for d, w in zip(at.tolist(), (values / factor[q]).tolist(), strict=True):
                    if not often[d] and begins[d] < begins[d + 1]:
                        here = slice(begins[d], begins[d + 1])
                        sums[row[here]] += np.float32(w) * value[here]
                best = sums.reshape(runs, RUN).max(axis=1)
                error = (len(at) + len(frequent) + 8) * 1.2e-7
                bound = least[q] - 5e-7 - error
                if runs >= k:  # so many rows at least are as good as the k-th best run
                    bound = max(bound, factor[q] * float(np.partition(best, runs - k)[runs - k]) - 2e-6 - 2 * error)
                bound = bound / factor[q] if bound > 0 else -np.inf
                some = np.flatnonzero(best >= bound)
                if not len(some):
                    continue
                part, place = np.nonzero(sums.reshape(runs, RUN)[some] >= bound)
                place = some[part] * RUN + place
                place = place[place < n]
                spread[at] = values
                which, number = rows.taken(place)
                score = np.bincount(which, weights=rows.values[number] * spread[rows.at[number]], minlength=len(place))
                spread[at] = 0
                score = np.round(np.clip(score, 0, 1), 6)
                good = score >= least[q]
                which, number = owned.taken(place[good])
                score, number = score[good][which], owned.at[number]
                top = np.lexsort((number, -score))[:k]
                if len(top):
                    if len(top) == k:
                        least[q] = max(least[q], score[top[-1]])
                    yield q, number[top], score[top]


def _sparse_best(rows: DataFrame, names: pa.Array, asked: Lists, width: int, k: int, id_col: str, vector_col: str, kinds: tuple[str, str]) -> DataFrame:
    """query_id and found, each chunk's k best rows of a question, scores below 0."""

    def run(batches):
        least = np.full(len(asked), -1.0)  # of what a task has found so far
        for ids, vectors in _chunks(batches, width):
            order = pc.sort_indices(ids)
            ids, vectors = ids.take(order), vectors.only(order.to_numpy())
            questions, places, scores = [], [], []

            def out():
                struct = pa.StructArray.from_arrays([pa.array(-np.concatenate(scores)), ids.take(pa.array(np.concatenate(places)))], ["below", "id"])  # noqa: B023
                ends = np.concatenate([[0], np.cumsum([len(x) for x in places])])  # noqa: B023
                return pa.RecordBatch.from_arrays([names.take(pa.array(questions)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], ["query_id", "found"])  # noqa: B023

            for q, place, score in _found(asked, *_different(vectors, k), width, k, least):
                questions.append(q)
                places.append(place)
                scores.append(score)
                if len(questions) == 10_000:
                    yield out()
                    questions, places, scores = [], [], []
            if questions:
                yield out()

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null").mapInArrow(run, f"query_id {kinds[0]}, found array<struct<below:double,id:{kinds[1]}>>")


def _sparse_blocks(questions: DataFrame, total: int):
    """Names, unit vectors and width of the sparse questions, block by block."""
    block = lambda n: F.pmod(F.xxhash64("query_id"), F.lit(n))
    n = -(-2 * total // SPARSE) or 1
    while n > 1 and not questions.groupBy(block(n).alias("b")).agg(F.sum(F.size("at")).alias("n"), F.count(F.lit(1)).alias("all")).where((F.col("n") > SPARSE) & (F.col("all") > 1)).isEmpty():
        n *= 2
    for b in range(n):
        table = questions.where(block(n) == b).toArrow()  # at most SPARSE numbers, or one question
        for width in sorted(pc.unique(table["width"]).to_pylist()):
            rows = table.filter(pc.equal(table["width"], width)).combine_chunks()
            lists = Lists(pc.list_value_length(rows["at"]).to_numpy(), rows["at"].combine_chunks().flatten().to_numpy(), rows["values"].combine_chunks().flatten().to_numpy())
            of = np.repeat(np.arange(len(lists)), np.diff(lists.starts))
            bad = np.bincount(of, weights=~np.isfinite(lists.values), minlength=len(lists)) > 0
            values = np.where(bad[of], 0, lists.values)
            norm = np.sqrt(np.bincount(of, weights=values * values, minlength=len(lists)))
            yield rows["query_id"].combine_chunks(), Lists(np.diff(lists.starts), lists.at, values / np.where(norm == 0, 1, norm)[of]), width


def _sparse_nearest(questions: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame | None:
    """As ``nearest``; None if the questions are not sparse."""
    kinds = (dict(questions.dtypes)["query_id"], dict(rows.dtypes)[id_col])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            lists = batch.column(1)
            width = lists.value_lengths().to_numpy()
            number = lists.flatten().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(number)
            ends = np.searchsorted(some, np.concatenate([[0], np.cumsum(width)]))
            at = some - np.repeat(np.cumsum(width) - width, np.diff(ends))
            one = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), one(at.astype(np.int32)), one(number[some].astype(np.float64))], ["query_id", "width", "at", "values"])

    sparse = checkpointed(questions.select("query_id", "vector").mapInArrow(run, f"query_id {kinds[0]}, width int, at array<int>, values array<double>"))
    total, width, least = sparse.agg(F.sum(F.size("at")), F.sum("width"), F.min("width")).head()
    if not least or total * 8 > width:
        return None
    found = None
    for names, asked, width in _sparse_blocks(sparse, total):
        part = _sparse_best(rows, names, asked, width, k, id_col, vector_col, kinds)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("xs")).select("query_id", F.posexplode("xs").alias("place", "x"))
    return best.select("query_id", "x.id", F.abs("x.below").alias("score"), (F.col("place") + 1).alias("rank"))


def nearest(questions: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", itself: bool = True) -> DataFrame:
    """query_id, id, score and rank of the k nearest rows of each question (query_id, vector); all rows compete.

    With itself=False a row is no answer to the question with its own id.
    """
    if itself and (found := _sparse_nearest(questions, rows, k, id_col, vector_col)) is not None:
        return found
    spark, parts = rows.sparkSession, []
    query_kind = dict(questions.dtypes)["query_id"]
    for ids, asked in _blocks(questions):
        names = spark.createDataFrame(list(enumerate(ids)), f"question long, query_id {query_kind}")
        parts.append(_tasks_best(rows, asked, None, k, id_col, vector_col, None if itself else ids).join(F.broadcast(names), "question").drop("question"))
    return _ranked(spark, parts, k, query_kind, dict(rows.dtypes)[id_col])


def centres(rows: DataFrame, n: int, id_col: str = "id", vector_col: str = "vector") -> np.ndarray:
    """n centres by spherical k-means on a sample of at most SAMPLE rows."""
    total = rows.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = rows.where(F.col(vector_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < round(share * 1_000_000) + 1))
    m = units([r[0] for r in drawn.select(vector_col).limit(SAMPLE).collect()])
    draw = np.random.default_rng(7)
    found = m[draw.choice(len(m), min(n, len(m)), replace=False)]
    for _ in range(ROUNDS):
        of = np.argmax(m @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, m)
        found = np.where(np.any(sums, axis=1)[:, None], units(sums), found)
    return found


def write_cells(rows: DataFrame, path: str, n: int, id_col: str = "id", vector_col: str = "vector") -> None:
    """Writes all rows with a vector by the cell of their nearest centre, and the centres beside them."""
    spark, held = rows.sparkSession, centres(rows, n, id_col, vector_col)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    place = rows.columns.index(vector_col)

    def run(batches):
        for batch in batches:
            lists = batch.column(place)
            m = units(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, held.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmax(m @ held.T, axis=1).astype(np.int32))], [*batch.schema.names, "cell"])

    rows.where(F.size(vector_col) == held.shape[1]).mapInArrow(run, f"{kinds}, cell int").write.partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(held)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")


def probed(questions: DataFrame, path: str, k: int, probes: int, id_col: str = "id", vector_col: str = "vector", itself: bool = True) -> DataFrame:
    """As ``nearest``, over the cells of each question's ``probes`` nearest centres."""
    spark, parts = questions.sparkSession, []
    rows = spark.read.parquet(f"{path}/cells")
    held = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    query_kind = dict(questions.dtypes)["query_id"]
    for ids, asked in _blocks(questions):
        if asked.shape[1] != held.shape[1]:
            continue
        wanted = [set(x.tolist()) for x in np.argsort(-(asked @ held.T), axis=1)[:, :probes]]
        names = spark.createDataFrame(list(enumerate(ids)), f"question long, query_id {query_kind}")
        some = rows.where(F.col("cell").isin(sorted(set().union(*wanted))))
        parts.append(_tasks_best(some, asked, wanted, k, id_col, vector_col, None if itself else ids).join(F.broadcast(names), "question").drop("question"))
    return _ranked(spark, parts, k, query_kind, dict(rows.dtypes)[id_col])
