"""SentencePiece encoding and decoding with Gumbel top-k sampling of segmentations, without replacement.

The pieces of a public vocabulary span a lattice over a text. The file ranks its pieces; a piece weighs
(rank + OFFSET) ** -SHARPNESS, a character that no piece covers is spelt in byte pieces, and a segmentation has the product of
its pieces' weights over the sum of all segmentations' as its probability. Where no piece
holds a text's two neighbouring characters side by side, no piece can reach over the gap; the lattice is a chain of small
ones between such gaps, its chunks.

A perturbed A* search samples: a node of the queue is a set of segmentations (a fixed beginning, some barred ways at one
chunk, the rest free), its priority the largest Gumbel-perturbed log probability in it. The best node's winner is drawn
and emitted; what is left of the node falls into one set for each chunk from there on, whose maxima are Gumbels
truncated at the winner's. The k-th pop is the k-th sample, all are distinct and exact. The inclusion score of a sample
is the log of the probability that its value lies above the (k + 1)-th one's, log(1 - exp(-exp(log p - threshold))), by
which p is divided in estimates. Draws are seeded by row key, so that a row's samples do not depend on its partition.
The lattices of a slice of texts are worked out together in arrays, and forgotten after it.

Decoding joins pieces and bytes and takes away the space put before the text; it gives every text back.

Defined results: null and empty texts have one segmentation, without pieces; a text with fewer than k segmentations
gives all of them, with score 0; null keys are seeded alike; repeated rows give the same samples. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from math import exp, log, prod

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, memory, slices, text_of
from caselode.llm.lm import mix

SAMPLES, SHARPNESS, OFFSET = 2, 2.0, 10.0
#: Characters of the texts whose lattices a task holds at once.
SLICE = 400_000


def piece_bytes(path: str) -> dict[int, bytes]:
    """What each piece of a vocabulary stands for."""
    import sentencepiece

    model, out = sentencepiece.SentencePieceProcessor(model_file=path), {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out[i] = model.id_to_piece(i).replace("▁", " ").encode()
    return out


def decoder(path: str):
    """A function from ids to their text."""
    known = piece_bytes(path)
    sizes = np.array([len(known[i]) if i in known else -1 for i in range(max(known) + 1)])  # repeat raises an error below 0
    starts, joined = np.cumsum(np.maximum(sizes, 0)) - sizes, np.frombuffer(b"".join(known[i] for i in sorted(known)), np.uint8)

    def text(ids: bytes) -> str:
        if not ids:
            return ""
        own = np.frombuffer(ids, "<u4")
        size = sizes[own]
        ends = np.cumsum(size)
        return joined[np.repeat(starts[own] - ends + size, size) + np.arange(ends[-1])].tobytes().decode()[1:]

    return text


class Vocabulary:
    """Pieces with spaces for their marks, their weights, and the beginnings of pieces."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = piece_bytes(path)
        self.bytes = {b[0]: i for i, b in known.items() if model.is_byte(i)}
        self.ids = {b.decode(): i for i, b in known.items() if not model.is_byte(i)}
        self.begins = {p[:n] for p in self.ids for n in range(1, len(p))}
        # every piece and every beginning of one: its id, or -1; its weight
        self.table = {b: (-1, 0.0) for b in self.begins}
        first = min(self.ids.values())
        rank = np.arange(model.get_piece_size()) - first
        rank[list(self.bytes.values())] = len(rank)
        weight = (np.maximum(rank, 0) + OFFSET) ** -sharpness
        self.weights = (weight / weight[list(known)].sum()).tolist()
        self.logs = np.log(self.weights).tolist()
        self.table.update((p, (i, self.weights[i])) for p, i in self.ids.items())

        # the trie of pieces: nodes by their beginnings' places, each node's piece or -1, steps as sorted keys of node and letter
        nodes = {b: i for i, b in enumerate(self.table)}
        self.piece = np.array([x for x, _ in self.table.values()], np.int32)
        self.log_weights = np.array(self.logs)
        self.root = np.full(0x110000, -1, np.int32)
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = sorted({c for p in pairs for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joined[self.number[ord(a)], self.number[ord(b)]] = True
        keys, values = [], []
        for b, i in nodes.items():
            if len(b) == 1:
                self.root[ord(b)] = i
            else:
                keys.append(nodes[b[:-1]] << 16 | int(self.number[ord(b[-1])]))
                values.append(i)
        # an open table, filled to a quarter at most
        self.bits = (4 * len(keys)).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.array(keys), np.array(values, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node behind each one by a letter's number, or -1."""
        wanted = nodes.astype(np.int64) << 16 | letters
        at = self.slot(wanted)
        found = self.keys[at]
        out = np.where(found == wanted, self.values[at], -1)
        todo = np.flatnonzero((found != wanted) & (found >= 0))
        at, wanted = at[todo], wanted[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == wanted
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at, wanted = todo[on], at[on], wanted[on]
        return out

    def cuts(self, points: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where chunks begin in texts that lie one after the other: at texts' heads and wherever no piece holds the two characters beside."""
        at = self.number[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joined[at[:-1], at[1:]]
        cut[heads] = True
        return np.flatnonzero(cut)

    def chunks(self, text: str) -> list[str]:
        """The text cut wherever no piece holds the two characters beside the cut."""
        cuts = self.cuts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64)).tolist()
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def edges_of(chunk: str, v: Vocabulary) -> list[list[tuple[int, tuple[int, ...], float]]]:
    """For each place of a chunk the pieces that start there: end, ids and weight."""
    n, find = len(chunk), v.table.get
    out = []
    for i in range(n):
        x, w = find(chunk[i], (-2, 0.0))
        if x >= 0:
            own = [(i + 1, (x,), w)]
        else:  # a character that only bytes spell
            way = tuple([v.bytes[b] for b in chunk[i].encode()])
            own = [(i + 1, way, prod([v.weights[b] for b in way]))]
        if x != -2:
            for j in range(i + 2, n + 1):
                found = find(chunk[i:j])
                if found is None:
                    break
                if found[0] >= 0:
                    own.append((j, (found[0],), found[1]))
        out.append(own)
    return out


def sums(edges) -> tuple[list[float], list[int], float]:
    """Sums of the weights of all ways from each place (each divided by the one after it, so that none runs out of range),
    the likeliest way's edge at each place, and that way's log probability."""
    n = len(edges)
    total, scale, best, choice = [1.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1), [0] * n
    # total[i] * exp(scale[i]) is the sum; within a chunk scale changes only where a sum grows small
    for i in range(n - 1, -1, -1):
        z, top, at, base = 0.0, -1e308, 0, scale[i + 1]
        for e, (j, _, w) in enumerate(edges[i]):
            s = w * total[j] if scale[j] == base else w * total[j] * exp(scale[j] - base)
            z += s
            b = log(w) + best[j] if w > 0 else -1e308
            if b > top:
                top, at = b, e
        if z < 1e-100:
            base, z = base + log(z), 1.0
        total[i], scale[i], best[i], choice[i] = z, base, top, at
    return [t if not x else (t, x) for t, x in zip(total, scale, strict=True)], choice, min(0.0, best[0] - log(total[0]) - scale[0])


def mode_of(chunk: str, v: Vocabulary) -> tuple[bytes, float, float]:
    """Ids of a chunk's likeliest way, its log probability and the probability of all others, without keeping the lattice.

    The others' weights are added up by themselves, so that nothing cancels however likely the best way is.
    """
    n, find = len(chunk), v.table.get
    total, best, others, step = [1.0] * (n + 1), [1.0] * (n + 1), [0.0] * (n + 1), [(0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        x, w = find(chunk[i], (-2, 0.0))
        if x < 0:  # a character that only bytes spell
            w = prod([v.weights[v.bytes[b]] for b in chunk[i].encode()])
        own, top, at, left, weight = w * total[i + 1], w * best[i + 1], (i + 1, x), 0.0, w
        if x != -2:
            for j in range(i + 2, n + 1):
                found = find(chunk[i:j])
                if found is None:
                    break
                x, w = found
                if x >= 0:
                    z = w * total[j]
                    if (b := w * best[j]) > top:
                        left += own
                        own, top, at, weight = z, b, (j, x), w
                    else:
                        left += z
        total[i], best[i], step[i], others[i] = own + left, top, at, left + weight * others[at[0]]
    if best[0] < 1e-250:  # too long for plain products
        lattice = Lattice(chunk, v)
        return array("I", lattice.ids(lattice.mode)).tobytes(), lattice.mode_log, lattice.others
    i, ids = 0, []
    while i < n:
        j, x = step[i]
        if x >= 0:
            ids.append(x)
        else:
            ids += [v.bytes[b] for b in chunk[i].encode()]
        i = j
    return array("I", ids).tobytes(), min(0.0, log(best[0] / total[0])), others[0] / total[0]


class Lattice:
    """All ways through one chunk: at each place the edges with their probabilities, given the place."""

    def __init__(self, chunk: str, v: Vocabulary):
        edges = edges_of(chunk, v)
        total, choice, self.mode_log = sums(edges)
        split = [t if isinstance(t, tuple) else (t, 0.0) for t in total]
        self.edges: list = []
        for i, own in enumerate(edges):
            z, base = split[i]
            self.edges.append([(j, ids, w, w * split[j][0] / z * exp(split[j][1] - base)) for j, ids, w in own])
        self.size = sum(map(len, self.edges))
        self.edges.append(None)
        i, way = 0, []
        while i < len(edges):
            way.append(choice[i])
            i = edges[i][choice[i]][0]
        self.mode = tuple(way)
        self.others = self.left([self.mode])

    def first(self) -> tuple[tuple[int, ...], float]:
        """The likeliest way (as edge numbers) and its log probability."""
        return self.mode, self.mode_log

    def draw_other(self, rng) -> tuple[tuple[int, ...], float]:
        """A way drawn from all but the likeliest, and its log probability: where it leaves that one, then freely."""
        u, i, keep, at = rng.random() * self.others, 0, 1.0, 0
        for at, e in enumerate(self.mode):  # noqa: B007
            p = self.edges[i][e][3]
            gone = keep * sum(q for f, (*_, q) in enumerate(self.edges[i]) if f != e)
            if u < gone or at == len(self.mode) - 1:
                break
            u, keep, i = u - gone, keep * p, self.edges[i][e][0]
        while len(self.edges[i]) == 1:  # rounding led past the last place with a choice
            at -= 1
            i = self._place(at)
        out, x, barred = list(self.mode[:at]), self.log_p_of(self.mode[:at]), self.mode[at]
        while i < len(self.edges) - 1:
            own = self.edges[i]
            u = rng.random() * (sum(e[3] for f, e in enumerate(own) if f != barred) if barred >= 0 else 1.0)
            last = 0
            for f, e in enumerate(own):
                if f != barred and e[3] > 0:
                    last = f
                    u -= e[3]
                    if u < 0:
                        break
            out.append(last)
            x += log(own[last][3])
            i, barred = own[last][0], -1
        return tuple(out), min(0.0, x)

    def _place(self, n: int) -> int:
        i = 0
        for e in self.mode[:n]:
            i = self.edges[i][e][0]
        return i

    def log_p_of(self, way: tuple[int, ...]) -> float:
        """Log probability of a way's beginning."""
        i, x = 0, 0.0
        for e in way:
            x += log(self.edges[i][e][3])
            i = self.edges[i][e][0]
        return x

    def ids(self, way: tuple[int, ...]) -> list[int]:
        i, out = 0, []
        for e in way:
            j, ids, *_ = self.edges[i][e]
            out += ids
            i = j
        return out

    def log_p(self, way: tuple[int, ...]) -> float:
        return min(0.0, self.log_p_of(way))

    def left(self, barred: list[tuple[int, ...]], i: int = 0) -> float:
        """Probability, from place i on, of all ways but the barred ones: a sum of parts, so nothing cancels."""
        mass, scale = 0.0, 1.0
        while True:
            if not barred:
                return mass + scale
            if i == len(self.edges) - 1:
                return mass
            on: dict[int, list] = {}
            for w in barred:
                on.setdefault(w[0], []).append(w[1:])
            mass += scale * sum(p for e, (*_, p) in enumerate(self.edges[i]) if e not in on)
            if len(on) > 1:
                return mass + scale * sum(self.edges[i][e][3] * self.left(ws, self.edges[i][e][0]) for e, ws in on.items())
            ((e, barred),) = on.items()
            scale, i = scale * self.edges[i][e][3], self.edges[i][e][0]

    def draw(self, rng, barred: list[tuple[int, ...]] = ()) -> tuple[int, ...]:
        """A way drawn from all but the barred ones."""
        i, out, barred = 0, [], list(barred)
        while i < len(self.edges) - 1:
            own = [p for *_, p in self.edges[i]]
            for e in {w[0] for w in barred}:
                own[e] *= self.left([w[1:] for w in barred if w[0] == e], self.edges[i][e][0])
            u = rng.random() * sum(own)
            for e, p in enumerate(own):  # noqa: B007
                u -= p
                if u < 0 < p:
                    break
            else:
                e = max(range(len(own)), key=own.__getitem__)
            out.append(e)
            barred = [w[1:] for w in barred if w[0] == e]
            i = self.edges[i][e][0]
        return tuple(out)


class Lattices:
    """The lattices of many chunks in arrays, each different chunk once.

    Places are numbered by how far they lie from their chunk's end, so that all places of one distance are worked out together,
    from those nearer to the end; the place `stop` is every chunk's end. The edges of a place lie side by side, shortest first.
    """

    def __init__(self, points: np.ndarray, starts: np.ndarray, v: Vocabulary):
        ends = np.append(starts[1:], len(points))
        self.codes, first = distinct(points, starts, ends)  # which lattice each chunk has
        lengths = (ends - starts)[first]
        ahead = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(first)), lengths)
        at = np.arange(len(owner), dtype=np.int32)
        points, far = points[at + (starts[first] - ahead)[owner]], (ahead + lengths)[owner] - at
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        place = np.empty(len(order) + 1, np.int32)
        place[order] = np.arange(len(order))
        self.stop = place[-1] = len(order)
        self.begins = place[ahead]

        # where pieces lie: all places go down the trie of pieces together
        node, here, found = v.root[points], at, []
        spelt = np.flatnonzero((node < 0) | (v.piece[node] < 0))
        self.spelt, row = np.unique(points[spelt], return_inverse=True)
        self.bytes = [[v.bytes[b] for b in chr(c).encode()] for c in self.spelt.tolist()]
        found.append((spelt, 1, -1 - row))
        weights = np.array([sum(v.logs[b] for b in own) for own in self.bytes[::-1]])  # of ids below 0
        letters, here, node, long = v.number[points], at[node >= 0], node[node >= 0], 1
        while len(here):
            own = v.piece[node]
            hit = own >= 0
            found.append((here[hit], long, own[hit]))
            on = far[here] > long
            here = here[on]
            node = v.step(node[on], letters[here + long])
            on = node >= 0
            here, node, long = here[on], node[on], long + 1
        count = np.zeros(len(at), np.int32)
        found = [(own, place[own], long, ids) for own, long, ids in found]
        for _, q, *_ in found:
            count[q] += 1
        self.first = np.append(0, np.cumsum(count)).astype(np.int32)  # each place's first edge
        n, put = int(self.first[-1]), self.first[:-1].copy()
        self.ids, self.to = np.empty(n, np.int32), np.empty(n, np.int32)
        for own, q, long, ids in found:
            e = put[q]
            put[q] = e + 1
            self.ids[e] = ids
            self.to[e] = np.where(far[own] > long, place[np.minimum(own + long, len(at))], self.stop)
        self.source = np.repeat(np.arange(len(at), dtype=np.int32), count)
        log_w = np.concatenate([v.log_weights, weights])[self.ids]

        # from the ends backwards: sums over all ways, each edge's probability, the likeliest way's edge and what is beside that way
        self.p, self.best = np.empty(n), np.zeros(len(at), np.int32)
        total, top, self.log_mode, self.other = (np.zeros(len(at) + 1) for _ in range(4))
        edges = np.append(0, np.cumsum(np.bincount(far))) if len(far) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            x, y = self.first[a], self.first[b]
            starts, count, to, w = self.first[a:b] - x, np.diff(self.first[a : b + 1]), self.to[x:y], log_w[x:y]
            z = w + total[to]
            high = np.maximum.reduceat(z, starts)
            p = np.exp(z - np.repeat(high, count))
            z = np.add.reduceat(p, starts)
            total[a:b] = high + np.log(z)
            p /= np.repeat(z, count)
            self.p[x:y] = p
            z = w + top[to]
            top[a:b] = np.maximum.reduceat(z, starts)
            hits = np.flatnonzero(z == np.repeat(top[a:b], count))[::-1]
            self.best[self.source[x + hits]] = x + hits
            best = self.best[a:b] - x
            own = p[best]
            p[best] = 0.0
            self.other[a:b] = np.add.reduceat(p, starts) + own * self.other[to[best]]
            self.log_mode[a:b] = np.log(own) + self.log_mode[to[best]]
        # the likeliest ways' edges: those of lattice i are way[start[i] : start[i] + size[i]]
        q, i, steps = self.begins, np.arange(len(first)), []
        while len(q):
            e = self.best[q]
            steps.append((i, e))
            on = self.to[e] != self.stop
            q, i = self.to[e][on], i[on]
        self.way, self.start, self.size = in_rows(steps, len(first))

    def others_drawn(self, codes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each code a way drawn from all but its lattice's likeliest: edges, each way's start and size there, log probabilities."""
        i, q, barred, steps, log_p, n = np.arange(len(codes)), self.begins[codes], np.ones(len(codes), bool), [], np.zeros(len(codes)), 0
        while len(q):
            n += 1
            u = (mix(seeds[i] + np.uint64(n)) >> np.uint64(11)) * 2.0**-53
            e = self._pick(q, np.where(barred, u * self.other[q], u), barred)
            steps.append((i, e))
            log_p[i] += np.log(self.p[e])
            barred &= e == self.best[q]
            on = self.to[e] != self.stop
            i, q, barred = i[on], self.to[e][on], barred[on]
        return *in_rows(steps, len(codes)), np.minimum(log_p, 0.0)

    def _pick(self, q: np.ndarray, u: np.ndarray, barred: np.ndarray) -> np.ndarray:
        """An edge of each place; where the likeliest way is barred, its edge counts with what is beside that way behind it."""
        e, last, out, todo = self.first[q], self.first[q + 1] - 1, self.first[q], np.arange(len(q))
        best = np.where(barred, self.best[q], -1)
        while len(todo):
            w = np.where(e == best, self.p[e] * self.other[self.to[e]], self.p[e])
            out[todo[w > 0]] = e[w > 0]  # rounding never leads to an edge without weight
            u = u - w
            on = (u >= 0) & (e < last)
            todo, u, e, last, best = todo[on], u[on], e[on] + 1, last[on], best[on]
        return out

    def numbers(self, edges: np.ndarray) -> tuple[int, ...]:
        """Edges by their numbers at their places, as Lattice has them."""
        return tuple((edges - self.first[self.source[edges]]).tolist())

    def edges(self, code: int, numbers: tuple[int, ...]) -> np.ndarray:
        q, out = self.begins[code], []
        for e in numbers:
            out.append(self.first[q] + e)
            q = self.to[out[-1]]
        return np.array(out, np.int32)

    def pieces(self, edges: np.ndarray) -> bytes:
        ids = self.ids[edges]
        if len(spelt := np.flatnonzero(ids < 0)):
            own, sizes = [self.bytes[-1 - i] for i in ids[spelt].tolist()], np.ones(len(ids), np.int64)
            sizes[spelt] = list(map(len, own))
            ids = np.repeat(ids, sizes)
            ids[ids < 0] = [x for ways in own for x in ways]
        return ids.astype("<u4").tobytes()


def distinct(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk the number of its text among the different ones, and a chunk that has each of these."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = ends - starts
    inside = np.arange(len(points)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(lengths.max() - 1, 0x9E3779B97F4A7C15, np.uint64)]))
    codes, keys = pd.factorize(np.add.reduceat(mix(points.astype(np.uint64)) * powers[inside], starts) ^ mix(lengths.astype(np.uint64)))
    first = np.empty(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    # chunks that only share a hash stand by themselves
    same = lengths == lengths[first[codes]]
    there = np.minimum(np.repeat(starts[first[codes]], lengths) + inside, len(points) - 1)
    same &= np.logical_and.reduceat(points == points[there], starts)
    alone = np.flatnonzero(~same)
    codes[alone] = len(first) + np.arange(len(alone))
    return codes, np.concatenate([first, alone])


def in_rows(steps: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of steps, each with its rows, put row by row: values, each row's start and size."""
    size = np.zeros(n, np.int64)
    for rows, _ in steps:
        size[rows] += 1
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int32)
    for step, (rows, values) in enumerate(steps):
        out[start[rows] + step] = values
    return out, start, size


class Search:
    """The perturbed A* search over one text's segmentations."""

    def __init__(self, key: int | None, text: str, starts: list[int], codes: np.ndarray, lattices: Lattices, v: Vocabulary):
        self.text, self.starts, self.codes, self.lattices, self.vocabulary = text, [*starts, len(text)], codes, lattices, v
        self.rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{key}"))
        own = lattices.begins[codes]
        self.log_mode, self.others = np.minimum(lattices.log_mode[own], 0.0), lattices.other[own]
        # a node: value, tie, chunk, its parent's winner (starts and sizes in the store, log probabilities), ways barred at the chunk
        self.queue, self.count, self.out, self.threshold = [(-float(self.rng.gumbel()), 0, 0, None, [])], 0, [], None

    def pop(self, k: int, store: np.ndarray):
        """Takes the best node: chunks that take another way than the likeliest, seeds for these, and edges drawn at the node's chunk."""
        self.now = None
        if not self.queue:
            return None
        value, _, at, begin, barred = heapq.heappop(self.queue)
        if len(self.out) == k:
            self.threshold, self.queue = -value, []
            return None
        start, size, log_p = self.lattices.start[self.codes], self.lattices.size[self.codes], self.log_mode.copy()
        if begin is not None:
            for own, other in zip((start, size, log_p), begin, strict=True):
                own[:at] = other[:at]
        way, left = None, None
        if barred:
            barred = [b if isinstance(b, tuple) else self.lattices.numbers(store[b]) for b in barred]
            lattice = Lattice(self.text[self.starts[at] : self.starts[at + 1]], self.vocabulary)
            numbers = lattice.draw(self.rng, barred)
            log_p[at], left = lattice.log_p(numbers), lattice.left([*barred, numbers])
            way = self.lattices.edges(self.codes[at], numbers)
        from_ = at + bool(barred)
        others = self.others[from_:]
        drawn = np.flatnonzero(self.rng.random(len(others)) < others) + from_
        self.now = -value, at, barred, left, start, size, log_p, drawn
        return drawn, self.rng.integers(0, 2**64, len(drawn), np.uint64), way

    def settle(self, k: int, drawn_start: np.ndarray, drawn_size: np.ndarray, drawn_log_p: np.ndarray, way_at: slice | None) -> None:
        """Emits the winner of the node and puts what the node leaves into the queue."""
        value, at, barred, left, start, size, log_p, drawn = self.now
        start[drawn], size[drawn], log_p[drawn] = drawn_start, drawn_size, drawn_log_p
        if way_at is not None:
            start[at], size[at] = way_at.start, way_at.stop - way_at.start
        self.out.append((start, size, min(0.0, float(log_p.sum())), value))
        # what is left: for each chunk from `at` on, the same up to it, something else there
        rest = self.others[at:].copy()
        rest[drawn - at] = -np.expm1(drawn_log_p)  # not the likeliest way, so at most a half: nothing cancels
        if barred:
            rest[0] = left
        before = np.cumsum(np.concatenate([[log_p[:at].sum()], log_p[at:-1]]))
        with np.errstate(divide="ignore"):
            free = self.rng.gumbel(size=len(rest)) + np.log(rest) + before
        need = k - len(self.out) + 1
        live = np.argpartition(free, -need)[-need:] if len(free) > need else np.arange(len(free))
        live = live[np.isfinite(free[live])]
        cut = -np.logaddexp(-value, -free[live])  # Gumbels at their masses, on condition that they are at most the winner's value
        for i, x in zip(live.tolist(), cut.tolist(), strict=True):
            self.count += 1
            own = slice(int(start[at + i]), int(start[at + i] + size[at + i]))
            heapq.heappush(self.queue, (-x, self.count, at + i, (start, size, log_p), [*(barred if i == 0 else []), own]))

    def results(self, store: np.ndarray):
        for start, size, log_p, value in self.out:
            ends = np.cumsum(size)
            edges = store[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
            above = log_p - self.threshold if self.threshold is not None else np.inf
            score = 0.0 if above > 4 else above if above < -40 else float(np.log(-np.expm1(-np.exp(above))))
            yield self.lattices.pieces(edges), log_p, value, score


class Sampler:
    """Samples segmentations of many texts at a time."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)

    def sampled(self, keys: list[int | None], texts: list[str], k: int) -> list[list[tuple[bytes, float, float, float]]]:
        """For each text up to k of (ids, log probability, perturbed value, log inclusion score), by falling value."""
        v = self.vocabulary
        full = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in full]
        points = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32)
        heads = np.cumsum([0, *map(len, spaced)])
        starts = v.cuts(points, heads[:-1])
        lattices = Lattices(points, starts, v)
        edges = np.searchsorted(starts, heads)
        searches = [
            Search(keys[i], text, (starts[a:b] - head).tolist(), lattices.codes[a:b], lattices, v)
            for i, text, head, a, b in zip(full, spaced, heads[:-1].tolist(), edges[:-1], edges[1:], strict=True)
        ]
        store = lattices.way
        for _ in range(k + 1):
            asked = [(s, *got) for s in searches if (got := s.pop(k, store)) is not None]
            if not asked:
                continue
            codes = np.concatenate([s.codes[drawn] for s, drawn, *_ in asked])
            way, start, size, log_p = lattices.others_drawn(codes, np.concatenate([seeds for _, _, seeds, _ in asked]))
            start += len(store)
            ways, at, end = [store, way], 0, len(store) + len(way)
            for s, drawn, _, own in asked:
                spot = None
                if own is not None:
                    ways.append(own)
                    spot = slice(end, end + len(own))
                    end += len(own)
                here = slice(at, at + len(drawn))
                s.settle(k, start[here], size[here], log_p[here], spot)
                at += len(drawn)
            store = np.concatenate(ways)
        out: list = [[(b"", 0.0, 0.0, 0.0)] for _ in texts]
        for i, s in zip(full, searches, strict=True):
            out[i] = list(s.results(store))
        return out

    def samples(self, key: int | None, text: str, k: int) -> list[tuple[bytes, float, float, float]]:
        return self.sampled([key], [text], k)[0]


def groups(texts: list[str], size: int = SLICE):
    """Ranges of texts of about size characters, or of one text that is longer."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(text) + 1
    if held:
        yield slice(start, len(texts))


SAMPLE = {"doc_id": "long", "sample": "long", "ids": "binary", "log_p": "double", "value": "double", "log_inclusion": "double"}


def encode(df: DataFrame, model: str, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, sample (from 0), ids (little-endian unsigned 32-bit), log_p, value and log_inclusion of each sample.

    With decoded also the text that its ids decode to, without a second pass of all ids through Python.
    """
    fields = SAMPLE | ({"decoded": "string"} if decoded else {})
    types = [{"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}[t] for t in fields.values()]

    def run(batches):
        own = memory(("segmentation", model), lambda: (Sampler(model), decoder(model)))
        for batch in slices(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in groups(texts):
                found = zip(keys[part], own[0].sampled(keys[part], texts[part], samples), strict=True)
                rows = [(key, i, *s, *([own[1](s[0])] if decoded else [])) for key, got in found for i, s in enumerate(got)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(fields))

    return df.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items()))


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the texts of its ids; null ids give null."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(memory(("pieces", model), lambda: decoder(model)), na_action="ignore")

    return df.withColumn(text_col, run(ids_col))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with digests of their ids and of the text that they decode to."""
    out = encode(documents(spark, sf_dir), piece_model(), decoded=True)
    text = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return out.select("doc_id", "sample", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), text, "log_p", "value", "log_inclusion")
