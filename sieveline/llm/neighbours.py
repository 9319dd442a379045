"""Most similar vectors: a forest of sorted arrays of long hash strings, searched by longest common prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw_vectors, valid_vector
from .overlaps import planes

#: Trees, bits of a hash string, and different candidates that a query draws from one block of the index.
TREES, DEPTH, CANDIDATES = 32, 32, 2048
#: Vectors of one index block: a task sorts and searches blocks of this size, 64 MB at 64 numbers each.
BLOCK = 1 << 18
#: Queries up to which the list of them is broadcast (4 MB at 64 numbers each); more are shuffled to the blocks.
QUERY_BLOCK = 1 << 14
#: Float products of unit vectors are within this of the exact cosine.
ROUNDING = 1e-5


class Forest:
    """Sorted arrays of hash strings over one block of different unit vectors, and cells that bound the rest."""

    def __init__(self, x: np.ndarray, trees: int, depth: int, seed: int):
        self.x, self.trees, self.depth = x, trees, depth
        self.center = x.mean(0)
        self.normals = planes(x.shape[1], trees * depth, seed)
        code = np.concatenate([self.codes(x[lo : lo + 8192]) for lo in range(0, len(x), 8192)])
        self.order = np.argsort(code, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(code, self.order, axis=0)
        # Cells for the bound: a spread sample of the first tree's order gives the pivots.
        self.pivots = x[self.order[np.linspace(0, len(x) - 1, max(1, int(len(x) ** 0.5) // 2)).astype(np.int64), 0]]
        home, near = np.empty(len(x), np.int64), np.empty(len(x))
        for lo in range(0, len(x), 4096):
            c = x[lo : lo + 4096] @ self.pivots.T
            home[lo : lo + 4096], near[lo : lo + 4096] = c.argmax(1), c.max(1)
        self.by_cell = np.argsort(home, kind="stable")
        self.ends = np.searchsorted(home[self.by_cell], np.arange(len(self.pivots) + 1))
        least = np.full(len(self.pivots), 1.0)
        np.minimum.at(least, home, near)
        self.radius = np.arccos(np.clip(least - ROUNDING, -1, 1))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees) hash strings as integers, first bit highest."""
        sign = ((x - self.center) @ self.normals > 0).reshape(len(x), self.trees, self.depth)
        return sign.astype(np.uint32) @ (np.uint32(1) << np.arange(self.depth - 1, -1, -1, dtype=np.uint32))

    def candidates(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, slots) positions in rising order and the longest prefix at which each was met (-1: again, or not among the ``want``).

        Per tree a query descends to its place in the sorted array; the entries around it are those of longest
        common prefix.  All trees ascend together: of the different entries of all trees the ``want`` of longest prefix stay.
        """
        n = len(self.x)
        span = min(n, max(2, 2 * want // self.trees))
        code = self.codes(q)
        slots, prefix = [], []
        for t in range(self.trees):
            place = np.searchsorted(self.sorted[:, t], code[:, t])
            lo = np.clip(place - span // 2, 0, n - span)
            at = lo[:, None] + np.arange(span)
            other = self.sorted[at, t] ^ code[:, t][:, None]
            slots.append(self.order[at, t])
            prefix.append(self.depth - np.frexp(other.astype(np.float64))[1])
        slot, pre = np.concatenate(slots, 1).astype(np.int64), np.concatenate(prefix, 1).astype(np.int64)
        both = np.sort(slot * 64 + (63 - pre), axis=1)  # a position's longest prefix first
        slot, pre = both >> 6, 63 - (both & 63)
        pre[:, 1:][slot[:, 1:] == slot[:, :-1]] = -1
        if slot.shape[1] > want:
            out = np.argpartition(-pre, want - 1, axis=1)[:, want:]
            np.put_along_axis(pre, out, -1, axis=1)
        return slot, pre

    def search(self, q: np.ndarray, k: int, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, k) positions (-1: none) and cosines of the best different candidates, ties to the lower position."""
        pos = np.full((len(q), k), -1, np.int64)
        cos = np.full((len(q), k), -2.0)
        for lo in range(0, len(q), 64):
            part = q[lo : lo + 64]
            slot, pre = self.candidates(part, want)
            c = np.einsum("qsd,qd->qs", self.x[slot], part, optimize=True).astype(np.float64)
            c[pre < 0] = -2
            top = min(k, slot.shape[1])
            best = np.argpartition(-c, top - 1, axis=1)[:, :top] if top < slot.shape[1] else np.broadcast_to(np.arange(slot.shape[1]), slot.shape)
            rank = np.take_along_axis(best, np.argsort(-np.take_along_axis(c, best, 1), axis=1, kind="stable"), 1)
            cos[lo : lo + 64, :top] = np.take_along_axis(c, rank, 1)
            pos[lo : lo + 64, :top] = np.where(cos[lo : lo + 64, :top] > -1.5, np.take_along_axis(slot, rank, 1), -1)
        return pos, cos

    def rest(self, q: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """Per query every position whose cosine may reach ``least``: the ascent goes on in each cell that the k-th cosine does not exclude.

        A vector of a cell is at least the angle to the pivot less the cell's radius away from the query.
        """
        found: list[list[np.ndarray]] = [[] for _ in q]
        for lo in range(0, len(q), 1024):
            part, need = q[lo : lo + 1024], least[lo : lo + 1024] - ROUNDING
            angle = np.arccos(np.clip(part @ self.pivots.T, -1, 1)) - self.radius
            open_ = np.cos(np.maximum(angle - ROUNDING**0.5, 0)) >= need[:, None]
            for c in np.flatnonzero(open_.any(0)):
                own = self.by_cell[self.ends[c] : self.ends[c + 1]]
                for a in range(0, len(own), 8192):
                    asks = np.flatnonzero(open_[:, c])
                    at, hit = np.nonzero(part[asks] @ self.x[own[a : a + 8192]].T >= need[asks, None])
                    cut = np.searchsorted(at, np.arange(len(asks) + 1))
                    for i in np.flatnonzero(np.diff(cut)):
                        found[lo + asks[i]].append(own[a + hit[cut[i] : cut[i + 1]]])
        return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


class Block:
    """One block of the index with its ids; equal vectors are one entry of the forest."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, trees: int, depth: int):
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        _, first, inverse = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        members = np.argsort(inverse, kind="stable")
        if len(members) > 1:  # a row delivered twice stays once
            again = (inverse[members][1:] == inverse[members][:-1]) & (ids[members][1:] == ids[members][:-1])
            members = members[np.r_[True, ~again]]
        self.start = np.searchsorted(inverse[members], np.arange(len(first) + 1))
        self.members, self.ids = members, ids
        self.raw = x[first].astype(np.float64)
        self.length = np.sqrt((self.raw**2).sum(1))
        self.forest = Forest((self.raw / self.length[:, None]).astype(np.float32), trees, depth, 23)

    def answer(self, q: np.ndarray, names: np.ndarray, k: int, want: int, complete: bool) -> pa.RecordBatch:
        """The block's k best of every query by exact cosine and id; with ``complete`` none of the block is missed."""
        q = q.astype(np.float64)
        q = q / np.sqrt((q**2).sum(1, keepdims=True))
        unit = q.astype(np.float32)
        pos, cos = self.forest.search(unit, k + 1, want)  # one more, the query itself
        rows = self.forest.rest(unit, cos[:, -1]) if complete else [r[r >= 0] for r in pos]
        out_q, out_id, out_c = [], [], []
        for i, row in enumerate(rows):
            exact = self.raw[row] @ q[i] / self.length[row]
            if len(row) > 4 * k:
                some = exact >= np.partition(exact, len(row) - k - 1)[len(row) - k - 1]
                row, exact = row[some], exact[some]
            best = []
            for p, c in zip(row.tolist(), exact.tolist()):
                best += [(-c, m) for m in self.ids[self.members[self.start[p] : min(self.start[p + 1], self.start[p] + k + 1)]] if m != names[i]]
            for c, m in sorted(best)[:k]:
                out_q.append(names[i])
                out_id.append(m)
                out_c.append(-c)
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.string()), pa.array(out_id, pa.string()), pa.array(out_c, pa.float64())], names=["query_id", "id", "cosine"])


FOUND = "query_id string, id string, cosine double"


def nearest(index: DataFrame, queries: DataFrame, k: int, width: int, *, trees: int = TREES, depth: int = DEPTH, want: int = CANDIDATES, complete: bool = True) -> DataFrame:
    """(query_id, id, cosine, rank): for every query the ``k`` most similar vectors of the index.

    Both inputs have id and embedding; further columns are ignored.  Invalid vectors (null, other width, not
    finite, all zero) are neither found nor asked.  A vector is no neighbour of its own id.  Rows delivered twice
    count once; ties go to the smaller id.  Fewer than ``k`` vectors give fewer rows.

    The index is cut in blocks; a task builds the forest of a block once and answers all queries from it; of the
    blocks' best the best ``k`` are kept.  Up to QUERY_BLOCK queries are broadcast and the index isn't shuffled; more
    are shuffled to every block and streamed past its forest, so that no task or driver holds all queries.  Equal
    vectors of a block are one entry of its arrays, of which the least ids come back, so a crowd of copies can't fill
    the candidates.  Cosines of the results are in doubles from the vectors as given.

    The forest gives a k-th cosine per query.  With ``complete`` the search goes on in all cells of the block that this
    cosine doesn't exclude by the triangle inequality, which makes the answer exact; where neighbours are far
    (cosines under about 0.7) few cells are excluded and a query costs up to one product with the block.
    """
    ask = queries.filter(valid_vector(F.col("embedding"), width) & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), "embedding").dropDuplicates(["id"])
    store = index.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), "embedding")
    if ask.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        found = _few(store, ask, k, width, trees, depth, want, complete)
    else:
        found = _many(store, ask, k, width, trees, depth, want, complete)
    found = found.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _few(store: DataFrame, ask: DataFrame, k: int, width: int, trees: int, depth: int, want: int, complete: bool) -> DataFrame:
    t = ask.orderBy("id").toArrow()
    q, at = raw_vectors(t.column("embedding").combine_chunks(), width) if t.num_rows else (np.zeros((0, width), np.float32), np.zeros(0, np.int64))
    sent = store.sparkSession.sparkContext.broadcast((q, np.array(t.column("id").to_pylist(), dtype=object)[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        xs, ids, size = [], [], 0
        for b in batches if len(q) else ():
            x, at = raw_vectors(b.column("embedding"), width)
            if len(x):
                xs.append(x)
                ids.append(np.array(b.column("id").to_pylist(), dtype=object)[at])
                size += len(x)
            if size >= BLOCK:
                yield Block(np.concatenate(xs), np.concatenate(ids), trees, depth).answer(q, names, k, want, complete)
                xs, ids, size = [], [], 0
        if size:
            yield Block(np.concatenate(xs), np.concatenate(ids), trees, depth).answer(q, names, k, want, complete)

    return store.mapInArrow(run, FOUND)


def _many(store: DataFrame, ask: DataFrame, k: int, width: int, trees: int, depth: int, want: int, complete: bool) -> DataFrame:
    blocks = max(1, -(-store.count() // BLOCK))
    stored = store.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "embedding")
    asked = ask.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, xs, ids, block = None, [], [], None
        for b in batches:
            no, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (no[1:] != no[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = b.slice(lo, hi - lo)
                if no[lo] != at:
                    at, xs, ids, block = no[lo], [], [], None
                x, good = raw_vectors(part.column("embedding"), width)
                if not len(x):
                    continue
                names = np.array(part.column("id").to_pylist(), dtype=object)[good]
                if kind[lo] == 0:
                    xs.append(x)
                    ids.append(names)
                    continue
                if block is None and xs:
                    block = Block(np.concatenate(xs), np.concatenate(ids), trees, depth)
                    xs, ids = [], []
                if block is not None:
                    for a in range(0, len(x), 1024):
                        yield block.answer(x[a : a + 1024], names[a : a + 1024], k, want, complete)

    # Rows of a block come in order: its vectors first, then the queries.
    return stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, FOUND)
