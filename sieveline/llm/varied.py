"""A varied subset of vectors, and the crowded spots it avoids: mini-batch k-means, quotas, sampling within quotas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save
from .common import take_by_rank, valid_vector, vectors

#: Rows on which the centers are fitted at most; every row is assigned and counted.
FIT_ROWS = 1 << 15
BATCH, PASSES = 1024, 4
#: Mean rows of a cell and most cells; a larger cell is split into blocks.
CELL_ROWS, MAX_CELLS = 256, 4096
#: A vector looks for near ones in every cell whose center is at most this much farther (in cosine) than its nearest.
MARGIN = 0.1
BLOCK = 4096


def fit_centers(rows: DataFrame, width: int, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centers by mini-batch k-means on the FIT_ROWS rows of least id hash (a bounded sample)."""
    few = rows.select("embedding").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_ROWS).toArrow()
    x, _ = vectors(few.column("embedding").combine_chunks(), width) if few.num_rows else (np.zeros((0, width), np.float32), None)
    return minibatch_kmeans(x, cells, seed)


def minibatch_kmeans(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centers on the sphere; each batch moves its nearest centers by their per-center learning rates."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32)
    cells = min(cells, len(x))
    first = np.unique(x, axis=0)
    c = first[rng.permutation(len(first))[:cells]].astype(np.float64)
    seen = np.zeros(len(c))
    for _ in range(PASSES):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            part = x[order[lo : lo + BATCH]]
            near = (part @ c.T.astype(np.float32)).argmax(1)
            n = np.bincount(near, minlength=len(c)).astype(np.float64)
            total = np.zeros_like(c)
            np.add.at(total, near, part)
            hit = n > 0
            seen[hit] += n[hit]
            c[hit] += (total[hit] - n[hit, None] * c[hit]) / seen[hit, None]
            c[hit] /= np.maximum(np.linalg.norm(c[hit], axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def assign(rows: DataFrame, centers: np.ndarray, width: int, margin: float | None) -> DataFrame:
    """(id, cell, home, closeness, embedding as bytes): every valid vector at its nearest center (home) and those within ``margin`` of it."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):  # rows x centers at a time
                part = b.slice(lo, 2048)
                x, at = vectors(part.column("embedding"), width)
                if not len(x):
                    continue
                cos = x @ c.T
                best = cos.argmax(1)
                near = np.zeros(cos.shape, bool) if margin is None else cos >= cos.max(1, keepdims=True) - np.float32(margin)
                near[np.arange(len(x)), best] = True
                row, cell = np.nonzero(near)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(at[row])), pa.array(cell.astype(np.int32)), pa.array(cell == best[row]), pa.array(cos[row, cell].astype(np.float64)), raw.take(pa.array(row))],
                    names=["id", "cell", "home", "closeness", "vec"],
                )

    return rows.select("id", "embedding").mapInArrow(run, "id string, cell int, home boolean, closeness double, vec binary")


def cells_for(count: int) -> int:
    return int(min(MAX_CELLS, max(1, count // CELL_ROWS)))


def _clean(rows: DataFrame, width: int) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("id"), "embedding").filter(F.col("id").isNotNull() & valid_vector(F.col("embedding"), width)).dropDuplicates(["id"])


def crowding(rows: DataFrame, width: int, least: float = 0.9, margin: float = MARGIN) -> DataFrame:
    """(id, near): for every valid vector how many others have at least the cosine ``least`` to it, where any has.

    Each vector is stored in the cell of its nearest center and asks in every cell whose center is within ``margin`` of
    that: vectors near each other have nearly the same cosines to all centers.  A cell is stored in blocks of at most
    about BLOCK rows and asked in blocks as well, so a third of all rows in one spot is spread over many tasks.
    Invalid vectors take no part; of two rows with one id one is taken.
    """
    clean = save(_clean(rows, width), "crowding-vectors")
    centers = fit_centers(clean, width, cells_for(clean.count()))
    placed = save(assign(clean, centers, width, margin), "crowding-cells")
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("stored"), F.count(F.lit(1)).alias("asking"))
    blocks = sizes.select("cell", F.ceil(F.col("stored") / BLOCK).cast("int").alias("sb"), F.ceil(F.col("asking") / (2 * BLOCK)).cast("int").alias("qb")).filter("sb > 0")
    spread = placed.join(F.broadcast(blocks), "cell")  # at most MAX_CELLS rows
    h = F.xxhash64("id")
    stored = spread.filter("home").select("cell", F.pmod(h, "sb").cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(True).alias("is_stored"), "id", "vec")
    asking = spread.select("cell", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), F.pmod(h, "qb").cast("int").alias("q"), F.lit(False).alias("is_stored"), "id", "vec")

    def count(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(t.num_rows, -1)
        there = t.column("is_stored").to_numpy()
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        store, ask = x[there], x[~there]
        names, own = ids[~there], set(ids[there])
        n = np.zeros(len(ask), np.int64)
        for lo in range(0, len(ask), 512):
            n[lo : lo + 512] = (ask[lo : lo + 512] @ store.T >= np.float32(least - 1e-7)).sum(1)
        n -= np.fromiter((i in own for i in names), bool, len(names))  # itself
        hit = n > 0
        return pa.table({"id": pa.array(names[hit], pa.string()), "near": pa.array(n[hit])})

    # Cells without crowding cost one product; the result has only those with any.
    parts = stored.unionByName(asking).groupBy("cell", "s", "q").applyInArrow(count, "id string, near long")
    return parts.groupBy("id").agg(F.sum("near").alias("near"))


def quotas(sizes: list[tuple[int, int]], slots: int, power: float = 0.5) -> dict[int, int]:
    """Slots per cluster in proportion to size ** power (0.5: square root, 0: equal), never above the size.

    Slots that a small cluster can't use go to the others; remainders go to the largest fractions.
    """
    left, out = min(slots, sum(n for _, n in sizes)), {c: 0 for c, _ in sizes}
    room = dict(sizes)
    while left:
        w = {c: n**power if power else 1.0 for c, n in sizes if room[c] > 0}
        total = sum(w.values())
        give = {c: min(room[c], int(left * v / total)) for c, v in w.items()}
        if not any(give.values()):
            for c in sorted(w, key=lambda c: (-w[c], c))[:left]:
                give[c] = 1
        for c, g in give.items():
            out[c] += g
            room[c] -= g
            left -= g
    return out


def mmr(x: np.ndarray, relevance: np.ndarray, k: int, lam: float) -> list[int]:
    """Maximal marginal relevance: lam * relevance - (1 - lam) * greatest cosine to the chosen; ties to the lowest index."""
    chosen: list[int] = []
    worst = np.zeros(len(x))
    free = np.ones(len(x), bool)
    while len(chosen) < min(k, len(x)):
        score = np.where(free, lam * relevance - (1 - lam) * worst, -np.inf)
        i = int(score.argmax())
        chosen.append(i)
        free[i] = False
        c = x @ x[i]
        worst = c if len(chosen) == 1 else np.maximum(worst, c)
    return chosen


def varied_subset(rows: DataFrame, options: DataFrame, width: int, *, power: float = 0.5, spare: int = 4, default_k: int = 20, default_lambda: float = 0.7) -> DataFrame:
    """(option_no, id, cell, rank): for every option a subset of its ``k`` that covers the pool.

    The pool is clustered once; each option's k * ``spare`` slots are shared out over the clusters by size ** ``power``
    (redistributing what small clusters can't use), rows are drawn within the quotas at random by id hash, and of
    the drawn rows k are taken by maximal marginal relevance with the option's lambda, relevance being the closeness
    to the own center.  Null k or lambda mean the defaults; an empty pool gives no rows.
    """
    clean = save(_clean(rows, width), "varied-vectors")
    opts = [(r.option_no, r.k or default_k, default_lambda if r.mmr_lambda is None else r.mmr_lambda) for r in options.select("option_no", "k", "mmr_lambda").dropDuplicates(["option_no"]).collect()]
    cells = min(512, max(cells_for(clean.count()), 2 * max((k for _, k, _ in opts), default=1)))
    placed = save(assign(clean, fit_centers(clean, width, cells), width, None), "varied-cells")
    sizes = [(r.cell, r.n) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 512 cells
    spark = rows.sparkSession
    plan = [(o, c, q, int(k), float(lam)) for o, k, lam in opts for c, q in quotas(sorted(sizes), int(k) * spare, power).items() if q]
    quota = spark.createDataFrame(plan, "option_no long, cell int, _take int, k int, lam double")
    fresh = placed.join(F.broadcast(quota.select("option_no", "cell", "k", "lam")), "cell")
    drawn = take_by_rank(fresh, ["option_no", "cell"], quota.select("option_no", "cell", "_take"), F.xxhash64("id", "option_no"))

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(t.num_rows, -1)
        at = mmr(x.astype(np.float64), t.column("closeness").to_numpy(), t.column("k")[0].as_py(), t.column("lam")[0].as_py())
        got = t.take(pa.array(at))
        return pa.table({"option_no": got.column("option_no"), "id": got.column("id"), "cell": got.column("cell"), "rank": pa.array(np.arange(1, len(at) + 1, dtype=np.int32))})

    return drawn.groupBy("option_no").applyInArrow(choose, "option_no long, id string, cell int, rank int")
