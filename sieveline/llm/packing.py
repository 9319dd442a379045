"""Filling fixed-capacity containers: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save, spread

#: Folder of the tokenizers' vocabulary files, and the file of the default tokenizer (ranks of byte pairs).
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of one block, islands that work on it, rounds between migrations and generations of a round.
BLOCK_ITEMS, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 3, 2, 40, 6
#: Children of a generation, open bins that displaced items may enter by a swap, and generations without a bin saved after which a round ends.
CHILDREN, SWAPS, PATIENCE = 3, 64, 12


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(doc_id, tokens): tokens of the whole text; null and empty texts have 0.  Rows of one doc_id count once."""
    path = os.path.join(folder, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    rows = spread(documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInArrow(run, "doc_id long, tokens long")
    return rows.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, tokens): texts within the capacity whole, longer ones cut into full pieces and a rest."""
    count = F.ceil(F.col("tokens") / capacity).cast("int")
    cut = sizes.filter("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens"))


class Packer:
    """Genomes are arrays bin-of-item; fitness is the mean squared fill of the bins."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.rng = np.random.default_rng(seed)
        self.bound = -(-int(self.sizes.sum()) // capacity)

    def best_fit(self, genome: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Place displaced items (bin -1), largest first, in the fullest bin that takes them."""
        placed = genome >= 0
        load = np.bincount(genome[placed], weights=self.sizes[placed], minlength=int(genome.max(initial=-1)) + 1).astype(np.int64)
        free = sorted((self.capacity - int(w), b) for b, w in enumerate(load) if w > 0)
        new = len(load)
        for i in items[np.argsort(-self.sizes[items], kind="stable")]:
            s = int(self.sizes[i])
            k = bisect_left(free, (s, -1))
            if k < len(free):
                room, b = free.pop(k)
            else:
                room, b = self.capacity, new
                new += 1
            genome[i] = b
            insort(free, (room - s, b))
        return genome

    def load(self, genome: np.ndarray) -> np.ndarray:
        return np.bincount(genome, weights=self.sizes)

    def fitness(self, genome: np.ndarray) -> float:
        w = self.load(genome)
        w = w[w > 0] / self.capacity
        return float((w**2).mean()) if len(w) else 1.0

    def first(self) -> np.ndarray:
        """Best fit on a noisy decreasing order."""
        noise = self.sizes * self.rng.uniform(0.8, 1.25, len(self.sizes))
        genome = np.full(len(self.sizes), -1, np.int64)
        order = np.argsort(-noise, kind="stable")
        cut = self.rng.integers(len(order) // 2, len(order) + 1)
        self.best_fit(genome, order[:cut])
        return self.best_fit(genome, order[cut:])

    def place(self, genome: np.ndarray) -> np.ndarray:
        """Displaced items first take the place of smaller ones where a bin becomes fuller by it, then best fit."""
        out = [int(i) for i in np.flatnonzero(genome < 0)]
        out.sort(key=lambda i: -self.sizes[i])
        bins: dict[int, list[int]] = {}
        for i in np.flatnonzero(genome >= 0):
            bins.setdefault(int(genome[i]), []).append(int(i))
        room = {b: self.capacity - int(self.sizes[own].sum()) for b, own in bins.items()}
        open_ = [b for b, r in room.items() if r > 0]
        self.rng.shuffle(open_)
        for b in open_[:SWAPS]:
            for k, i in enumerate(out):
                d = int(self.sizes[i])
                fits = [j for j in bins[b] if 0 < d - self.sizes[j] <= room[b]]
                if fits:
                    j = min(fits, key=lambda j: self.sizes[j])
                    bins[b].remove(j)
                    bins[b].append(i)
                    room[b] -= d - int(self.sizes[j])
                    genome[i], genome[j], out[k] = b, -1, j
                if not room[b]:
                    break
        return self.best_fit(genome, np.array(out, np.int64))

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inject well-filled bins of b into a; bins of a with an injected item go, their other items are placed anew."""
        w = self.load(b)
        full = np.flatnonzero(w >= np.quantile(w[w > 0], 0.6))
        take = full[self.rng.random(len(full)) < 0.5]
        inject = np.isin(b, take)
        hit = np.unique(a[inject])
        child = np.where(np.isin(a, hit), -1, a)
        child[inject] = b[inject] + a.max() + 1
        _, child = np.unique(np.r_[-1, child], return_inverse=True)
        return self.place(child[1:].astype(np.int64) - 1)

    def mutate(self, genome: np.ndarray) -> np.ndarray:
        """Empty the least filled bin and a few random ones."""
        w = self.load(genome)
        live = np.flatnonzero(w > 0)
        gone = np.r_[live[w[live].argmin()], self.rng.choice(live, min(3, len(live)), replace=False)]
        return self.place(np.where(np.isin(genome, gone), -1, genome))

    def bins(self, genome: np.ndarray) -> int:
        return len(np.unique(genome))

    def evolve(self, population: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """The population after some generations, best first; it ends where no packing has fewer bins, or none was saved for PATIENCE generations."""
        pop = [*population, *(self.first() for _ in range(POPULATION - len(population)))]
        pop.sort(key=self.fitness, reverse=True)
        least, stale = len(self.sizes) + 1, 0
        for _ in range(generations):
            now = self.bins(pop[0])
            stale, least = (0, now) if now < least else (stale + 1, least)
            if now <= self.bound or stale >= PATIENCE:
                break
            children = []
            for _ in range(CHILDREN):
                i, j = (int(self.rng.integers(0, len(pop), 2).min()) for _ in range(2))  # the better of two each
                child = self.cross(pop[i], pop[j]) if i != j else pop[i]
                children.append(self.mutate(child))
            pop = sorted([*pop, *children], key=self.fitness, reverse=True)[:POPULATION]
        return pop


STATE = "container_no long, block int, island int, genomes array<array<int>>, fitness double"


def pack(sizes: DataFrame, containers: DataFrame, *, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """(container_no, bin, doc_id, piece, pieces, tokens): every text of at least one token in one bin per container row.

    sizes: doc_id, tokens; containers: container_no, capacity.  Only a text longer than the capacity is cut (pieces > 1);
    no bin exceeds its capacity.  Null or non-positive capacities have no rows.  Pieces are dealt to blocks by hash; on
    every block several islands evolve and between rounds the best genome of each island goes to the next one.
    The rounds are written to the shared folder; of a block's islands the best packing stays.
    """
    caps = [(r.container_no, r.capacity) for r in containers.select("container_no", "capacity").dropDuplicates(["container_no"]).collect() if r.capacity and r.capacity > 0]  # a handful
    sizes = save(sizes.select("doc_id", "tokens"), "packing-sizes")
    parts = None
    for no, cap in caps:
        p = pieces(sizes, cap).select(F.lit(no).cast("long").alias("container_no"), F.lit(cap).alias("capacity"), "doc_id", "piece", "tokens")
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        return sizes.sparkSession.createDataFrame([], "container_no long, bin string, doc_id long, piece int, pieces int, tokens int")
    n = parts.groupBy("container_no").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_items)).cast("int").alias("blocks"))  # one row per container
    dealt = parts.join(F.broadcast(n), "container_no").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("container_no", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "tokens"))).alias("items"))  # about block_items rows each
    items = save(blocks, "packing-blocks")
    work = items.select("container_no", "capacity", "block", F.col("items.tokens").alias("tokens"))
    state = items.select("container_no", "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.expr("cast(array() as array<array<int>>)").alias("genomes"))
    state = _evolve(work, state, 0)
    for r in range(1, rounds):
        elite = state.select("container_no", "block", ((F.col("island") + 1) % islands).alias("island"), F.col("genomes")[0].alias("elite"))
        moved = state.join(elite, ["container_no", "block", "island"]).select("container_no", "block", "island", F.concat(F.array("elite"), "genomes").alias("genomes"))
        state = _evolve(work, moved, r)
    best = state.groupBy("container_no", "block").agg(F.max_by(F.col("genomes")[0], F.struct("fitness", -F.col("island"))).alias("bin"))
    done = items.join(best, ["container_no", "block"])
    rows = done.select("container_no", "block", F.explode(F.arrays_zip("items", "bin")).alias("x")).select("container_no", F.concat_ws("-", "block", "x.bin").alias("bin"), "x.items.doc_id", "x.items.piece", "x.items.tokens")
    cut = [sizes.filter(F.col("tokens") > cap).select(F.lit(no).cast("long").alias("container_no"), "doc_id", F.ceil(F.col("tokens") / cap).cast("int").alias("pieces")) for no, cap in caps]
    counts = cut[0]
    for c in cut[1:]:
        counts = counts.unionByName(c)
    return rows.join(counts, ["container_no", "doc_id"], "left").select("container_no", "bin", "doc_id", "piece", F.coalesce("pieces", F.lit(1)).alias("pieces"), "tokens")


def _evolve(work: DataFrame, state: DataFrame, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                get = {c: b.column(c)[k] for c in b.schema.names}
                sizes = np.asarray(get["tokens"].values, np.int64)
                block, island = get["block"].as_py(), get["island"].as_py()
                p = Packer(sizes, get["capacity"].as_py(), (block * 1009 + island) * 31 + number)
                pop = p.evolve([np.asarray(g.values, np.int64) for g in get["genomes"]], GENERATIONS)[:3]
                genomes = pa.array([[np.unique(g, return_inverse=True)[1].astype(np.int32) for g in pop]], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in ("container_no", "block", "island")), genomes, pa.array([p.fitness(pop[0])])], names=[*(f.split()[0] for f in STATE.split(", "))])

    # One row is one island, of few bytes and much work: dealt over a fixed number of tasks, which isn't made smaller.
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = state.join(work, ["container_no", "block"]).repartition(tasks, "container_no", "block", "island")
    return save(rows.select("container_no", "block", "island", "genomes", "capacity", "tokens").mapInArrow(run, STATE), "packing-round")


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_no, capacity, bins, bound, tokens, fill): bound is the least number of bins that the tokens need."""
    cap = containers.select("container_no", "capacity").dropDuplicates(["container_no"])
    by = packed.groupBy("container_no", "bin").agg(F.sum("tokens").alias("t")).groupBy("container_no").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"))
    return by.join(cap, "container_no").select("container_no", "capacity", "bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))
