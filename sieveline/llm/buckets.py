"""Candidate pairs from buckets of equal hashes, for texts and vectors alike.

Rows (key, s1, s2[, side]) name a record by its sketch of 128 bits and its size, which stands in the low bits of the key, so
that what is compared is all that is shuffled; callers join the sketches to their records afterwards.  Rows are hash partitioned and sorted by key; each task streams its rows and compares
within runs of one key, so it holds one chunk at a time.  A run longer than ``HOT`` is handed on, with all it needs for
comparing: its members are hashed again more finely, or compared in pairs of blocks, each a task of its own.  No
bucket is bound to one task and none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save
from .common import mix

#: Members of a run that one task compares at most; rows that it takes at a time.
HOT, CHUNK = 4096, 1 << 18
#: Bytes of a row in a shuffle.
ROW_BYTES = 24
#: Sets of more members are sketched by the lowest bits of minima instead of by parities.
LONG = 128
#: Of the 128 bits of two such sketches at Jaccard similarity 0.7 19.2 differ on average, with a deviation of 4.0.
LONG_SLACK = 35
#: The two ends of a pair.
ENDS = ("a1", "a2", "an", "b1", "b2", "bn")
#: A pair has key 0; a member of a hot run is in a, its side in b1.
PAIRS = "key long, a1 long, a2 long, an int, b1 long, b2 long, bn int"


def minhash(flat: np.ndarray, off: np.ndarray, count: int, seed: int, chunk: int = 1 << 12) -> np.ndarray:
    """(sets, count) uint32 minima of ``count`` hash functions; sets are non-empty slices of ``flat``.

    ``chunk`` members are looked up at a time, so that they and their minima stay in the processor's cache.
    """
    vocab, inv = np.unique(flat, return_inverse=True)
    table = np.empty((len(vocab), count), np.uint32)
    for j in range(count):
        table[:, j] = (mix(vocab, seed + j) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, count), np.uint32)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk, side="right")) - 1)
        out[lo:hi] = np.minimum.reduceat(table[inv[off[lo] : off[hi]]], off[lo:hi] - off[lo], axis=0)
        lo = hi
    return out


#: Bits of a key that hold the size; the others name the bucket: of 10^11 rows few share one by chance, and near() sorts those out.
SIZE_BITS = 24


def with_size(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys whose upper 40 bits name a bucket, never 0, and whose lower 24 hold a size.

    The size's lowest byte stands highest, so that the zeros of a small one come first and cost no bytes in a shuffle.
    """
    bucket = key.view(np.uint64) >> np.uint64(SIZE_BITS)
    return (np.maximum(bucket, np.uint64(1)) << np.uint64(SIZE_BITS) | _turned(np.minimum(n, (1 << SIZE_BITS) - 1)).astype(np.uint64)).view(np.int64)


def _turned(n: np.ndarray) -> np.ndarray:
    """The three bytes of a size in the other order."""
    return (n & 0xFF) << 16 | n & 0xFF00 | n >> 16 & 0xFF


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) int64 keys, each of ``rows`` minima and the band's number."""
    keys = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(minima), b + 1, np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            acc = mix(acc ^ minima[:, c].astype(np.uint64), 77)
        keys[:, b] = acc
    return keys.view(np.int64)


def sketches(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, 2) int64 sketch of every set of ``flat`` and the sizes; repeated members count once.

    Up to LONG members: per one of 128 hash values whether an odd number of members has it; two sets differ in at
    least as many members as these bits differ.  Above: the lowest bits of 128 minima, of which (1 + Jaccard) / 2 agree.
    """
    f, d = flat, np.repeat(np.arange(len(off) - 1), np.diff(off))
    if not ((f[1:] > f[:-1]) | (d[1:] != d[:-1])).all():
        order = np.lexsort((f, d))
        f, d = f[order], d[order]
        fresh = np.ones(len(f), bool)
        fresh[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
        f, d = f[fresh], d[fresh]
    n = np.bincount(d, minlength=len(off) - 1)
    bits = (np.bincount(d * 128 + (mix(f, 3) >> np.uint64(57)).astype(np.int64), minlength=(len(off) - 1) * 128) & 1).astype(np.uint8).reshape(-1, 128)
    long = np.flatnonzero(n > LONG)
    if len(long):
        own = np.isin(d, long)
        bits[long] = minhash(f[own], np.r_[0, np.cumsum(n[long])], 128, 1000) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64), n


def recall(similarity: float, bands: int, rows: int) -> float:
    """Share of the pairs of a similarity that meet in at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def run_pairs(starts: np.ndarray, ends: np.ndarray, first: np.ndarray | None, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of the pairs within runs, about ``most`` at a time: x < y, or x before ``first`` of its run and y from it on."""
    length = ends - starts
    if first is None:
        x = np.arange(starts[0], ends[-1]) if len(starts) else np.zeros(0, np.int64)
        low, count = x + 1, np.repeat(ends, length) - x - 1
    else:
        zeros = first - starts
        x = np.repeat(starts - np.r_[0, np.cumsum(zeros)[:-1]], zeros) + np.arange(zeros.sum())
        low, count = np.repeat(first, zeros), np.repeat(ends - first, zeros)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(x):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + most, side="right")))
        c = count[lo:hi]
        within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(x[lo:hi], c), np.repeat(low[lo:hi], c) + within
        lo = hi


#: A filter of pairs: columns and positions x, y to the positions that may be near.
Filter = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def differing(cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 128 bits differ."""
    return np.bitwise_count((cols["s1"][x] ^ cols["s1"][y]).view(np.uint64)) + np.bitwise_count((cols["s2"][x] ^ cols["s2"][y]).view(np.uint64))


class AlikeSets:
    """Sets that may reach a Jaccard similarity, by size and sketch; parities lose no pair, minima 1 in 10,000."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t, n = self.threshold, cols["n"]
        nx, ny = n[x].astype(np.float32), n[y].astype(np.float32)
        most = (1 - t) / (1 + t) * (nx + ny) + 1e-3
        big = (nx > LONG).astype(np.int8) + (ny > LONG)
        most[big == 1], most[big == 2] = 128, LONG_SLACK
        return (differing(cols, x, y) <= most) & (np.minimum(nx, ny) >= t * np.maximum(nx, ny) - 1e-3)


class AlikeSigns:
    """Vectors of which at most ``most`` of 128 hyperplane signs differ."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return differing(cols, x, y) <= self.most


def _pairs(cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Different (a1, a2, an, b1, b2, bn) of the positions."""
    ends = np.stack([cols[c][i].astype(np.int64) for i in (x, y) for c in ("s1", "s2", "n")], 1)
    return np.unique(ends, axis=0) if len(ends) else ends


def _batch(ends: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ends), np.int64) if key is None else key), *(pa.array(ends[:, i].astype(k.to_pandas_dtype()), k) for i, k in enumerate(kinds))], names=["key", *ENDS])


def _members(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    zero = np.zeros(len(cols["key"]), np.int64)
    return _batch(np.stack([cols["s1"], cols["s2"], cols["n"].astype(np.int64), cols["side"].astype(np.int64), zero, zero], 1), cols["key"])


def candidates(rows: DataFrame, name: str, near: Filter, *, sided: bool = False, refine: Callable[[DataFrame], DataFrame] | None = None, expected: int = 0) -> DataFrame:
    """Different pairs (a1, a2, an, b1, b2, bn) of sketches and sizes that share a key and pass ``near``; written to the shared folder.

    sided: only pairs of side 0 (a) with side 1 (b); else different sketches or sizes, a < b.  Repeated rows
    count once.  rows: (key, s1, s2[, side]) with keys of ``with_size``.  refine: of the members (s1, s2, n) of hot runs, rows with finer
    keys, whose runs are compared instead; without it a hot run is compared in pairs of blocks.  expected: about how
    many rows there are, for the number of partitions where the session's is too small.
    """
    use = rows.select("key", "s1", "s2", *([F.col("side").cast("byte").alias("side")] if sided else []))

    def tidy(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((cols["n"], cols["s2"], cols["s1"], cols["side"], cols["key"]))
        cols = {c: v[order] for c, v in cols.items()}
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in cols.values()], axis=0)
        return {c: v[fresh] for c, v in cols.items()}

    def compare(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs of the whole runs in ``cols``; the members of hot ones."""
        cols = tidy(cols)
        key = cols["key"]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        hot = ends - starts > HOT
        for lo, hi in zip(starts[hot].tolist(), ends[hot].tolist()):
            yield _members({c: v[lo:hi] for c, v in cols.items()})
        first = starts + np.add.reduceat((cols["side"] == 0).astype(np.int64), starts)
        keep = ~hot & ((first > starts) & (first < ends) if sided else ends - starts > 1)
        take, length = np.repeat(keep, ends - starts), (ends - starts)[keep]
        if not len(length):
            return
        cols = {c: v[take] for c, v in cols.items()}
        first = (first - starts)[keep]
        ends = np.cumsum(length)
        starts = ends - length
        out, size = [], 0
        for x, y in run_pairs(starts, ends, starts + first if sided else None):
            ok = near(cols, x, y)
            if ok.any():
                out.append(_pairs(cols, x[ok], y[ok]))
                size += len(out[-1])
            if size > 1 << 19:
                yield _batch(np.unique(np.concatenate(out), axis=0))
                out, size = [], 0
        if out:
            yield _batch(np.unique(np.concatenate(out), axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size, hot = 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, hot
            cols = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held, size = [], 0
            if hot:  # the run goes on
                n = int(np.searchsorted(cols["key"], hot, side="right"))
                if n:
                    yield _members({c: v[:n] for c, v in cols.items()})
                    cols = {c: v[n:] for c, v in cols.items()}
                if not len(cols["key"]):
                    return
                hot = 0
            cut = len(cols["key"]) if last else int(np.searchsorted(cols["key"], cols["key"][-1]))
            if cut < len(cols["key"]):
                tail = tidy({c: v[cut:] for c, v in cols.items()})
                if len(tail["key"]) > HOT:
                    hot = int(tail["key"][0])
                    yield _members(tail)
                else:
                    held, size = [tail], len(tail["key"])
            if cut:
                yield from compare({c: v[:cut] for c, v in cols.items()})

        for b in batches:
            if b.num_rows:
                get = {"side": np.zeros(b.num_rows, np.int8)} | {c: b.column(c).to_numpy() for c in b.schema.names}
                held.append(get | {"key": get["key"] >> SIZE_BITS, "n": _turned(get["key"] & ((1 << SIZE_BITS) - 1)).astype(np.int32)})
                size += b.num_rows
                if size >= CHUNK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    parts = expected * ROW_BYTES >> 26  # of 64 MB
    few = parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.shiftright("key", SIZE_BITS)
    raw = save((use.repartition(bucket) if few else use.repartition(parts, bucket)).sortWithinPartitions("key").mapInArrow(run, PAIRS), name)
    pairs = raw.filter(F.col("key") == 0).select(*ENDS)
    hot = raw.filter(F.col("key") != 0).select("key", F.col("a1").alias("s1"), F.col("a2").alias("s2"), F.col("an").alias("n"), F.col("b1").cast("byte").alias("side"))
    if hot.isEmpty():
        return pairs.distinct()
    if refine is not None:
        more = candidates(refine(hot.select("s1", "s2", "n").distinct()), f"{name}-finer", near, sided=sided)
    else:
        more = _in_blocks(hot, near, sided)
    return pairs.unionByName(more).distinct()


def _in_blocks(hot: DataFrame, near: Filter, sided: bool) -> DataFrame:
    """Pairs of hot runs: every run is cut in blocks of about HOT members and each pair of blocks is one group."""
    sizes = hot.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    blocks = sizes.select("key", F.greatest(F.lit(1), F.ceil(F.col("n0") / HOT)).cast("int").alias("c0"), F.greatest(F.lit(1), F.ceil(F.col("n1") / HOT)).cast("int").alias("c1"))
    own = F.pmod(F.xxhash64("s1", "s2", "n"), F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c1"))).cast("int")
    each = hot.distinct().join(blocks, "key").withColumn("own", own)
    if sided:
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("c1")).otherwise(F.col("c0")) - 1))
        placed = each.withColumn("other", other).withColumn("i", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    else:
        placed = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c0") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cols = {c: t.column(c).to_numpy() for c in ("s1", "s2", "n", "side", "own")}
        second = cols["side"] if sided else (cols["own"] != i).astype(np.int64)
        order = np.lexsort((cols["n"], cols["s2"], cols["s1"], second))
        cols, cut = {c: v[order] for c, v in cols.items()}, int((second == 0).sum())
        out = []
        for x, y in run_pairs(np.array([0]), np.array([len(order)]), np.array([cut]) if sided or i != j else None):
            ok = near(cols, x, y)
            if ok.any():
                x, y = x[ok], y[ok]
                if not sided:
                    turn = np.array([a > b for a, b in zip(zip(*(cols[c][x].tolist() for c in ("s1", "s2", "n"))), zip(*(cols[c][y].tolist() for c in ("s1", "s2", "n"))))])
                    x, y = np.where(turn, y, x), np.where(turn, x, y)
                out.append(_pairs(cols, x, y))
        b = _batch(np.concatenate(out) if out else np.zeros((0, 6), np.int64))
        return pa.Table.from_batches([b]).drop_columns(["key"])

    return placed.groupBy("key", "i", "j").applyInArrow(compare, PAIRS.removeprefix("key long, "))


def ends(pairs: DataFrame) -> DataFrame:
    """Different (s1, s2, n) of the pairs."""
    return pairs.select(F.explode(F.array(*(F.struct(F.col(f"{e}1").alias("s1"), F.col(f"{e}2").alias("s2"), F.col(f"{e}n").alias("n")) for e in "ab"))).alias("e")).select("e.*").distinct()


def named(records: DataFrame, end: str) -> DataFrame:
    """Records with s1, s2, n as those of one end of a pair."""
    return records.withColumnsRenamed({"s1": f"{end}1", "s2": f"{end}2", "n": f"{end}n"})


#: Sketches up to which a list of them is broadcast (about 40 MB); beyond it the join shuffles.
BROADCAST_SKETCHES = 1 << 19


def records_of(records: DataFrame, used: DataFrame) -> DataFrame:
    """The records whose sketch and size are in ``used`` (s1, s2, n)."""
    return records.join(F.broadcast(used) if used.limit(BROADCAST_SKETCHES + 1).count() <= BROADCAST_SKETCHES else used, ["s1", "s2", "n"], "left_semi")
