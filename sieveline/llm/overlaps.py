"""Same or near-same records across splits: winnowed fingerprints and banded minima for texts, hyperplane bands for vectors."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save
from .buckets import SIZE_BITS, AlikeSets, AlikeSigns, band_keys, candidates, ends, minhash, named, records_of, with_size
from .common import flat_longs, mix, valid_vector, vectors, word_hashes
from .near_duplicates import BANDS, FINE_BANDS, FINE_ROWS, ROWS, sketched

#: Words of a seed of the alignment; words of a fingerprint and fingerprints of a window: a shared run of PRINT + WINDOW - 1 words is never missed.
GRAM, PRINT, WINDOW = 3, 8, 8
#: Hyperplane bands: at cosine 0.95 a pair meets with probability 0.98, at 0.97 with 0.998.
BITS, VECTOR_BANDS, SIGNS = 16, 20, 128
#: Members of a class that one task joins at most.
CLASS_BLOCK = 4096
#: Of 128 signs at cosine 0.95 12.9 differ on average, with a deviation of 3.4.
SIGN_SLACK = 27


def grams(flat: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of k words at every position and whether the gram lies within one text."""
    if len(flat) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.zeros(len(flat) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat.view(np.uint64)[j : len(flat) - k + 1 + j]
    h = mix(h, 5)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return h, doc[: len(h)] == doc[k - 1 :]


def winnow(h: np.ndarray, inside: np.ndarray, doc: np.ndarray, rank: np.ndarray | None, window: int) -> np.ndarray:
    """Positions of the window minima, by (rank, hash); the leftmost of equal ones.

    ``doc`` is the text of every position.  A text of fewer grams than a window gives its least gram.
    """
    top = (mix(h, 9) >> np.uint64(8)).astype(np.uint64)
    order = top if rank is None else (np.minimum(rank, 255).astype(np.uint64) << np.uint64(56)) | top
    order = np.where(inside, order, np.uint64(0xFFFFFFFFFFFFFFFF))
    n = len(order)
    best, at = order.copy(), np.arange(n)
    for d in range(1, window):
        if d >= n:
            break
        better = np.zeros(n, bool)
        same = doc[: n - d] == doc[d:]
        better[: n - d] = same & inside[d:] & (order[d:] < best[: n - d])
        src = np.flatnonzero(better)
        best[src], at[src] = order[src + d], src + d
    # A window that runs over the end of its text counts only where the text has no whole window.
    first = np.r_[True, doc[1:] != doc[:-1]]
    whole = np.zeros(n, bool)
    if n >= window:
        whole[: n - window + 1] = (doc[: n - window + 1] == doc[window - 1 :]) & inside[window - 1 :]
    use = (whole | first) & inside
    return np.unique(at[use])


def _tables(records: DataFrame, sides: dict[str, int]) -> DataFrame:
    """(id, side, ck, seq, s1, s2, n) of the records of both sides, written to the shared folder."""
    side = F.create_map(*(x for k, v in sides.items() for x in (F.lit(k), F.lit(v))))[F.col("role")]
    rows = records.select("id", side.cast("int").alias("side"), word_hashes(F.col("text")).alias("seq")).filter(F.col("side").isNotNull() & (F.size("seq") > 0) & F.col("id").isNotNull())
    return save(sketched(rows.withColumn("ck", F.xxhash64("seq")), "seq", "id string, side int, ck long, seq array<long>"), "overlap-texts")


PRINTS = "key long, s1 long, s2 long, side int"


def fingerprints(texts: DataFrame, bands: int = BANDS, rows: int = ROWS, winnowed: bool = True) -> DataFrame:
    """(key, s1, s2, side): the winnowed rolling hashes of every text and its bands of minima; a task sends a class once.

    Winnowing alone meets for certain only at a long shared run.  Texts that are alike without one (edits all over,
    moved sentences, few words) share a band of the minima over their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            for i, x in enumerate(zip(b.column("ck").to_pylist(), b.column("side").to_pylist())):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            b = b.filter(pa.array(new))
            if not b.num_rows:
                continue
            flat, off = flat_longs(b.column("seq"))
            least = minhash(flat, off, bands * rows, 0)
            found = [(band_keys(least, bands, rows).ravel(), np.repeat(np.arange(len(least)), bands))]
            if winnowed:
                h, inside = grams(flat, off, PRINT)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(h)]
                at = winnow(h, inside, doc, None, WINDOW)
                found.append((h[at].view(np.int64), doc[at]))
            for key, d in found:
                key = with_size(np.ascontiguousarray(key), b.column("n").to_numpy()[d])
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(b.column(c).to_numpy()[d]) for c in ("s1", "s2", "side"))], names=["key", "s1", "s2", "side"])

    return texts.select("seq", "ck", "s1", "s2", "n", "side").mapInArrow(run, PRINTS)


def _hits(a: np.ndarray, b: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common seeds: the first of a seed in a with the first in b, the second with the second, and so on."""
    if min(len(a), len(b)) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = []
    for x in (a, b):
        h, _ = grams(x, np.array([0, len(x)]), gram)
        order = np.argsort(h, kind="stable")
        s = h[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        turn = np.empty(len(h), np.uint64)
        turn[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
        keys.append(mix(h ^ (turn << np.uint64(40)), 4))
    _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    return i[order], j[order]


def align(a: np.ndarray, b: np.ndarray, gram: int) -> tuple[int, int, int]:
    """Chain common seeds of two word sequences and extend them; (words of a covered, of b covered, longest run).

    Seeds are chained collinearly (increasing in both sequences, longest chain by patience sorting); the gaps
    between chained seeds and the outer ends are extended word by word while they agree from either side.  A seed that
    repeats meets its repetitions in order, so there are no more seeds than words.
    """
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    at, to = (x.tolist() for x in _hits(a, b, gram))
    tails: list[int] = []
    last: list[int] = []
    prev = [-1] * len(at)
    for x, j in enumerate(to):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            last.append(x)
        else:
            tails[p], last[p] = j, x
        prev[x] = last[p - 1] if p else -1
    chain, x = [], last[-1] if last else -1
    while x >= 0:
        chain.append((at[x], to[x]))
        x = prev[x]
    chain.reverse()
    ca, cb = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i, j in chain:
        ca[i : i + gram], cb[j : j + gram] = True, True
    for i, j in chain:  # extension to both sides of every seed
        for step, (p, q) in ((1, (i + gram, j + gram)), (-1, (i - 1, j - 1))):
            while 0 <= p < len(a) and 0 <= q < len(b) and not ca[p] and not cb[q] and a[p] == b[q]:
                ca[p] = cb[q] = True
                p, q = p + step, q + step
    edges = np.diff(np.r_[0, ca.astype(np.int8), 0])
    runs = np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)
    return int(ca.sum()), int(cb.sum()), int(runs.max()) if len(runs) else 0


def text_overlaps(texts: DataFrame, threshold: float, min_words: int, gram: int = GRAM) -> DataFrame:
    """(a, b, common, coverage_a, coverage_b, longest_run) for classes of equal texts a (side 0) and b (side 1)."""
    long = texts.filter(F.col("n") >= min_words)

    def finer(hot: DataFrame) -> DataFrame:
        return fingerprints(records_of(long, hot), FINE_BANDS, FINE_ROWS, False)

    near = save(candidates(fingerprints(long), "overlap-prints", AlikeSets(threshold), sided=True, refine=finer, expected=texts.count() * 2 * BANDS), "overlap-near")
    w = save(records_of(long, ends(near)).select("s1", "s2", "n", "side", "ck", "seq").dropDuplicates(["side", "ck"]), "overlap-sequences")
    side = lambda k, e: named(w.filter(F.col("side") == k).drop("side").withColumnsRenamed({"ck": e, "seq": f"w{e}"}), e)
    both = near.join(side(0, "a"), ["a1", "a2", "an"]).join(side(1, "b"), ["b1", "b2", "bn"]).select("a", "b", "wa", "wb")
    shared = F.size(F.array_intersect("wa", "wb")).cast("double")
    both = both.withColumn("common", shared / (F.size(F.array_distinct("wa")) + F.size(F.array_distinct("wb")) - shared)).filter(F.col("common") >= threshold - 1e-12)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            (fa, oa), (fb, ob) = flat_longs(t.column("wa")), flat_longs(t.column("wb"))
            got = np.array([align(fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]], gram) for i in range(t.num_rows)], np.int64).reshape(-1, 3)
            cols = [t.column("a"), t.column("b"), t.column("common"), pa.array(got[:, 0] / np.diff(oa)), pa.array(got[:, 1] / np.diff(ob)), pa.array(got[:, 2].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "common", "coverage_a", "coverage_b", "longest_run"])

    return both.mapInArrow(extend, "a long, b long, common double, coverage_a double, coverage_b double, longest_run int")


def planes(width: int, count: int, seed: int) -> np.ndarray:
    """(width, count) hyperplane normals, orthogonal in groups of ``width`` where possible."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-count // width))]
    return np.concatenate(parts, axis=1)[:, :count].astype(np.float32)


def signed(rows: DataFrame, width: int) -> DataFrame:
    """Rows (id, side, ck, embedding) of valid vectors with s1 and s2, the signs towards 128 hyperplanes, and n = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(width, SIGNS, 12)
        for b in batches:
            x, at = vectors(b.column("embedding"), width)
            if len(x):
                b = b.take(pa.array(at))
                s = np.packbits((x @ p > 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "side", "ck", "embedding")), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(np.ones(len(x), np.int32))], names=["id", "side", "ck", "embedding", "s1", "s2", "n"])

    return rows.select("id", "side", "ck", "embedding").mapInArrow(run, "id string, side int, ck long, embedding array<float>, s1 long, s2 long, n int")


def vector_bands(rows: DataFrame, width: int, bits: int = BITS, bands: int = VECTOR_BANDS) -> DataFrame:
    """(key, s1, s2, side) of every vector of ``signed`` rows: ``bands`` keys of ``bits`` signs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(width, bits * bands, 11)
        for b in batches:
            x, at = vectors(b.column("embedding"), width)
            if len(x):
                code = (x @ p > 0).astype(np.uint8).reshape(len(x), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                key = with_size((code + 1 + (np.arange(bands, dtype=np.int64) << (bits + 1))) << SIZE_BITS, np.ones((len(x), 1), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(b.column(c).to_numpy()[at], bands)) for c in ("s1", "s2", "side"))], names=["key", "s1", "s2", "side"])

    return rows.select("embedding", "s1", "s2", "side").mapInArrow(run, PRINTS)


def vector_overlaps(rows: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, cosine) for classes of equal vectors, a of side 0 and b of side 1, with at least the cosine.

    ``rows``: (ck, side, embedding, s1, s2, n) of ``signed`` vectors.
    """
    near = save(candidates(vector_bands(rows, width), "overlap-signs", AlikeSigns(SIGN_SLACK), sided=True), "overlap-signs-near")
    v = records_of(rows, ends(near)).select("s1", "s2", "n", "side", "ck", "embedding").dropDuplicates(["side", "ck"])
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = v.withColumn("e", e).withColumn("l", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))).drop("embedding")
    side = lambda k, end: named(v.filter(F.col("side") == k).drop("side").withColumnsRenamed({"ck": end, "e": f"e{end}", "l": f"l{end}"}), end)
    both = near.join(side(0, "a"), ["a1", "a2", "an"]).join(side(1, "b"), ["b1", "b2", "bn"])
    dot = F.aggregate(F.zip_with("ea", "eb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("a", "b", (dot / (F.col("la") * F.col("lb"))).alias("cosine")).filter(F.col("cosine") >= least)


def of_members(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b, ...) of classes as links of the members (id, side, ck): id_0 of side 0 in a, id_1 of side 1 in b.

    A class of many members is cut in blocks of about CLASS_BLOCK; a link is repeated for every pair of blocks.
    """
    sizes = members.groupBy("side", "ck").agg(F.ceil(F.count(F.lit(1)) / CLASS_BLOCK).cast("int").alias("cut"))
    placed = members.join(sizes, ["side", "ck"]).withColumn("block", F.pmod(F.xxhash64("id"), "cut").cast("int"))
    for side, end in (("0", "a"), ("1", "b")):
        cut = sizes.filter(f"side = {side}").select(F.col("ck").alias(end), F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block"))
        own = placed.filter(f"side = {side}").select(F.col("id").alias(f"id_{side}"), F.col("ck").alias(end), "block")
        links = links.join(cut, end).join(own, [end, "block"]).drop("block", end)
    return links


def split_overlaps(
    records: DataFrame, embedded: DataFrame, sides: dict[str, int], *, threshold: float = 0.7, min_words: int = 8, least_cosine: float = 0.95, width: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Overlaps of records of side 0 (training) with records of side 1 (evaluation).

    records: id, text, role, kind; embedded: id, embedding; further columns are ignored.  Roles outside ``sides``
    take no part.  First result (id_a, id_b, id_0, id_1, common, coverage_0, coverage_1, longest_run, cosine), one
    row per pair; text measures are null for a pair found by vector only, cosine is null for one found by text only.
    Second: per record of side 1 that overlaps (id, role, kind, partners, best_common, best_coverage, best_cosine).
    Null, empty and short texts, invalid vectors and rows without id overlap with nothing; repeated rows count once.
    """
    use = records.select(F.col("id").cast("string").alias("id"), "text", "role", "kind")
    texts = _tables(use, sides)
    member = texts.select("id", "side", "ck").distinct()
    t = of_members(text_overlaps(texts, threshold, min_words), member).dropDuplicates(["id_0", "id_1"])

    side = F.create_map(*(x for k, v in sides.items() for x in (F.lit(k), F.lit(v))))[F.col("role")]
    sided = use.select("id", side.cast("int").alias("side")).filter("side is not null").distinct()
    vec = embedded.select(F.col("id").cast("string").alias("id"), "embedding").filter(valid_vector(F.col("embedding"), width))
    vec = save(signed(vec.join(sided, "id").withColumn("ck", F.xxhash64("embedding")), width), "overlap-embedded")
    vm = vec.select("id", "side", "ck").distinct()
    v = of_members(vector_overlaps(vec, width, least_cosine), vm).groupBy("id_0", "id_1").agg(F.max("cosine").alias("cosine"))

    pairs = t.join(v, ["id_0", "id_1"], "full").filter(F.col("id_0") != F.col("id_1"))
    pairs = pairs.select(F.least("id_0", "id_1").alias("id_a"), F.greatest("id_0", "id_1").alias("id_b"), "id_0", "id_1", "common", F.col("coverage_a").alias("coverage_0"), F.col("coverage_b").alias("coverage_1"), "longest_run", "cosine")
    pairs = save(pairs, "overlaps")
    per = pairs.groupBy(F.col("id_1").alias("id")).agg(F.count(F.lit(1)).alias("partners"), F.max("common").alias("best_common"), F.max("coverage_1").alias("best_coverage"), F.max("cosine").alias("best_cosine"))
    who = use.select("id", "role", "kind").dropDuplicates(["id"])
    return pairs, per.join(who, "id").select("id", "role", "kind", "partners", "best_common", "best_coverage", "best_cosine")
