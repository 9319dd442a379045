"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def word_set(text: Column) -> Column:
    """Sorted hashes of the different words."""
    return F.sort_array(F.array_distinct(word_hashes(text)))


def flat_longs(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> column without null lists."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.asarray(arr.offsets, dtype=np.int64)
    return np.asarray(arr.values)[off[0] : off[-1]], off - off[0]


def raw_vectors(col: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Float32 rows of the valid vectors of a list<float> column as given, and their positions.

    Valid: not null, ``width`` numbers (the most common length where width is None), all finite, not all zero.
    """
    n = len(col)
    if not n:
        return np.zeros((0, width or 0), np.float32), np.zeros(0, np.int64)
    off = np.asarray(col.offsets, dtype=np.int64)
    size = np.diff(off)
    size[~np.asarray(col.is_valid())] = -1
    if width is None:
        good = size[size > 0]
        width = int(np.bincount(good).argmax()) if len(good) else 0
    at = np.flatnonzero(size == width)
    flat = np.asarray(col.values.fill_null(float("nan")), dtype=np.float32)
    x = flat[off[at][:, None] + np.arange(width)]
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[ok], at[ok]


def vectors(col: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit float32 rows of the valid vectors of a list<float> column, and their positions."""
    x, at = raw_vectors(col, width)
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))).astype(np.float32), at


def valid_vector(v: Column, width: int) -> Column:
    """Whether a vector has ``width`` finite numbers that are not all zero; false for null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == width) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of integers under a seed (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join that spreads every key of ``left`` over ``salts`` tasks and repeats the rows of ``right``.

    For a left side with hot keys and a right side with few rows per key.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns[:4]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def take_by_rank(rows: DataFrame, keys: list[str], quota: DataFrame, order: Column, buckets: int = 1024) -> DataFrame:
    """The first ``quota`` rows of every key by a hash order, without gathering a key in one task.

    ``quota`` has the keys and ``_take``.  Rows are counted by (key, hash bucket); only the bucket in which the
    quota ends is ranked, so a key with a third of all rows is spread over all tasks.
    """
    h = rows.withColumn("_h", order).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 54).cast("int") % buckets)
    counts = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.sum("_n").over(w)).join(quota, keys).withColumn("_before", F.col("_upto") - F.col("_n"))
    need = upto.filter(F.col("_before") < F.col("_take")).select(*keys, "_b", (F.col("_take") - F.col("_before")).alias("_left"), "_n")
    hit = h.join(need, [*keys, "_b"])
    whole = hit.filter(F.col("_left") >= F.col("_n"))
    rank = Window.partitionBy(*keys, "_b").orderBy("_h")
    part = hit.filter(F.col("_left") < F.col("_n")).withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= F.col("_left")).drop("_r")
    return whole.unionByName(part).drop("_h", "_b", "_left", "_n")


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """A getter of a broadcast object of this package's classes, sent by value: executors can't import them."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        import pickle

        return pickle.loads(sent.value)

    return get
