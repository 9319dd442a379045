"""Content-addressed embedding cache: a Parquet table by SHA-256 of the truncated text, and the flat binary format."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import truncate_text

SCHEMA = "key string, embedding array<float>"
#: Bytes of a key, characters of its line in the older layout, and records that a task reads.
KEY_BYTES, KEY_LINE, RANGE = 32, 65, 1 << 14


class EmbeddingCache:
    """Append-only; readers take one row per key, so two writers that embed the same text do no harm."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame], max_chars: int | None = None):
        """``embed`` maps (key, text) to (key, embedding)."""
        self.spark, self.path, self.embed, self.max_chars = spark, path, embed, max_chars

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def keyed(self, texts: DataFrame, text: str = "text") -> DataFrame:
        short = truncate_text(F.col(text), self.max_chars) if self.max_chars else F.col(text)
        return texts.withColumn("_short", short).withColumn("key", F.sha2("_short", 256))

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """(key, text) of the different non-null texts that the cache lacks."""
        k = self.keyed(texts, text).filter(F.col("_short").isNotNull()).select("key", F.col("_short").alias("text")).dropDuplicates(["key"])
        return k.join(self.read().select("key"), "key", "left_anti")

    def embed_many(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """The rows with key and embedding; missing texts are embedded once each and appended. Null texts have null embeddings."""
        self.embed(self.missing(texts, text)).select("key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(self.path)
        return self.keyed(texts, text).drop("_short").join(self.read().dropDuplicates(["key"]), "key", "left")


@contextmanager
def locked(path: str, patience: float = 60.0) -> Iterator[None]:
    """One writer of a file at a time: a lock file beside it, waited for; after the patience it is an error."""
    lock, began = f"{path}.lock", time.monotonic()
    while True:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.monotonic() - began > patience:
                raise TimeoutError(f"{lock} is held by another writer") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        os.unlink(lock)


def record_size(dimensions: int) -> int:
    return KEY_BYTES + 4 * dimensions


def write_binary(rows: list[tuple[str, list[float]]], path: str) -> None:
    """Append records of a 32-byte SHA-256 key and little-endian float32 numbers; what an interrupted writer left is cut off first."""
    if not rows:
        return
    size = record_size(len(rows[0][1]))
    if any(record_size(len(v)) != size for _, v in rows):
        raise ValueError("vectors of one cache have one width")
    with locked(path):
        have = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "r+b" if have else "wb") as f:
            f.truncate(have - have % size)
            f.seek(0, os.SEEK_END)
            for key, v in rows:
                f.write(bytes.fromhex(key) + struct.pack(f"<{len(v)}f", *v))


def _by_ranges(spark: SparkSession, count: int, read) -> DataFrame:
    """(key, embedding) of the records that ``read`` gives for [start, stop): tasks read their own ranges, the driver none."""
    tasks = max(1, -(-count // RANGE))
    return spark.sparkContext.parallelize(range(tasks), tasks).flatMap(lambda t: read(t * RANGE, min(count, (t + 1) * RANGE))).toDF(SCHEMA)


def read_binary(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(key, embedding) of a binary cache on a path that all executors see; an incomplete last record is left out."""
    size = record_size(dimensions)

    def read(start: int, stop: int) -> Iterator[tuple[str, list[float]]]:
        with open(path, "rb") as f:
            f.seek(start * size)
            data = f.read((stop - start) * size)
        for i in range(0, len(data) - size + 1, size):
            yield data[i : i + KEY_BYTES].hex(), list(struct.unpack(f"<{dimensions}f", data[i + KEY_BYTES : i + size]))

    return _by_ranges(spark, os.path.getsize(path) // size, read)


def read_two_files(spark: SparkSession, base: str, dimensions: int) -> DataFrame:
    """(key, embedding) of the older layout: <base>.keys with a key a line, <base>.f32 with the numbers, up to the last whole pair."""
    with open(f"{base}.keys", "rb") as f:
        keys = f.read().count(b"\n")  # every line is a key of 64 digits
    wide = 4 * dimensions

    def read(start: int, stop: int) -> Iterator[tuple[str, list[float]]]:
        with open(f"{base}.keys", "rb") as f, open(f"{base}.f32", "rb") as g:
            f.seek(start * KEY_LINE)
            g.seek(start * wide)
            for _ in range(start, stop):
                yield f.read(KEY_LINE).decode().strip(), list(struct.unpack(f"<{dimensions}f", g.read(wide)))

    return _by_ranges(spark, min(keys, os.path.getsize(f"{base}.f32") // wide), read)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(key, embedding) of a JSON cache {key: [numbers]}, one document, so of limited size; missing files are empty."""
    if not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<float>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "embedding"))


def write_json(rows: list[tuple[str, list[float]]], path: str) -> None:
    """Add entries to a JSON cache; those of other writers stay, ours win, and readers never see half a file."""
    with locked(path):
        have = {}
        if os.path.exists(path):
            with open(path) as f:
                have = json.load(f)
        with open(f"{path}.{os.getpid()}.tmp", "w") as f:
            json.dump(have | dict(rows), f)
        os.replace(f"{path}.{os.getpid()}.tmp", path)


def text_key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
