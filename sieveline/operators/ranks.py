"""Exact ranks within keys without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hex_bucket(order: Column) -> Column:
    """The first three hexadecimal digits of a hash order: 4,096 buckets in that order."""
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("long")


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str = "_r") -> DataFrame:
    """Rows with their 1-based place ``out`` within ``keys`` by ``order``.

    ``bucket`` is a whole number that doesn't fall along the order (by hash or by range).  Rows are counted per key
    and bucket; only a bucket is ranked in one task, and starts at the count of the buckets before it.  Keys may be null.
    """
    b = rows.withColumn("_bucket", bucket)
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_bucket").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    placed = b.withColumn(out, F.row_number().over(inside)).join(starts, same)
    return placed.withColumn(out, F.col(out) + F.col("_start")).drop("_bucket", "_kb", "_start", *(f"_k{i}" for i in range(len(keys))))
