"""Sums of vectors over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Partitions beyond which sums are added in groups first.
WIDE = 64


def add_up(rows: DataFrame, job: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all partitions of a vector that ``job`` gives per batch; of many tasks groups are added up before the driver."""
    parts = rows.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += job(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += np.asarray(b.column("v").flatten()).reshape(-1, size).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    each = rows.mapInArrow(run, "v array<double>")
    if parts > WIDE:
        each = each.repartition(int(parts**0.5)).mapInArrow(add, "v array<double>")
    t = each.toArrow()
    return np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, size).sum(0) if t.num_rows else np.zeros(size)
