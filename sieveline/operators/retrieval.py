"""Retrieval of unlabelled neighbours of known positives, with diversity, and the removal of near-duplicates of the evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..sources.shared import save

#: Rows of the small side (seeds, evaluation vectors) that are sent to all tasks at a time.
SIDE_ROWS = 1 << 14


def mmr_select(vectors: np.ndarray, similarity: np.ndarray, k: int, lam: float) -> list[int]:
    """Indices by lam * similarity - (1 - lam) * greatest similarity to those chosen; the first has no penalty, ties keep the lowest index."""
    picked: list[int] = []
    penalty, free = np.zeros(len(vectors)), np.ones(len(vectors), bool)
    while len(picked) < min(k, len(vectors)):
        best = int(np.where(free, lam * similarity - (1 - lam) * penalty, -np.inf).argmax())
        near = vectors @ vectors[best]
        penalty = near if not picked else np.maximum(penalty, near)
        picked.append(best)
        free[best] = False
    return picked


def near_any(rows: DataFrame, others: DataFrame, least: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key) of the rows within the cosine of any of ``others``: blocks of unit vectors against every Arrow batch, no pairs emitted."""
    side = others.filter(F.col(vector).isNotNull()).select(unit(F.col(vector)).alias("v"))
    count, out = side.count(), None
    kind = rows.schema[key].dataType.simpleString()
    blocks = max(1, -(-count // SIDE_ROWS))
    for b in range(blocks):
        part = side if blocks == 1 else side.filter(F.pmod(F.xxhash64("v"), F.lit(blocks)) == b)
        m = np.array([r.v for r in part.collect()], dtype=np.float64)
        sent = rows.sparkSession.sparkContext.broadcast(m)

        def run(batches, sent=sent):
            for pdf in batches:
                pdf = pdf[pdf[vector].map(lambda v: v is not None)]
                if len(pdf) and len(sent.value):
                    x = np.array(pdf[vector].tolist(), dtype=np.float64)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    yield pdf[[key]][(x @ sent.value.T).max(1) >= least]

        hit = rows.select(key, vector).mapInPandas(run, f"{key} {kind}")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def retrieve_from_seeds(seeds: DataFrame, pool: DataFrame, *, candidates: int = 100, k: int = 20, floor: float = 0.6, mmr_lambda: float = 0.7, round_no: int = 1, evaluation: DataFrame | None = None, near_duplicate: float = 0.95, reserved: DataFrame | None = None, retired: DataFrame | None = None) -> DataFrame:
    """(id, seed_ids, similarity, round): pool items near the seeds, diversified per seed and merged over seeds.

    seeds and pool: id, embedding (pool also group_id where ``reserved`` is given).  Eligibility comes first: reserved groups,
    near-duplicates of the evaluation and retired seeds are anti-joined before any similarity is computed.
    """
    if not (0 <= mmr_lambda <= 1 and candidates >= k > 0):
        raise ValueError("need 0 <= lambda <= 1 and candidates >= k > 0")
    active = seeds if retired is None else seeds.join(retired.select("id"), "id", "left_anti")
    able = pool if reserved is None else pool.join(reserved.select("group_id"), "group_id", "left_anti")
    if evaluation is not None:
        able = able.join(near_any(able, evaluation, near_duplicate), "id", "left_anti")
    near = save(nearest_seeds(active, able, candidates, floor), "retrieval-near")
    w = Window.partitionBy("seed_id").orderBy(F.desc("sim"), "id")
    top = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= candidates)
    top = top.join(able.select("id", unit(F.col("embedding")).alias("v")).dropDuplicates(["id"]), "id")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        at = mmr_select(np.array(pdf.v.tolist()), pdf.sim.to_numpy(), k, mmr_lambda)
        return pdf.iloc[at][["seed_id", "id", "sim"]]

    chosen = top.groupBy("seed_id").applyInPandas(choose, "seed_id string, id string, sim double")
    return chosen.groupBy("id").agg(F.sort_array(F.collect_set("seed_id")).alias("seed_ids"), F.max("sim").alias("similarity")).withColumn("round", F.lit(round_no))


def nearest_seeds(seeds: DataFrame, pool: DataFrame, most: int, floor: float) -> DataFrame:
    """(seed_id, id, sim): pool rows within ``floor`` of a seed, of every seed at least the ``most`` nearest.

    Blocks of seeds are sent to all tasks; an Arrow batch is one matrix product and sends, per seed, no more than its
    own ``most`` best, so neither a row without a near seed nor a vector is shuffled.  Ties at the end go to the least ids.
    """
    kinds = f"seed_id {seeds.schema['id'].dataType.simpleString()}, id {pool.schema['id'].dataType.simpleString()}, sim double"
    s = seeds.filter(F.col("embedding").isNotNull()).select("id", unit(F.col("embedding")).alias("v"))
    blocks, out = max(1, -(-s.count() // SIDE_ROWS)), None
    rows = pool.filter(F.col("embedding").isNotNull()).select("id", unit(F.col("embedding")).alias("v"))
    for b in range(blocks):
        t = (s if blocks == 1 else s.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id").toArrow()
        side = np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) if t.num_rows else None
        sent = seeds.sparkSession.sparkContext.broadcast((side, t.column("id").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            side, names = sent.value
            for batch in batches if side is not None else ():
                if not batch.num_rows:
                    continue
                batch = batch.sort_by("id")
                sims = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1) @ side.T
                seed, at, sim = [], [], []
                for j in np.flatnonzero((sims >= floor).any(0)):
                    own = np.flatnonzero(sims[:, j] >= floor)
                    own = own[np.argsort(-sims[own, j], kind="stable")][:most]
                    seed.append(np.full(len(own), j))
                    at.append(own)
                    sim.append(sims[own, j])
                if seed:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(seed))), batch.column("id").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(sim))], names=["seed_id", "id", "sim"])

        part = rows.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def drop_near_evaluation(records: DataFrame, embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """P5: (id) of retrieved or generated train records within the cosine of a calibration or test record."""
    v = embeddings.select("id", "embedding").filter(F.col("embedding").isNotNull())
    machine = records.filter((F.col("role") == "train") & F.col("source.kind").isin("retrieved", "generated")).select("id").distinct().join(v, "id")
    held = records.filter(F.col("role").isin("calibration", "test")).select("id").distinct().join(v, "id")
    return near_any(machine, held, least)
