"""Samples that match target category proportions: signature counts repaired by swaps, then materialised."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_key
from ..sources.shared import save
from .common import salted_join, take_by_rank

SALTS = 8


def in_strata(items: DataFrame, strata: DataFrame) -> DataFrame:
    """(design_id, stratum, item_id, group_key) of every item in each stratum that it meets; one row per item and stratum.

    Slices are compared without case and outer spaces.  An item that lacks design, rule, score (null or NaN) or slice
    is in no stratum; an item without group is a group of its own.  Strata repeat per rule and slice a few times only,
    so they are repeated over the salts of a hot design.
    """
    i = items.select(
        "design_id", F.col("signals.rule_fires").alias("rule_fires"), F.lower(F.trim("signals.slice")).alias("slice"), F.col("signals.score").alias("score"), F.col("id").cast("string").alias("item_id"), F.coalesce(group_key(F.col("group_id")), F.concat(F.lit("item "), F.col("id"))).alias("group_key")
    ).filter(F.col("item_id").isNotNull() & F.col("design_id").isNotNull() & F.col("rule_fires").isNotNull() & F.col("slice").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    s = strata.select("design_id", "rule_fires", F.lower(F.trim("slice")).alias("slice"), "stratum", "band_lower", "band_upper").dropDuplicates(["design_id", "stratum"])
    both = salted_join(i, s, ["design_id", "rule_fires", "slice"], SALTS)
    return both.filter((F.col("band_lower") <= F.col("score")) & (F.col("score") < F.col("band_upper"))).select("design_id", "stratum", "item_id", "group_key").distinct()


def repair(member: np.ndarray, have: np.ndarray, target: np.ndarray, floor: np.ndarray, seed: int) -> np.ndarray:
    """How many records of each signature to take.

    member: (signatures, categories) 0/1; have: records per signature; target and floor per category.  Targets beyond the
    records there are count as these, so what one category lacks isn't drawn from others.  Starts from random records
    that satisfy the floors where the records suffice; then records are swapped, added or dropped (an exchange with
    nothing), in steps halving from the largest useful, as long as the squared deviation from the targets falls and no
    floor is broken more than before.  Moves of best gradient are tried first, all others before a step ends, so no
    single swap, addition or removal improves the result.
    """
    rng = np.random.default_rng(seed)
    m = np.concatenate([member, np.zeros((1, member.shape[1]))]).astype(np.int64)  # the last signature is nothing
    most = m[:-1].T @ have
    target, least = np.minimum(target, most), np.minimum(floor, most)
    spare = 1 << 40
    have = np.r_[have, 2 * spare]
    take = np.zeros(len(have), np.int64)
    for c in np.argsort(most, kind="stable"):  # scarce categories first
        lack = int(least[c] - (m[:, c] * take).sum())
        own = np.flatnonzero(m[:, c])
        if lack > 0 and len(own):
            take[own] += rng.multivariate_hypergeometric((have - take)[own], lack)
    wide = m[:-1].sum(1)
    size = int(min((have - take)[:-1].sum(), max(0.0, target.sum() / max(1.0, np.average(wide, weights=have[:-1]) if have[:-1].sum() else 1.0) - take.sum())))
    if size:
        take[:-1] += rng.multivariate_hypergeometric((have - take)[:-1], size)
    take[-1] = spare

    def cost(got: np.ndarray) -> np.ndarray:
        """Missing floors first, then the squared deviation, as one number per row of counts."""
        return np.maximum(least - got, 0).sum(-1) * 1e12 + ((got - target) ** 2).sum(-1)

    got = m.T @ take
    best = float(cost(got))
    step = 1 << int(np.log2(max(1, have[:-1].max(initial=1))))

    def cheapest(room: np.ndarray, free: np.ndarray) -> tuple[float, int, int]:
        """(cost, from, to) of the best exchange of ``step`` records of one of ``room`` for one of ``free``."""
        least_cost, at = np.inf, (0, 0)
        if not len(free):
            return least_cost, *at
        block = max(1, (1 << 20) // max(1, len(free) * m.shape[1]))
        for lo in range(0, len(room), block):
            i, j = np.repeat(room[lo : lo + block], len(free)), np.tile(free, len(room[lo : lo + block]))
            costs = cost(got + step * (m[j] - m[i]))
            k = int(costs.argmin())
            if costs[k] < least_cost:
                least_cost, at = float(costs[k]), (int(i[k]), int(j[k]))
        return least_cost, *at

    while step:
        while True:
            gain = m @ (got - target)  # half the derivative of the deviation
            room, free = np.flatnonzero(take >= step), np.flatnonzero(have - take >= step)
            room, free = room[np.argsort(-gain[room], kind="stable")], free[np.argsort(gain[free], kind="stable")]
            found, i, j = cheapest(room[:16], free[:16])
            if found >= best:
                found, i, j = cheapest(room, free)
            if found >= best:
                break
            take[i] -= step
            take[j] += step
            got, best = got + step * (m[j] - m[i]), found
        step //= 2
    return take[:-1]


def proportional_sample(items: DataFrame, strata: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report); the report holds each stratum's deviation from what the frame can give of its target.

    sample: (design_id, stratum, group_key, item_id): the drawn groups with one random item each and every stratum the
    group counts in.  report: (design_id, stratum, frame_groups, n_sample, min_sample, drawn, deviation,
    floor_met, reachable): per stratum, drawn the groups counted in the sample, deviation drawn less the target or, if
    that is more, the groups of the frame; floor_met whether drawn has the least number or all there is; reachable whether the frame holds n_sample different groups.
    A group is drawn at most once and counts in every stratum that its items meet (its signature).  Null targets and
    floors count as 0.  Strata without any item are reported with 0; designs without strata have no rows.
    """
    cells = save(in_strata(items, strata), "strata-items")
    groups = cells.select("design_id", "group_key", "stratum").distinct()
    signed = save(groups.groupBy("design_id", "group_key").agg(F.array_sort(F.collect_set("stratum")).alias("signature")), "strata-signatures")  # at most the strata of a design
    counts = signed.groupBy("design_id", "signature").agg(F.count(F.lit(1)).alias("have"))
    wanted = strata.select("design_id", "stratum", F.coalesce("n_sample", F.lit(0)).alias("n_sample"), F.coalesce("min_sample", F.lit(0)).alias("min_sample")).dropDuplicates(["design_id", "stratum"])
    lists = wanted.groupBy("design_id").agg(F.sort_array(F.collect_list(F.struct("stratum", "n_sample", "min_sample"))).alias("strata"))

    tasks = max(items.sparkSession.sparkContext.defaultParallelism, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def solve(t: pa.Table) -> pa.Table:
        cats = t.column("strata")[0].as_py()
        rows = sorted(zip(t.column("signature").to_pylist(), t.column("have").to_pylist()))
        index = {c["stratum"]: k for k, c in enumerate(cats)}
        member = np.zeros((len(rows), len(cats)), np.int64)
        for k, (sig, _) in enumerate(rows):
            member[k, [index[s] for s in sig]] = 1
        target = np.array([c["n_sample"] for c in cats], np.int64)
        floor = np.array([c["min_sample"] for c in cats], np.int64)
        have = np.array([n for _, n in rows], np.int64)
        take = repair(member, have, target, floor, seed)
        return pa.table({"design_id": pa.array([t.column("design_id")[0].as_py()] * len(rows), pa.string()), "signature": pa.array([s for s, _ in rows], pa.list_(pa.string())), "_take": pa.array(take)})

    quota = save(counts.join(lists, "design_id").repartition(tasks, "design_id").groupBy("design_id").applyInArrow(solve, "design_id string, signature array<string>, _take long"), "strata-quotas")
    drawn = take_by_rank(signed, ["design_id", "signature"], quota, F.xxhash64("group_key", "design_id", F.lit(seed)))
    drawn = save(drawn.select("design_id", "group_key", "signature"), "strata-drawn")
    got = drawn.select("design_id", F.explode("signature").alias("stratum")).groupBy("design_id", "stratum").agg(F.count(F.lit(1)).alias("drawn"))
    frame = groups.groupBy("design_id", "stratum").agg(F.count(F.lit(1)).alias("frame_groups"))
    report = wanted.join(frame, ["design_id", "stratum"], "left").join(got, ["design_id", "stratum"], "left").fillna(0, ["frame_groups", "drawn"])
    report = report.select("design_id", "stratum", "frame_groups", "n_sample", "min_sample", "drawn", (F.col("drawn") - F.least("n_sample", "frame_groups")).alias("deviation"), (F.col("drawn") >= F.least("min_sample", "frame_groups")).alias("floor_met"), (F.col("frame_groups") >= F.col("n_sample")).alias("reachable"))
    item = cells.groupBy("design_id", "group_key").agg(F.min_by("item_id", F.struct(F.xxhash64("item_id", F.lit(seed)), "item_id")).alias("item_id"))
    sample = drawn.join(item, ["design_id", "group_key"]).select("design_id", F.explode("signature").alias("stratum"), "group_key", "item_id")
    return sample, report
