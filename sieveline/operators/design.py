"""Stratified sampling of a traffic frame: strata, allocation, draw, roles, labelling queue and reviews.

Item-level work is DataFrames; merging and allocation decide over the strata counts (tens of rows) on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import random_rank
from ..functions.stats import round_half_up
from .ranks import hex_bucket, ranked

ROLES = ("train", "calibration", "test")
#: Positions of a queue that one task ranks.
RANGE = 4096


@dataclass
class Stratum:
    name: str
    rule: bool
    band: tuple[int, int]
    slice: str | None
    size: int
    members: list[tuple] = field(default_factory=list)


def one_per_group(items: DataFrame, group: str = "group", key: str = "id", seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """A random member per group, within the columns ``by``; an item without group is its own."""
    first = F.min_by(F.struct(*items.columns), F.struct(random_rank(F.col(key), seed), F.col(key))).alias("_one")
    return items.groupBy(*by, F.coalesce(F.col(group).cast("string"), F.concat(F.lit("item "), F.col(key).cast("string"))).alias("_g")).agg(first).select("_one.*")


def score_cuts(items: DataFrame, quantiles: Sequence[float], score: str = "score") -> list[float]:
    """Descending cuts at the given upper quantiles (discrete: a cut is an observed score)."""
    if not quantiles:
        return []
    qs = F.expr("array(" + ", ".join(f"percentile_disc({1 - q}) within group (order by {score})" for q in sorted(quantiles)) + ")")
    return list(items.filter(F.col(score).isNotNull() & ~F.isnan(score)).agg(qs.alias("c")).first().c)


def band_of(cuts: Sequence[float], score: str = "score"):
    """Band k holds scores in [cut k, cut k-1); the last band everything below."""
    out = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(F.col(score) >= cuts[k], k).otherwise(out)
    return out


def with_bands(items: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Items with _band, by the cuts of their own design_id; null and NaN scores are in the last band."""
    last = len(quantiles)
    if not last:
        return items.withColumn("_band", F.lit(0))
    valid = F.col("score").isNotNull() & ~F.isnan("score")
    qs = F.expr("array(" + ", ".join(f"percentile_disc({1 - q}) within group (order by score)" for q in sorted(quantiles)) + ")")
    cuts = items.filter(valid).groupBy("design_id").agg(qs.alias("_cuts"))
    return items.join(cuts, "design_id", "left").withColumn("_band", F.when(valid, band_of([F.col("_cuts")[k] for k in range(last)])).otherwise(last)).drop("_cuts")


def merge_small(strata: list[Stratum], least: Callable[[int], bool]) -> list[Stratum]:
    """Merge strata that are too small, smallest first, into the adjacent band, the band's other slice, the other rule, or any."""
    live = list(strata)
    while len(live) > 1:
        small = sorted((s for s in live if not least(s.size)), key=lambda s: (s.size, s.name))
        if not small:
            break
        s = small[0]
        others = [o for o in live if o is not s]
        near = lambda o: min(abs(s.band[0] - o.band[1]), abs(o.band[0] - s.band[1]))
        tiers = (
            [o for o in others if o.rule == s.rule and o.slice == s.slice and near(o) <= 1],
            [o for o in others if o.rule == s.rule and o.band == s.band],
            [o for o in others if o.rule != s.rule and o.slice == s.slice],
            others,
        )
        pick = sorted(next(t for t in tiers if t), key=lambda o: (near(o), o.size, o.name))[0]
        same = pick.rule == s.rule and pick.slice == s.slice
        band = (min(s.band[0], pick.band[0]), max(s.band[1], pick.band[1]))
        label = f"{'rule' if s.rule else 'no_rule'}|band{band[0]}-{band[1]}" + (f"|{s.slice}" if s.slice else "")
        merged = Stratum(label if same else "+".join(sorted((s.name, pick.name))), pick.rule, band, pick.slice if same else None, s.size + pick.size, s.members + pick.members)
        live = [o for o in live if o is not s and o is not pick] + [merged]
    return sorted(live, key=lambda s: s.name)


def allocate(sizes: dict[str, int], total: int, *, method: str = "proportional", floor: int = 30, factors: dict[str, float] | None = None, rates: dict[str, float] | None = None, manual: dict[str, int] | None = None) -> dict[str, int]:
    """Sample sizes per stratum, between min(floor, N) and N, that add up to the total (or all there is).

    proportional: n ~ factor * N; neyman: n ~ N sqrt(p (1 - p)); manual: the given sizes, at least the floor.
    """
    low = {k: min(floor, n) for k, n in sizes.items()}
    if method == "manual":
        out = {k: min(n, max(low[k], (manual or {}).get(k, 0))) for k, n in sizes.items()}
        if sum(out.values()) > total:
            raise ValueError(f"the manual allocation needs {sum(out.values())} of {total}")
        return out
    total = min(total, sum(sizes.values()))
    if sum(low.values()) > total:
        raise ValueError(f"the least sizes need {sum(low.values())} of {total}")
    if method == "neyman":
        weight = {k: n * math.sqrt(max(1e-9, (rates or {}).get(k, 0.5) * (1 - (rates or {}).get(k, 0.5)))) for k, n in sizes.items()}
    else:
        weight = {k: n * (factors or {}).get(k, 1.0) for k, n in sizes.items()}
    take = lambda c: {k: min(float(n), max(float(low[k]), c * weight[k])) for k, n in sizes.items()}
    lo, hi = 0.0, 1.0
    while sum(take(hi).values()) < total - 1e-9 and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(take(mid).values()) < total else (lo, mid)
    real = take(hi)
    out = {k: math.floor(v + 1e-9) for k, v in real.items()}
    for k in sorted(real, key=lambda k: (-(real[k] - out[k]), k)):
        if sum(out.values()) >= total:
            break
        if out[k] < sizes[k]:
            out[k] += 1
    for k in sorted(sizes, key=lambda k: (-(sizes[k] - out[k]), k)):
        if sum(out.values()) >= total:
            break
        out[k] += min(sizes[k] - out[k], total - sum(out.values()))
    return out


def required_size(sizes: dict[str, int], rates: dict[str, float], *, calibration: float = 0.25, test: float = 0.25, least_expected: float = 10.0, least_share: float = 0.02) -> int:
    """Least total at which every stratum of a material share of the positives is expected to give enough of them per split."""
    frame = sum(sizes.values())
    positives = sum(n * rates.get(k, 0.0) for k, n in sizes.items())
    need = 0
    for k, n in sizes.items():
        expected = n * rates.get(k, 0.0)
        if positives > 0 and expected / positives >= least_share:
            need = max(need, math.ceil(least_expected * frame / (min(calibration, test) * expected)))
    return min(frame, need)


def design_sample(frame: DataFrame, total: int, *, quantiles: Sequence[float] = (0.05, 0.2), roles: tuple[float, float, float] = (0.5, 0.25, 0.25), floor: int = 30, method: str = "proportional", factors=None, rates=None, manual=None, seed: int = 0, design_id: str = "design") -> tuple[DataFrame, DataFrame]:
    """(sample, strata) of a frame with id, group, rule_fires, score, slice.

    sample: the frame's columns with stratum, role, inclusion_prob (that of the item's role) and stratum_size.  One random
    item per group; strata are rule x score band x slice, small ones merged; a simple random sample per stratum by md5
    rank, roles by a second rank with at least two items of calibration and test.  A null or NaN score is in the last band.
    """
    named = frame.withColumn("design_id", F.lit(design_id))
    return design_samples(named, total, quantiles=quantiles, roles=roles, floor=floor, method=method, factors=factors, rates=rates, manual=manual, seed=seed)


def design_samples(frames: DataFrame, total: int, *, quantiles: Sequence[float] = (0.05, 0.2), roles: tuple[float, float, float] = (0.5, 0.25, 0.25), floor: int = 30, method: str = "proportional", factors=None, rates=None, manual=None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``design_sample`` of every design_id of the frames, each with its own groups, cuts, strata, total and draw.

    The driver holds the strata counts of all designs (tens of rows each).
    """
    base = one_per_group(frames, seed=seed, by=["design_id"])
    base = with_bands(base, quantiles)
    base = base.withColumn("_rule", F.coalesce("rule_fires", F.lit(False)))
    cells: dict[str, list] = {}
    for c in base.groupBy("design_id", "_rule", "_band", "slice").agg(F.count(F.lit(1)).alias("n")).collect():  # designs x rules x bands x slices
        cells.setdefault(c.design_id, []).append(c)
    _, cal, test = roles
    placing, summary = [], []
    for d, own in sorted(cells.items()):
        strata = [Stratum(f"{'rule' if c._rule else 'no_rule'}|band{c._band}" + (f"|{c.slice}" if c.slice else ""), c._rule, (c._band, c._band), c.slice, c.n, [(c._rule, c._band, c.slice)]) for c in own]
        merged = merge_small(strata, lambda n: round_half_up(n * cal) >= 2 and round_half_up(n * test) >= 2)
        n = allocate({s.name: s.size for s in merged}, total, method=method, floor=floor, factors=factors, rates=rates, manual=manual)
        for s in merged:
            v = n[s.name]
            n_cal, n_test = max(min(2, v), round_half_up(v * cal)), max(min(2, v), round_half_up(v * test))
            placing += [(d, r, b, sl, s.name, s.size, v, n_cal, n_test) for r, b, sl in s.members]
            summary.append((d, s.name, s.size, v, max(0, v - n_cal - n_test), n_cal, n_test))
    spark = frames.sparkSession
    table = spark.createDataFrame(placing, "_design string, _r boolean, _b int, _slice string, stratum string, stratum_size long, _n int, _cal int, _test int")
    placed = base.join(F.broadcast(table), (base["design_id"] == table["_design"]) & (base["_rule"] == table["_r"]) & (base["_band"] == table["_b"]) & base["slice"].eqNullSafe(table["_slice"])).drop("_design", "_r", "_b", "_slice")
    keys, first, second = ["design_id", "stratum"], random_rank(F.col("id"), seed + 1), random_rank(F.col("id"), seed + 2)
    drawn = ranked(placed, keys, [first, "id"], hex_bucket(first)).filter(F.col("_r") <= F.col("_n"))
    drawn = ranked(drawn, keys, [second, "id"], hex_bucket(second), "_q")
    role = F.when(F.col("_q") <= F.col("_cal"), "calibration").when(F.col("_q") <= F.col("_cal") + F.col("_test"), "test").otherwise("train")
    count = F.when(F.col("role") == "calibration", F.col("_cal")).when(F.col("role") == "test", F.col("_test")).otherwise(F.col("_n") - F.col("_cal") - F.col("_test"))
    sample = drawn.withColumn("role", role).withColumn("inclusion_prob", count / F.col("stratum_size")).drop("_rule", "_band", "_n", "_cal", "_test", "_r", "_q")
    return sample, spark.createDataFrame(summary, "design_id string, stratum string, n_frame long, n_sample int, train int, calibration int, test int")


def design_of(records: DataFrame, by: Sequence[str] = ("design_id", "stratum"), size: str = "stratum_size") -> DataFrame:
    """Records with inclusion_prob = records per stratum / its frame size, over the records given (per role and head); null where the frame is empty."""
    per = records.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max(size).alias("_big"), F.min(size).alias("_small"))
    return records.drop("inclusion_prob").join(per, list(by)).withColumn("inclusion_prob", F.try_divide("_n", "_big")).drop("_n", "_big", "_small")


def design_problems(records: DataFrame, by: Sequence[str] = ("design_id", "stratum"), size: str = "stratum_size") -> DataFrame:
    """Strata whose records disagree on the frame size or outnumber it."""
    per = records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least_size"), F.max(size).alias("most_size"))
    return per.filter((F.col("least_size") != F.col("most_size")) | (F.col("n") > F.col("most_size")) | F.col("most_size").isNull())


def label_queue(items: DataFrame, budgets: dict[str, int], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(queue, key): blinded items in random order, and what they are.

    items: id, text, heads (array), mechanism ('sampled', 'retrieved', 'verification', ...), position.  Over its budget a
    mechanism loses sampled items at random and others from the end; items without heads are left out.
    """
    some = items.filter(F.size("heads") > 0)
    place = F.when(F.col("mechanism") == "sampled", random_rank(F.col("id"), seed)).otherwise(F.lpad(F.col("position").cast("string"), 20, "0"))
    bucket = F.when(F.col("mechanism") == "sampled", hex_bucket(random_rank(F.col("id"), seed))).otherwise(F.floor(F.col("position") / RANGE))
    placed = ranked(some, ["mechanism"], [place, "id"], bucket)
    kept = None
    for m, n in budgets.items():
        part = placed.filter((F.col("mechanism") == m) & (F.col("_r") <= n))
        kept = part if kept is None else kept.unionByName(part)
    rest = placed.filter(~F.col("mechanism").isin(list(budgets))) if budgets else placed
    kept = rest if kept is None else kept.unionByName(rest)
    blind = F.substring(random_rank(F.col("id"), seed + 1), 1, 16)
    keyed = kept.withColumn("item_id", blind).drop("_r")
    return keyed.select("item_id", "text", "heads").orderBy("item_id"), keyed.drop("text")


def apply_reviews(key: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skips): items whose every requested head is labelled 0 or 1, with inclusion_prob from the labelled counts.

    key: item_id, heads, design_id, stratum, role, stratum_size; reviews: item_id, labels map.  skips: (design_id, stratum,
    role, items, labelled, skip_rate, warn) with a warning above 5 %.
    """
    joined = key.join(reviews, "item_id", "left")
    full = F.coalesce(F.forall("heads", lambda h: F.coalesce(F.col("labels")[h].isin(0, 1), F.lit(False))), F.lit(False)) & F.col("labels").isNotNull()
    marked = joined.withColumn("_ok", full)
    by = ["design_id", "stratum", "role"]
    cells = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if("_ok").alias("labelled"))
    skips = cells.withColumn("skip_rate", 1 - F.col("labelled") / F.col("items")).withColumn("warn", F.col("skip_rate") > 0.05)
    done = marked.filter("_ok").join(cells.select(*by, "labelled"), by).withColumn("inclusion_prob", F.try_divide("labelled", "stratum_size")).withColumn("labelled_by", F.lit("human"))
    return done.drop("_ok", "labelled"), skips
