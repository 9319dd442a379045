"""Thresholds from exact order statistics, and the conformal selection between recall and false-alarm limits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clopper_pearson_lower, clopper_pearson_upper, conformal_rank, minimum_samples, next_up, normal_quantile, ratio_from_sums, share_bound

BINS = 4096


def kth(scores: DataFrame, k: int, score: str = "p", descending: bool = True) -> float | None:
    """The k-th (1-based) highest or lowest score; None if there are fewer.

    Two passes instead of a global sort: counts per bin find the bin of the rank, then only its different values
    are counted and ordered.  Null and NaN scores don't count.
    """
    s = scores.select(F.col(score).cast("double").alias("s")).filter(F.col("s").isNotNull() & ~F.isnan("s"))
    lo, hi, n = s.agg(F.min("s"), F.max("s"), F.count("s")).first()
    if k < 1 or n < k:
        return None
    place = F.least(F.lit(BINS - 1), F.floor((F.col("s") - lo) / ((hi - lo) or 1.0) * BINS)).cast("int")
    bins = {r.b: r.n for r in s.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = k
    for b in sorted(bins, reverse=descending):
        if bins[b] >= left:
            break
        left -= bins[b]
    order = F.desc("s") if descending else F.asc("s")
    inside = s.filter(place == b).groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(order)))
    return inside.filter(F.col("upto") >= left).orderBy(order).first().s


def running_sums(rows: DataFrame, score: str, sums: dict[str, Column]) -> DataFrame:
    """(s, <sums>): per different score the sums over all rows at or above it.

    Sums go by score bin first; only a bin's different scores are ordered in one task.
    """
    use = rows.select(F.col(score).cast("double").alias("s"), *(v.cast("double").alias(k) for k, v in sums.items())).filter(F.col("s").isNotNull() & ~F.isnan("s"))
    lo, hi = use.agg(F.min("s"), F.max("s")).first()
    lo, hi = (0.0, 1.0) if lo is None else (lo, hi)
    each = use.groupBy("s").agg(*(F.sum(k).alias(k) for k in sums)).withColumn("b", F.least(F.lit(BINS - 1), F.floor((F.col("s") - lo) / ((hi - lo) or 1.0) * BINS)).cast("int"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
    bins = each.groupBy("b").agg(*(F.sum(k).alias(k) for k in sums)).select("b", *(F.coalesce(F.sum(k).over(above), F.lit(0.0)).alias(f"{k}_above") for k in sums))
    w = Window.partitionBy("b").orderBy(F.desc("s"))
    return each.join(bins, "b").select("s", *((F.col(f"{k}_above") + F.sum(k).over(w)).alias(k) for k in sums))


def running_share(scores: DataFrame, score: str, weight: Column) -> DataFrame:
    """(s, share, before): per different score, the share of all weight at or above it and strictly above it.

    Sums go by bin first, so that no task sorts all rows.
    """
    s = scores.select(F.col(score).cast("double").alias("s"), weight.cast("double").alias("w")).filter(F.col("s").isNotNull() & ~F.isnan("s"))
    each = s.groupBy("s").agg(F.sum("w").alias("w")).withColumn("b", F.floor(F.col("s") * BINS))
    sums = each.groupBy("b").agg(F.sum("w").alias("bw"))
    above = sums.withColumn("start", F.sum("bw").over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("bw").over(Window.partitionBy()))
    w = Window.partitionBy("b").orderBy(F.desc("s"))
    j = each.join(above, "b").withColumn("upto", F.coalesce("start", F.lit(0.0)) + F.sum("w").over(w))
    return j.select("s", (F.col("upto") / F.col("total")).alias("share"), ((F.col("upto") - F.col("w")) / F.col("total")).alias("before"))


def pick_threshold(positives: DataFrame, negatives: DataFrame, design_recall: float, max_false_alarm: float | None = None, score: str = "p", weight: str | None = None) -> float:
    """The score that catches the design recall of the positives, raised by the false-alarm cap."""
    if weight is None:
        n = positives.filter(F.col(score).isNotNull()).count()
        t = kth(positives, max(1, math.ceil(design_recall * n - 1e-12)), score)
    else:
        row = running_share(positives, score, F.col(weight)).filter(F.col("share") >= design_recall - 1e-12).agg(F.max("s")).first()
        t = row[0]
    if t is None:
        raise ValueError("no positives")
    return t if max_false_alarm is None else max(t, false_alarm_cap(negatives, max_false_alarm, score, weight))


def false_alarm_cap(negatives: DataFrame, max_rate: float, score: str = "p", weight: str | None = None) -> float:
    """Least threshold at which at most the rate of the negatives fires; 0 where all may."""
    if weight is None:
        n = negatives.filter(F.col(score).isNotNull()).count()
        t = kth(negatives, math.floor(max_rate * n) + 1, score)
        return 0.0 if t is None else next_up(t)
    t = running_share(negatives, score, F.col(weight)).filter(F.col("share") > max_rate + 1e-12).agg(F.max("s")).first()[0]
    return 0.0 if t is None else next_up(t)


def budget_threshold(threshold: float, background: DataFrame, rate: float, score: str = "p") -> float:
    """The threshold, raised only, until at most the rate of the background fires."""
    return max(threshold, false_alarm_cap(background, rate, score))


def group_scores(rows: DataFrame, group: str, score: str = "p", positive: bool = True) -> DataFrame:
    """One score per group: the least of a positive group (all must fire), the greatest of a negative one."""
    return rows.groupBy(group).agg((F.min if positive else F.max)(score).alias(score))


def conformal_limit(scores: DataFrame, rate: float, delta: float | None, upper: bool, score: str = "p") -> tuple[float | None, int]:
    """(limit, rows): recall limit from positives (upper=True, at most ``rate`` lie below), or false-alarm limit (at most ``rate`` reach it)."""
    n = scores.filter(F.col(score).isNotNull()).count()
    r = conformal_rank(n, rate, delta)
    if r < 0:
        return None, n
    t = kth(scores, r + 1, score, descending=not upper)
    return (t if upper else next_up(t)), n


@dataclass
class Selection:
    """threshold is None where the heuristic one is to be used."""

    threshold: float | None
    kind: str
    mode: str
    alpha: float
    delta: float | None = None
    budgets: dict = field(default_factory=dict)
    sufficiency: dict = field(default_factory=dict)
    failures: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def conformal_threshold(mode: str, target_recall: float, positives: DataFrame, constraints: list[tuple[str, DataFrame, float]] = (), *, delta: float = 0.05, heuristic_available: bool = False, allow_heuristic: bool = True, score: str = "p") -> Selection:
    """Choose a recall threshold whose guarantee the data supports.

    positives: one score per positive group.  constraints: (name, scores per negative group or background row, most rate).
    delta is split over the recall limit and the constraints.  conformal-pac and conformal-expected fail where their
    limit is infeasible or in conflict; auto goes pac, expected, heuristic for want of data only and fails on conflicts.
    """
    alpha = 1 - target_recall
    per_test = delta / (1 + len(constraints))

    def plan(kind: str) -> dict:
        d = per_test if kind == "pac" else None
        limit, n = conformal_limit(positives, alpha, d, True, score)
        if limit is None:
            return {"ok": False, "conflict": False, "threshold": None, "reason": f"{n} positive groups of {minimum_samples(alpha, d)} needed ({kind})"}
        lowers = [(name, conformal_limit(rows, rate, d, False, score), rate) for name, rows, rate in constraints]
        for name, (t, m), rate in lowers:
            if t is None:
                return {"ok": False, "conflict": False, "threshold": None, "reason": f"{m} {name} rows of {minimum_samples(rate, d)} needed to certify {rate} ({kind})"}
        lower = max([0.0, *(t for _, (t, _), _ in lowers)])
        if lower > limit:
            name, (t, _), rate = max(lowers, key=lambda x: x[1][0])
            return {"ok": False, "conflict": True, "threshold": lower, "reason": f"recall {target_recall} needs a threshold of at most {limit}, {name} {rate} one of at least {t}"}
        return {"ok": True, "conflict": False, "threshold": limit}

    pac, exp = plan("pac"), plan("expected")
    n = positives.filter(F.col(score).isNotNull()).count()
    enough = {"positive_groups": n, "needed": {"expected": minimum_samples(alpha), "pac": minimum_samples(alpha, per_test)}, "feasible": [m for m, p in (("conformal-expected", exp), ("conformal-pac", pac)) if p["ok"]], "chosen": "heuristic"}
    budgets = {name: rate for name, _, rate in constraints}

    def result(kind: str, threshold: float | None, chosen: str, reason: str | None = None, failures: list[str] = (), warnings: list[str] = ()) -> Selection:
        note = enough | {"chosen": chosen} | ({"reason": reason} if reason else {})
        return Selection(threshold, kind, mode, alpha, delta if kind == "pac" else None, {} if kind == "none" else budgets, note, list(failures), list(warnings))

    def fallback(p: dict) -> float:
        if p["threshold"] is not None:
            return p["threshold"]
        least = positives.agg(F.min(score)).first()[0]
        return 0.0 if least is None else least

    if mode in ("conformal-pac", "conformal-expected"):
        p, kind = (pac, "pac") if mode == "conformal-pac" else (exp, "expected")
        return result(kind, p["threshold"], mode) if p["ok"] else result("none", fallback(p), mode, p["reason"], [f"{mode}: {p['reason']}"])
    if mode != "auto":
        raise ValueError(f"unknown mode {mode}")
    for p, kind in ((pac, "pac"), (exp, "expected")):
        if p["ok"]:
            return result(kind, p["threshold"], f"conformal-{kind}", None if kind == "pac" else pac["reason"], [], [] if kind == "pac" else [f"guarantee inconclusive: {pac['reason']}; an expected guarantee is used"])
        if p["conflict"]:
            return result("none", fallback(p), f"conformal-{kind}", p["reason"], [f"auto: {p['reason']}"])
    if allow_heuristic and heuristic_available:
        return result("none", None, "heuristic", exp["reason"], [], [f"guarantee inconclusive: {pac['reason']}; {exp['reason']}; the heuristic threshold guarantees nothing"])
    return result("none", fallback(exp), "heuristic", exp["reason"], [f"auto: {exp['reason']}, and no heuristic threshold is " + ("available" if allow_heuristic else "allowed")])


def guarantee_chain(claims: int, ladder: int, delta: float) -> dict:
    return {"claims": claims, "ladder": ladder, "joint_delta": min(1.0, ladder * (claims + 1) * delta)}


def review_floor(threshold: float, ratio: float = 0.5, positives: DataFrame | None = None, epsilon: float | None = None, score: str = "p") -> float:
    """threshold * ratio, or with ``epsilon`` the conformal limit of the positives, at most the threshold."""
    if epsilon is None or positives is None:
        return threshold * ratio
    limit, _ = conformal_limit(positives, epsilon, None, True, score)
    return min(threshold, limit or 0.0)


def background_upper(background: DataFrame, threshold: float, rate: float, confidence: float, score: str = "p") -> float:
    """Upper bound of the background's firing rate at a threshold.

    Where no more than the budget's whole number of rows fires, the bound is that of the budget, whatever the scores
    were that the threshold was chosen on; else that of the count.
    """
    n, fired = background.agg(F.count(score), F.count_if(F.col(score) >= threshold)).first()
    return clopper_pearson_upper(max(fired, math.floor(rate * n)), n, confidence)


def risk_threshold(rows: DataFrame, alpha: float, delta: float) -> float | None:
    """Highest score (of s, h, N) such that the share of the frame below it is at most alpha with confidence 1 - delta.

    Bounds are looked at from below on the edges of score bins, then on the different scores of the bin where they
    first exceed alpha; the bound is taken to rise within a bin.
    """
    strata = {r.h: (r.n, r.N if r.N is not None else r.n * 1e9) for r in rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("N").alias("N")).collect()}
    if not strata:
        return None
    lo, hi = rows.agg(F.min("s"), F.max("s")).first()
    binned = rows.withColumn("b", F.least(F.lit(BINS - 1), F.floor((F.col("s") - lo) / ((hi - lo) or 1.0) * BINS)).cast("int"))
    below, risky = dict.fromkeys(strata, 0), None
    for b, counts in _in_order(binned, "b"):
        nxt = {k: below[k] + counts.get(k, 0) for k in below}
        if share_bound(nxt, strata, delta) > alpha:
            risky = b
            break
        below = nxt
    if risky is None:
        return float(hi)
    best, last = None, binned.filter(F.col("b") < risky).agg(F.max("s")).first()[0]
    for s, counts in _in_order(binned.filter(F.col("b") == risky), "s"):
        if share_bound(below, strata, delta) > alpha:
            break
        best = s
        below = {k: below[k] + counts.get(k, 0) for k in below}
    return best if best is not None else last


def _in_order(rows: DataFrame, key: str) -> Iterator[tuple[float, dict]]:
    """(key, rows per stratum) in rising order, counted before they are sent."""
    counts = rows.groupBy(key, "h").agg(F.count(F.lit(1)).alias("n")).orderBy(key)
    for k, own in groupby(counts.collect(), lambda r: r[key]):
        yield k, {r.h: r.n for r in own}


def design_precision(rows: DataFrame, candidates: Sequence[float], target: float, delta: float) -> float | None:
    """Lowest of the candidates, from the strictest until one fails, whose precision in the frame is at least target with confidence 1 - delta.

    rows: s, y, h (stratum), N (its frame size).  Rows are counted per stratum and gap between candidates in one pass.
    """
    steps = sorted(set(candidates))
    place = F.lit(0)
    for i, t in enumerate(steps):
        place = F.when(F.col("s") >= F.lit(float(t)), i + 1).otherwise(place)
    cells = rows.groupBy(F.col("h").cast("string").alias("h"), place.alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.max("N").alias("N")).collect()
    frame: dict[str, tuple[int, float]] = {}
    for r in cells:
        n, big = frame.get(r.h, (0, 0.0))
        frame[r.h] = (n + r.n, max(big, float(r.N)))
    best, fired, hit = None, dict.fromkeys(frame, 0), dict.fromkeys(frame, 0)
    for i in range(len(steps), 0, -1):
        for r in cells:
            if r.i == i:
                fired[r.h] += r.n
                hit[r.h] += r.y
        if not any(fired.values()):
            continue
        e = ratio_from_sums([(n, big, hit[h], fired[h], hit[h], fired[h], hit[h]) for h, (n, big) in frame.items()])
        m = max(1, math.floor(e["effective_n"] + 0.5))
        if min(e["estimate"] - normal_quantile(1 - delta) * e["se"], clopper_pearson_lower(min(m, math.floor(e["estimate"] * m + 1e-9)), m, 1 - delta)) < target:
            break
        best = steps[i - 1]
    return best
