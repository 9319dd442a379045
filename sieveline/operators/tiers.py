"""Cheap tiers before the main model: edge and middle decisions, their certification and the choice of a cascade."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.folds import fnv_fold
from ..functions.text import words
from ..functions.vectors import let
from .thresholds import kth, risk_threshold

PIN = 1e9
TOLERANCE = {"relative": 1.1, "absolute": 0.001}
EXTRA_DISMISSAL, MIDDLE_MAX_FALSE_ALARMS, EDGE_MAX_FALSE_ALARMS = 0.25, 0.01, 0.005
BITS = 18
#: Highest recall that a choice of tiers is judged at.
MOST_RECALL = 0.99


def lexical_tokens(text: Column) -> Column:
    """Words, word pairs and character 3- to 5-grams of the padded words; the words are found once."""

    def of(w: Column) -> Column:
        pairs = F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
        padded = F.transform(w, lambda x: F.concat(F.lit("_"), x, F.lit("_")))
        return F.concat(w, pairs, *(F.flatten(F.transform(padded, grams(n))) for n in (3, 4, 5)))

    def grams(n: int):
        def of_word(x: Column) -> Column:
            return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.concat(F.lit("#"), x.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

        return of_word

    return let(words(text), of)


def lexical_features(rows: DataFrame, text: str = "text", out: str = "lexical", bits: int = BITS) -> DataFrame:
    """Hashed n-gram counts as a sparse vector of 2^bits."""
    tf = HashingTF(numFeatures=1 << bits, inputCol="_tokens", outputCol=out)
    return tf.transform(rows.withColumn("_tokens", F.coalesce(lexical_tokens(F.col(text)), F.array().cast("array<string>")))).drop("_tokens")


def lexical_model(rows: DataFrame, label: str = "y", c: float = 1.0):
    """Class-balanced logistic regression on the hashed n-grams (a convex fit in place of an order-dependent one)."""
    from pyspark.ml.classification import LogisticRegression

    n, pos = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    w = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    return LogisticRegression(featuresCol="lexical", labelCol=label, weightCol="_w", regParam=1 / (c * n), maxIter=50).fit(rows.withColumn("_w", w))


def cross_fit(rows: DataFrame, fit, apply, key: str = "id", folds: int = 5) -> DataFrame:
    """Scores of each fold by a model fitted on the other folds (folds by FNV-1a of the key)."""
    f = rows.withColumn("_fold", fnv_fold(F.col(key).cast("string"), folds))
    out = None
    for k in range(folds):
        part = apply(fit(f.filter(F.col("_fold") != k)), f.filter(F.col("_fold") == k)).drop("_fold")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Tier:
    """A cheap score and its budgets over all rows so far: share of the negatives fired, share of the positives dismissed."""

    score: str
    fire: float
    dismiss: float


def _place(rows: DataFrame, cls: int, share: float, spent: int, total: int, score: str, highest: bool) -> float | None:
    """The score that a budget of ``share`` of ``total`` rows of a class, less what is spent, leaves outside; None where it leaves all or none."""
    return kth(rows.filter(F.col("y") == cls), math.floor(share * total) + 1 - spent, score, descending=highest)


def fire_at(rows: DataFrame, max_rate: float, score: str = "s", label: str = "y") -> float | None:
    """The lowest score strictly above which at most the rate of the negatives lies."""
    own = rows.select(F.col(score).alias("s"), F.col(label).alias("y"))
    return _place(own, 0, max_rate, 0, own.filter("y = 0").count(), "s", True)


def dismiss_at(rows: DataFrame, max_share: float, score: str = "s", label: str = "y") -> float | None:
    """The highest score strictly below which at most the share of the positives lies; None where none may."""
    own = rows.select(F.col(score).alias("s"), F.col(label).alias("y"))
    n = own.filter("y = 1").count()
    return _place(own, 1, max_share, 0, n, "s", False) if max_share * n >= 1 else None


def certify(rows: DataFrame, max_false_alarms: float, max_dismissed: float, delta: float, *, score: str = "s", label: str = "y", stratum: str | None = None, size: str | None = None) -> tuple[float | None, float | None]:
    """(fire, dismiss) thresholds with confidence 1 - delta each: fire strictly above, dismiss strictly below, dismiss <= fire.

    Without strata the frame is taken as infinite.  Only counts per stratum and score bin reach the driver.
    """
    h = F.col(stratum).cast("string") if stratum else F.lit("all")
    own = rows.select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"), h.alias("h"), (F.col(size) if size else F.lit(None)).cast("double").alias("N")).filter("s is not null and y is not null")
    dismiss = risk_threshold(own.filter("y = 1"), max_dismissed, delta)
    fire = risk_threshold(own.filter("y = 0").withColumn("s", -F.col("s")), max_false_alarms, delta)
    fire = None if fire is None else -fire
    return fire, dismiss if fire is None or dismiss is None else min(dismiss, fire)


def tier_decision(score: Column, fire: float | None, dismiss: float | None) -> Column:
    """'fire' strictly above, 'dismiss' strictly below, else null."""
    out = F.when(score > fire, "fire") if fire is not None else F.when(F.lit(False), "fire")
    return out.when(score < dismiss, "dismiss") if dismiss is not None else out


def pin(decision: Column, score: Column) -> Column:
    return F.when(decision == "fire", PIN).when(decision == "dismiss", -PIN).otherwise(score)


def settle(rows: DataFrame, tiers: Sequence[Tier]) -> tuple[DataFrame, list[tuple[float | None, float | None]]]:
    """Rows with ``settled`` ('fire', 'dismiss', null) after all tiers in turn, and the thresholds of each.

    A tier only sees the rows that the tiers before left open, and its budgets cover their decisions too: what they have
    fired or dismissed wrongly is spent.  A tier without a larger firing budget than the one before fires nothing.
    """
    out, cuts, before = rows.withColumn("settled", F.lit(None).cast("string")), [], 0.0
    neg, pos = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    for t in tiers:
        fired, dismissed = out.agg(F.count_if((F.col("settled") == "fire") & (F.col("y") == 0)), F.count_if((F.col("settled") == "dismiss") & (F.col("y") == 1))).first()
        left = out.filter(F.col("settled").isNull())
        fire = _place(left, 0, t.fire, fired, neg, t.score, True) if t.fire > before else None
        dismiss = _place(left, 1, t.dismiss, dismissed, pos, t.score, False) if t.dismiss * pos >= 1 else None
        out = out.withColumn("settled", F.coalesce("settled", tier_decision(F.col(t.score), fire, dismiss)))
        cuts.append((fire, dismiss))
        before = t.fire
    return out, cuts


def cascade_cost(rows: DataFrame, target: float, score: str = "s", label: str = "y", settled: str | None = None) -> float:
    """False-alarm rate at the least recall of the target, tied scores together; 1 where it can't be reached.

    Rows that tiers settled come first (fired) or last (dismissed).  The head's threshold is the score of the positive
    that completes the recall, so one order statistic and one count suffice.
    """
    done = F.col(settled) if settled else F.lit(None).cast("string")
    own = rows.select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"), done.alias("d"))
    pos, neg, hit, false = own.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), F.count_if((F.col("y") == 1) & (F.col("d") == "fire")), F.count_if((F.col("y") == 0) & (F.col("d") == "fire"))).first()
    if not pos or not neg:
        return 1.0
    need = next(k for k in range(max(0, math.floor(target * pos) - 1), pos + 2) if k / pos >= target) if target <= 1 else pos + 1
    if hit >= need > 0 or not need:
        return false / neg
    left = own.filter("d is null")
    t = kth(left.filter("y = 1"), need - hit, "s")
    return 1.0 if t is None else (false + left.filter((F.col("y") == 0) & (F.col("s") >= t)).count()) / neg


def choose_cascade(rows: DataFrame, budgets: dict[str, float], target_recall: float, reserve: float = 0.0) -> dict:
    """Whether the middle tier stays, from training rows (edge, middle, head scores and y): its cost may exceed the two-tier cost by the tolerance only.

    budgets: edge_fire, edge_dismiss, and the cumulative middle_fire, middle_dismiss.
    """
    edge, middle = (Tier(t, budgets[f"{t}_fire"], budgets[f"{t}_dismiss"]) for t in ("edge", "middle"))
    goal = min(MOST_RECALL, target_recall + reserve)
    cost = {name: cascade_cost(settle(rows, own)[0], goal, "head", settled="settled") for name, own in (("two_tier", [edge]), ("three_tier", [edge, middle]))}
    return {"cascade": cost["three_tier"] <= TOLERANCE["relative"] * cost["two_tier"] + TOLERANCE["absolute"], **cost}


def edge_ladder(shares: Sequence[float], target_recall: float) -> list[dict]:
    """Rungs of dismissal shares, from the boldest to none, each with the recall left to the next tiers."""
    return [{"dismiss": s, "remaining_target": min(0.999, (target_recall) / (1 - s)) if s < 1 else 1.0} for s in sorted(set([*shares, 0.0]), reverse=True)]


def tier_digest(doc: dict) -> str:
    """Identity of a tier's head: features, model, thresholds and claims; any change of a threshold changes it."""
    return stats.canonical_digest(doc)


def validate_tier(doc: dict) -> list[str]:
    """Problems of a tier document: finite thresholds, dismissal at most at the firing threshold, at least one of both."""
    bad = []
    for n, h in (doc.get("heads") or {}).items():
        f, d = h.get("fire"), h.get("dismiss")
        if any(x is not None and not math.isfinite(x) for x in (f, d)):
            bad.append(f"{n}: a threshold is not finite")
        elif f is not None and d is not None and d > f:
            bad.append(f"{n}: dismissal above firing")
        elif f is None and d is None:
            bad.append(f"{n}: decides nothing")
    return bad or ([] if doc.get("heads") else ["no heads"])
