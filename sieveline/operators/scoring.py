"""Scoring and decisions as column expressions: one plan for all heads of a row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal


@dataclass(frozen=True)
class Head:
    """A linear head: weights, bias, calibration ('platt', a, c) or ('isotonic', xs, ys), threshold and review floor."""

    name: str
    weights: tuple[float, ...]
    bias: float = 0.0
    calibration: tuple = ("platt", 1.0, 0.0)
    threshold: float = 0.5
    review_floor: float = 0.25
    features: str | None = None


@dataclass(frozen=True)
class Policy:
    """Heads by priority, and suppression rules (when any of these heads reaches its floor, these heads are off)."""

    priority: tuple[str, ...]
    suppress: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = field(default_factory=tuple)

    def named(self) -> list[str]:
        return list(dict.fromkeys([*self.priority, *(h for w, hs in self.suppress for h in (*w, *hs))]))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def calibrate(z: Column, calibration: tuple) -> Column:
    """Platt: sigmoid(a z + c). Isotonic: linear interpolation between knots at sigmoid(z), held at the ends."""
    kind = calibration[0]
    if kind == "platt":
        return sigmoid(F.lit(float(calibration[1])) * z + F.lit(float(calibration[2])))
    if kind != "isotonic":
        raise ValueError(f"unknown calibration {kind}")
    xs, ys = calibration[1], calibration[2]
    p = sigmoid(z)
    out = F.lit(float(ys[-1]))
    for k in range(len(xs) - 1, 0, -1):
        wide = xs[k] - xs[k - 1]
        inner = F.lit(float(ys[k - 1])) + (p - float(xs[k - 1])) / wide * (ys[k] - ys[k - 1]) if wide > 0 else F.lit(float(ys[k]))
        out = F.when(p < float(xs[k]), inner).otherwise(out)
    return F.when(p <= float(xs[0]), F.lit(float(ys[0]))).otherwise(out)


def head_probability(vector: Column, head: Head) -> Column:
    """Linear heads only; heads with further features need their own scorer."""
    if head.features:
        raise ValueError(f"head {head.name} needs features {head.features}")
    return calibrate(dot(vector, literal(head.weights)) + F.lit(head.bias), head.calibration)


def score(rows: DataFrame, heads: Sequence[Head], vector: str = "embedding") -> DataFrame:
    """p_<head> for a few heads, by expressions in the JVM. Null vectors give null scores."""
    return rows.select("*", *(head_probability(F.col(vector), h).alias(f"p_{h.name}") for h in heads))


def score_many(rows: DataFrame, heads: Sequence[Head], key: str, vector: str = "embedding") -> DataFrame:
    """(key, scores map) for many heads: one matrix product per Arrow batch. Invalid vectors give a null map."""
    linear = np.array([h.weights for h in heads], dtype=np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((linear, np.array([h.bias for h in heads]), [h.calibration for h in heads], [h.name for h in heads]))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        w, bias, cal, names = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(vector)
            at = np.asarray(col.offsets, dtype=np.int64)
            ok = np.asarray(col.is_valid()) & (np.diff(at) == w.shape[1])
            flat = np.asarray(col.values.cast(pa.float64()).fill_null(float("nan")))
            x = flat[at[:-1][ok][:, None] + np.arange(w.shape[1])]
            whole = ~np.isnan(x).any(1) if col.values.null_count else np.ones(len(x), bool)
            ok[np.flatnonzero(ok)[~whole]] = False
            x = x[whole]
            z = x @ w.T + bias
            p = np.empty_like(z)
            for j, c in enumerate(cal):
                s = 1 / (1 + np.exp(-np.clip(z[:, j], -700, 700)))
                p[:, j] = 1 / (1 + np.exp(-np.clip(c[1] * z[:, j] + c[2], -700, 700))) if c[0] == "platt" else np.interp(s, c[1], c[2])
            it = iter(p.tolist())
            maps = [list(zip(names, next(it))) if o else None for o in ok]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[key, "scores"])

    return rows.select(key, vector).mapInArrow(run, f"{key} {kind}, scores map<string,double>")


def invalid_vectors(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """One row (rows, null_vectors, wrong_width, not_finite): what scoring would refuse."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("null_vectors"), F.count_if(v.isNotNull() & (F.size(v) != width)).alias("wrong_width"), F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"))


def check_scores(rows: DataFrame, heads: Sequence[str]) -> None:
    """Raise on the driver if a head of the artifact has a missing or non-finite score, or one outside [0, 1]."""
    bad = [F.count_if(F.coalesce(~((F.col(f"p_{h}") >= 0) & (F.col(f"p_{h}") <= 1)) | F.isnan(f"p_{h}"), F.lit(True))).alias(h) for h in heads]
    found = {h: n for h, n in rows.agg(*bad).first().asDict().items() if n}
    if found:
        raise ValueError(f"heads without a finite score in [0, 1]: {found}")


def _at_least(heads: dict[str, Head], name: str, level: str, fired: Column | None, dismissed: Column | None) -> Column:
    off = F.array_contains(dismissed, name) if dismissed is not None else F.lit(False)
    on = F.array_contains(fired, name) & ~off if fired is not None else F.lit(False)
    h = heads.get(name)
    by_score = F.lit(False) if h is None else (F.col(f"p_{name}") >= F.lit(float(getattr(h, level)))) & ~off
    return F.coalesce(on | by_score, F.lit(False))


def decide(heads: Sequence[Head], policy: Policy, fired: Column | None = None, dismissed: Column | None = None) -> Column:
    """struct<head, reason> from p_<head> columns: suppression, then the first head of the priority at its threshold.

    Dismissed heads count below both levels, fired ones at their threshold with reason 'rule' unless dismissed as
    well; heads without a spec never fire by score.  Without a winner: near_threshold if any head of the priority
    reaches its floor, else none.
    """
    by = {h.name: h for h in heads}
    level = lambda n, l: _at_least(by, n, l, fired, dismissed)
    off = {}
    for when, names in policy.suppress:
        hit = F.lit(False)
        for w in when:
            hit = hit | level(w, "review_floor")
        for n in names:
            off[n] = off.get(n, F.lit(False)) | hit
    out = None
    for n in policy.priority:
        wins = level(n, "threshold") & ~off.get(n, F.lit(False))
        reason = F.when(F.array_contains(fired, n), "rule").otherwise("above_threshold") if fired is not None else F.lit("above_threshold")
        value = F.struct(F.lit(n).alias("head"), reason.alias("reason"))
        out = F.when(wins, value) if out is None else out.when(wins, value)
    near = F.lit(False)
    for n in policy.priority:
        near = near | level(n, "review_floor")
    rest = F.struct(F.lit(None).cast("string").alias("head"), F.when(near, "near_threshold").otherwise("none").alias("reason"))
    return rest if out is None else out.otherwise(rest)


def settle(policy: Policy, fired: Column, dismissed: Column) -> Column:
    """struct<settled, head, reason>: the decision where rules alone fix it whatever the scores, else settled = false.

    A head of unknown score, or a fired one whose suppression is unknown, forwards the row to the model.
    """
    on = lambda n: F.coalesce(F.array_contains(fired, n), F.lit(False)) & ~F.coalesce(F.array_contains(dismissed, n), F.lit(False))
    off = lambda n: F.coalesce(F.array_contains(dismissed, n), F.lit(False))
    value = lambda s, h, r: F.struct(F.lit(s).alias("settled"), F.lit(h).cast("string").alias("head"), F.lit(r).cast("string").alias("reason"))
    forward = value(False, None, None)
    any_on, all_off = F.lit(False), F.lit(True)
    for n in policy.priority:
        any_on, all_off = any_on | on(n), all_off & off(n)
    out = F.when(any_on, value(True, None, "near_threshold")).when(all_off, value(True, None, "none")).otherwise(forward)
    for n in reversed(policy.priority):
        rules = [w for w, names in policy.suppress if n in names]
        yes, no = F.lit(False), F.lit(True)
        for when in rules:
            for w in when:
                yes, no = yes | on(w), no & off(w)
        out = F.when(off(n) | yes, out).when(on(n) & no, value(True, n, "rule")).otherwise(forward)
    return out


def missing_policy_heads(policy: Policy, heads: Sequence[Head]) -> list[str]:
    have = {h.name for h in heads}
    return [n for n in policy.named() if n not in have]
