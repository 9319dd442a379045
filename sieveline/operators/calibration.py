"""Calibration of scores from sums over all rows: two-parameter fits, isotonic fits on a fixed grid, tests."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .sums import add_up
from .thresholds import kth

ROUNDS, RIDGE = 100, 1e-3
#: Steps of the score grid of isotonic fits: scores within one step share a knot.
GRID = 1 << 16
#: Slopes and intercepts beyond this are taken as unstable.
STABLE = 10.0


@dataclass(frozen=True)
class Pair:
    """sigma(a z + c), the covariance of (a, c), the log-likelihood and the rows."""

    a: float
    c: float
    covariance: np.ndarray
    likelihood: float
    rows: int

    @property
    def stable(self) -> bool:
        return abs(self.a) <= STABLE and abs(self.c) <= STABLE and bool(np.isfinite(self.covariance).all())


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _rows(rows: DataFrame, z: str, y: str, weight: str | None) -> DataFrame:
    return rows.select(F.col(z).cast("double").alias("z"), F.col(y).cast("double").alias("y"), _weight(weight).alias("w"))


def _moments(a: float, c: float) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Per batch the information, the score, the moments of Firth's term, the log-likelihood and the rows at (a, c)."""

    def job(b: pa.RecordBatch) -> np.ndarray:
        z, y, w = (b.column(k).to_numpy() for k in "zyw")
        eta = a * z + c
        p = stats.sigmoid(eta)
        v, r = w * p * (1 - p), w * (y - p)
        tilt = v * (0.5 - p)
        return np.array([(v * z * z).sum(), (v * z).sum(), v.sum(), (r * z).sum(), r.sum(), *((tilt * z**k).sum() for k in range(4)), (w * (y * eta - np.logaddexp(0, eta))).sum(), len(z)])

    return job


def likelihood(rows: DataFrame, a: float, c: float, z: str = "z", y: str = "y", weight: str | None = None) -> float:
    return float(add_up(_rows(rows, z, y, weight), _moments(a, c), 11)[9])


def fit_pair(rows: DataFrame, z: str = "z", y: str = "y", weight: str | None = None, firth: bool = False) -> Pair:
    """Weighted logistic regression of y on z, lightly ridged or with Firth's leverage term.

    Each Newton round is one pass of eleven sums.  A row's leverage is v (i z^2 + 2 j z + k), with the entries of the
    inverse information, so the sums of v (1/2 - p) times powers of z give Firth's term for any information.
    """
    use, a, c = _rows(rows, z, y, weight), 1.0, 0.0
    for _ in range(ROUNDS):
        s = add_up(use, _moments(a, c), 11)
        if not s[10]:
            raise ValueError("no rows to fit on")
        info = np.array([[s[0], s[1]], [s[1], s[2]]]) + 1e-9 * np.eye(2)
        inv = np.linalg.inv(info)
        score = s[3:5] - np.array([RIDGE * a, 0.0])
        if firth:
            m = s[5:9]
            score = s[3:5] + np.array([inv[0, 0] * m[3] + 2 * inv[0, 1] * m[2] + inv[1, 1] * m[1], inv[0, 0] * m[2] + 2 * inv[0, 1] * m[1] + inv[1, 1] * m[0]])
        step = inv @ score
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
        a, c = a + float(step[0]), c + float(step[1])
    return Pair(a, c, np.linalg.pinv(info), float(s[9]), int(s[10]))


def fit_isotonic(rows: DataFrame, p: str = "p", y: str = "y", weight: str | None = None) -> tuple[list[float], list[float]]:
    """Knots of the increasing fit, from counts per step of the grid."""
    w = _weight(weight)
    g = rows.groupBy(F.floor(F.col(p) * GRID).alias("g")).agg((F.sum(w * F.col(p)) / F.sum(w)).alias("x"), (F.sum(w * F.col(y)) / F.sum(w)).alias("y"), F.sum(w).alias("w")).orderBy("g").toArrow()
    return stats.fit_isotonic(*(g.column(k).to_numpy() for k in "xyw"))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.log(q / (1 - q))


def cox(rows: DataFrame, p: str = "p", y: str = "y") -> dict:
    """Likelihood-ratio test of slope 1 and intercept 0 of y on logit(p)."""
    use = rows.select(logit(F.col(p)).alias("z"), F.col(y).alias("y"))
    fit = fit_pair(use)
    stat = max(0.0, 2 * (fit.likelihood - likelihood(use, 1.0, 0.0)))
    return {"test": "cox", "slope": fit.a, "intercept": fit.c, "applied": fit.stable, "statistic": stat, "p_value": math.exp(-stat / 2)}


def cox_corrected(rows: DataFrame, calibrator: Pair, z: str = "z", y: str = "y") -> dict:
    """Wald test that the test rows' fit on the raw score equals the calibrator, with both covariances."""
    fit = fit_pair(rows, z, y)
    out = stats.cox_test_corrected((calibrator.a, calibrator.c), calibrator.covariance, (fit.a, fit.c), fit.covariance)
    return {"test": "cox-corrected", "slope": fit.a, "intercept": fit.c, **out, "applied": bool(out["applied"] and fit.stable)}


def regions(rows: DataFrame, floor: float, tolerance: float, alpha: float, calibrator: Pair | None = None, p: str = "p", y: str = "y", z: str = "z") -> dict:
    """Observed against expected rate at or above the review floor and in the top decile; the worst result is the verdict."""
    n = rows.count()
    top = kth(rows, max(1, math.ceil(n / 10)), p) if n else None
    out = []
    for name, least in (("review", floor), ("top", top if top is not None else 1.0)):
        own = rows.filter(F.col(p) >= least)
        slope = F.col(p) * (1 - F.col(p))
        s = own.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("o"), F.avg(p).alias("e"), F.avg(slope).alias("g1"), F.avg(slope * F.col(z)).alias("g0") if z in rows.columns else F.lit(0.0).alias("g0")).first()
        if not s.n:
            out.append({"region": name, "n": 0, "result": "pass"})
            continue
        g = np.array([s.g0, s.g1])
        more = float(g @ calibrator.covariance @ g) if calibrator is not None and z in rows.columns else 0.0
        se = math.sqrt(max(s.e * (1 - s.e), 1e-12) / s.n)
        beyond = abs(s.o - s.e) - tolerance
        result = "fail" if beyond > stats.normal_quantile(1 - alpha / 2) * math.sqrt(se * se + more) else "warn" if beyond > 0 else "pass"
        out.append({"region": name, "n": s.n, "observed": s.o, "expected": s.e, "se": se, "se_calibrator": math.sqrt(max(0.0, more)), "result": result})
    order = ("pass", "warn", "fail")
    return {"test": "region", "verdict": max((r["result"] for r in out), key=order.index), "regions": out}
