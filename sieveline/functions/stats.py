"""Numerics of the driver: exact bounds, fits and tests over aggregated inputs. No Spark here."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def next_up(x: float) -> float:
    return math.nextafter(x, math.inf)


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def normal_quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


# --- binomial ------------------------------------------------------------------------------------


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of Binomial(n, p), summed in logs from the nearer tail."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    if k > n * p:
        return 1.0 - _tail(n - k - 1, n, 1 - p)
    return _tail(k, n, p)


def _tail(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, x, ratio = 1.0, 1.0, (1 - p) / p
    for i in range(k, 0, -1):
        x *= i / (n - i + 1) * ratio
        total += x
        if x < total * 1e-17:
            break
    return min(1.0, math.exp(term) * total)


def _bisect(f: Callable[[float], float], lo: float, hi: float, rounds: int = 100) -> float:
    """Root of an increasing function."""
    for _ in range(rounds):
        mid = (lo + hi) / 2
        if f(mid) < 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def clopper_pearson_lower(k: int, n: int, confidence: float) -> float:
    if k <= 0 or n <= 0:
        return 0.0
    a = 1 - confidence
    return _bisect(lambda p: (1 - binomial_cdf(k - 1, n, p)) - a, 0.0, 1.0)


def clopper_pearson_upper(k: int, n: int, confidence: float) -> float:
    if n <= 0 or k >= n:
        return 1.0
    a = 1 - confidence
    return _bisect(lambda p: a - binomial_cdf(k, n, p), 0.0, 1.0)


def wilson(k: float, n: float, z: float = 1.959963984540054) -> tuple[float, float]:
    if n <= 0:
        return 0.0, 1.0
    p = k / n
    mid, half, den = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return max(0.0, (mid - half) / den), min(1.0, (mid + half) / den)


def exceedance_test(k: int, n: int, p0: float, alpha: float) -> tuple[float, bool]:
    """One-sided P(X >= k) under p0 and whether it is at most alpha."""
    p = 1 - binomial_cdf(k - 1, n, p0)
    return p, p <= alpha


# --- conformal order statistics --------------------------------------------------------------------


def minimum_samples(alpha: float, delta: float | None = None) -> int:
    """Least positives for which an order statistic can hold alpha in expectation, or with confidence 1 - delta."""
    if delta is None:
        return math.ceil(1 / alpha - 1e-9) - 1
    return math.ceil(math.log(delta) / math.log(1 - alpha) - 1e-9)


def conformal_rank(n: int, alpha: float, delta: float | None = None) -> int:
    """0-based rank of the ascending scores that may lie under the threshold's place; -1 if infeasible."""
    if delta is None:
        return math.floor(alpha * (n + 1) + 1e-12) - 1
    r = -1
    while r + 1 < n and binomial_cdf(r + 1, n, alpha) <= delta:
        r += 1
    return r


def conformal_lower(scores: Sequence[float], alpha: float, delta: float | None = None) -> float | None:
    """Highest threshold at which at most alpha of new scores fall below; None if infeasible."""
    r = conformal_rank(len(scores), alpha, delta)
    return None if r < 0 else float(np.sort(np.asarray(scores, float))[r])


def conformal_upper(scores: Sequence[float], alpha: float, delta: float | None = None) -> float | None:
    """Lowest threshold at which at most alpha of new scores reach it; None if infeasible."""
    r = conformal_rank(len(scores), alpha, delta)
    return None if r < 0 else next_up(float(np.sort(np.asarray(scores, float))[::-1][r]))


# --- survey estimates --------------------------------------------------------------------------------


def kish(weights: Sequence[float]) -> float:
    w = np.asarray(weights, float)
    return float(w.sum() ** 2 / (w**2).sum()) if len(w) and (w**2).sum() > 0 else 0.0


def weighted_quantile(values: Sequence[float], q: float, weights: Sequence[float] | None = None) -> float:
    """Inverse of the weighted distribution function (no interpolation)."""
    v = np.asarray(values, float)
    w = np.ones(len(v)) if weights is None else np.asarray(weights, float)
    order = np.argsort(v, kind="stable")
    share = np.cumsum(w[order]) / w.sum()
    return float(v[order][min(len(v) - 1, int(np.searchsorted(share, q - 1e-12)))])


def stratified_ratio(num: np.ndarray, den: np.ndarray, stratum: np.ndarray, size: dict) -> tuple[float, float, float]:
    """(ratio, standard error, Kish n) of sum(num) / sum(den) under stratified sampling without replacement.

    Linearised, with finite population correction; strata of one sampled unit pool their variance with the next.
    """
    num, den = np.asarray(num, float), np.asarray(den, float)
    keys, at, n = np.unique(np.asarray(stratum), return_inverse=True, return_counts=True)
    big = np.array([float(size[k]) for k in keys])
    w = (big / n)[at]
    total = float((w * den).sum())
    if total <= 0:
        return math.nan, math.nan, 0.0
    r = float((w * num).sum()) / total
    e = (num - r * den) / total
    groups: list[list[int]] = []
    lone: list[int] = []
    for k in np.argsort(-n, kind="stable"):
        if n[k] > 1:
            groups.append([int(k)])
        else:
            lone.append(int(k))
    while lone:
        pair, lone = lone[:2], lone[2:]
        if len(pair) == 2 or not groups:
            groups.append(pair)
        else:
            groups[-1] += pair
    var = 0.0
    for g in groups:
        mine = np.isin(at, g)
        m, bigm = int(mine.sum()), float(big[g].sum())
        if m > 1:
            var += bigm**2 * (1 - m / bigm if bigm > m else 0.0) * float(e[mine].var(ddof=1)) / m
    return r, math.sqrt(max(0.0, var)), kish(w[den != 0])


def ht_total(y: Sequence[float], pi: Sequence[float]) -> float:
    return float((np.asarray(y, float) / np.asarray(pi, float)).sum())


def bootstrap_weights(stratum: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rao-Wu multipliers: n - 1 draws with replacement per stratum, rescaled by n / (n - 1)."""
    rng = np.random.default_rng(seed)
    at = np.unique(np.asarray(stratum), return_inverse=True)[1]
    out = np.ones((replicates, len(at)))
    for k in range(at.max(initial=-1) + 1):
        own = np.flatnonzero(at == k)
        if len(own) > 1:
            out[:, own] = rng.multinomial(len(own) - 1, np.full(len(own), 1 / len(own)), size=replicates) * len(own) / (len(own) - 1)
    return out


def interval(ratio: float, se: float, effective: float) -> tuple[float, float]:
    """Hull of the normal interval and the exact one at the rounded Kish n (97.5 % each side)."""
    n = max(1, round_half_up(effective))
    k = min(n, max(0, round_half_up(ratio * n)))
    return max(0.0, min(ratio - 1.96 * se, clopper_pearson_lower(k, n, 0.975))), min(1.0, max(ratio + 1.96 * se, clopper_pearson_upper(k, n, 0.975)))


def design_risk_threshold(scores: Sequence[float], stratum: Sequence, size: dict, alpha: float, delta: float, *, method: str = "linearised", min_stratum: int = 5) -> float | None:
    """Highest threshold at which the weighted share of positives below it is at most alpha with confidence 1 - delta.

    scores and stratum are of the calibration positives; size gives the frame size of a stratum per sampled unit base.
    linearised: the larger of ratio + z * se and the exact bound at the rounded Kish n; exact: the strata's worst cases summed.
    """
    s, h = np.asarray(scores, float), np.asarray(stratum)
    if not len(s):
        return None
    keys, counts = np.unique(h, return_counts=True)
    if method == "linearised" and len(s) < min_stratum:
        return None
    best = None
    for t in np.unique(s):
        missed = (s < t).astype(float)
        if method == "exact":
            part = delta / len(keys)
            w = np.array([size[k] / c for k, c in zip(keys, counts)])
            worst = sum(clopper_pearson_upper(int(missed[h == k].sum()), int(c), 1 - part) * c * x for k, c, x in zip(keys, counts, w))
            bound = worst / float((counts * w).sum())
        else:
            r, se, n_eff = stratified_ratio(missed, np.ones(len(s)), h, size)
            n = max(1, round_half_up(n_eff))
            bound = max(r + normal_quantile(1 - delta) * se, clopper_pearson_upper(min(n, round_half_up(r * n)), n, 1 - delta))
        if bound > alpha:
            break
        best = float(t)
    return best


def design_precision_threshold(scores, y, stratum, size: dict, candidates: Sequence[float], target: float, delta: float) -> float | None:
    """Lowest of the candidates, scanned from the strictest until one fails, whose precision is at least target with confidence 1 - delta."""
    s, y, h = np.asarray(scores, float), np.asarray(y, float), np.asarray(stratum)
    best = None
    for t in sorted(candidates, reverse=True):
        fired = (s >= t).astype(float)
        if not fired.sum():
            continue
        r, se, n_eff = stratified_ratio(y * fired, fired, h, size)
        n = max(1, round_half_up(n_eff))
        lower = min(r - normal_quantile(1 - delta) * se, clopper_pearson_lower(min(n, math.floor(r * n + 1e-9)), n, 1 - delta))
        if lower < target:
            break
        best = float(t)
    return best


def ratio_from_sums(strata: list[tuple]) -> dict:
    """estimate, se, effective_n and ci95 from (n, N, sum a, sum b, sum a2, sum b2, sum ab) per stratum; b counts rows 0/1."""
    total = sum(N / n * b for n, N, _, b, *_ in strata)
    if total <= 0:
        return {"estimate": math.nan, "se": math.nan, "effective_n": 0.0, "ci95": (math.nan, math.nan)}
    r = sum(N / n * a for n, N, a, *_ in strata) / total
    var, spare = 0.0, []
    for s in sorted(strata, key=lambda s: -s[0]):
        spare.append(s)
        n = sum(x[0] for x in spare)
        if n < 2:
            continue
        N = sum(x[1] for x in spare)
        e = sum(x[2] - r * x[3] for x in spare) / total
        ee = sum(x[4] - 2 * r * x[6] + r * r * x[5] for x in spare) / total**2
        s2 = max(0.0, (ee - e * e / n) / (n - 1))
        var += N * N * (1 - n / N if N > n else 0.0) * s2 / n
        spare = []
    se = math.sqrt(var)
    w1, w2 = sum(N / n * b for n, N, _, b, *_ in strata), sum((N / n) ** 2 * b for n, N, _, b, *_ in strata)
    eff = w1 * w1 / w2 if w2 > 0 else 0.0
    return {"estimate": r, "se": se, "effective_n": eff, "ci95": interval(r, se, eff)}


def share_bound(below: dict, strata: dict, delta: float) -> float:
    """Upper bound of a frame's share from counts per stratum: ``below`` of the n sampled of N, by (n, N).

    The larger of ratio + z * se and the exact bound at the rounded Kish size.
    """
    total = sum(N for _, N in strata.values())
    r = sum(N * below[k] / n for k, (n, N) in strata.items()) / total
    var, kept = 0.0, []
    for k in sorted(strata, key=lambda k: (-strata[k][0], str(k))):
        kept.append(k)
        n, N = (sum(strata[x][i] for x in kept) for i in (0, 1))
        if n > 1:  # a stratum of one sampled row shares its variance with the next
            p = sum(below[x] for x in kept) / n
            var += N * N * max(0.0, 1 - n / N) * p * (1 - p) / (n - 1)
            kept = []
    eff = total**2 / sum(N * N / n for n, N in strata.values())
    m = max(1, round_half_up(eff))
    return max(r + normal_quantile(1 - delta) * math.sqrt(var) / total, clopper_pearson_upper(min(m, round_half_up(r * m)), m, 1 - delta))


# --- fits -----------------------------------------------------------------------------------------------


def balanced(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights that give both classes half of the weighted total."""
    total, pos = w.sum(), (w * y).sum()
    return w * np.where(y > 0, total / (2 * max(pos, 1e-300)), total / (2 * max(total - pos, 1e-300)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, c: float = 1.0, balance: bool = False, rounds: int = 100) -> tuple[np.ndarray, float, bool]:
    """(coefficients, intercept, converged): L2-penalised logistic regression, the intercept free, by damped Newton."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    w = balanced(y, w) if balance else w
    xb = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.ones(x.shape[1]), 0.0] / c
    beta = np.zeros(xb.shape[1])

    def loss(b: np.ndarray) -> float:
        z = xb @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b * b).sum())

    now = loss(beta)
    for _ in range(rounds):
        p = sigmoid(xb @ beta)
        grad = xb.T @ (w * (p - y)) + ridge * beta
        hess = (xb * (w * p * (1 - p))[:, None]).T @ xb + np.diag(ridge + 1e-10)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-8 and loss(beta - size * step) > now - 1e-4 * size * float(grad @ step):
            size /= 2
        beta = beta - size * step
        now = loss(beta)
        if np.abs(size * step).max() < 1e-10 * (1 + np.abs(beta).max()):
            return beta[:-1], float(beta[-1]), True
    return beta[:-1], float(beta[-1]), False


def fit_platt(z, y, w=None, firth: bool = False, rounds: int = 200) -> tuple[float, float]:
    """(a, c) of sigma(a z + c); lightly ridged, or bias-reduced by Firth's leverage term."""
    z, y = np.asarray(z, float), np.asarray(y, float)
    w = np.ones(len(z)) if w is None else np.asarray(w, float)
    x = np.c_[z, np.ones(len(z))]
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        v = np.maximum(w * p * (1 - p), 1e-12)
        info = (x * v[:, None]).T @ x + 1e-9 * np.eye(2)
        score = x.T @ (w * (y - p))
        if firth:
            lever = v * np.einsum("ij,jk,ik->i", x, np.linalg.inv(info), x)
            score = score + x.T @ (lever * (0.5 - p))
        else:
            score = score - 1e-3 * np.array([beta[0], 0.0])
        step = np.linalg.solve(info, score)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def platt_covariance(z, y, w, a: float, c: float) -> np.ndarray:
    p = sigmoid(a * np.asarray(z, float) + c)
    x = np.c_[np.asarray(z, float), np.ones(len(p))]
    w = np.ones(len(p)) if w is None else np.asarray(w, float)
    return np.linalg.pinv((x * (w * p * (1 - p))[:, None]).T @ x)


def fit_isotonic(p, y, w=None) -> tuple[list[float], list[float]]:
    """Knots (x, y) of the weighted increasing step fit (pool adjacent violators), clipped to [0, 1]."""
    p, y = np.asarray(p, float), np.asarray(y, float)
    w = np.ones(len(p)) if w is None else np.asarray(w, float)
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # value, weight, first x, last x
    for x, v, k in zip(p[order], y[order], w[order]):
        blocks.append([v, k, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    xs, ys = [], []
    for v, _, lo, hi in blocks:
        for x in (lo, hi) if hi > lo else (lo,):
            xs.append(float(x))
            ys.append(float(min(1.0, max(0.0, v))))
    return xs, ys


def predict_isotonic(xs: Sequence[float], ys: Sequence[float], p):
    return np.interp(p, xs, ys)


def prevalence_weights(y, share: float) -> np.ndarray:
    """Class weights under which positives are ``share`` of the total, which stays the number of rows."""
    y = np.asarray(y, float)
    n, pos = len(y), y.sum()
    return np.where(y > 0, share * n / max(pos, 1), (1 - share) * n / max(n - pos, 1))


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, c: float = 0.01, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients K x d, intercepts) of L2 multinomial regression by accelerated gradient descent."""
    n, d = x.shape
    hot = np.eye(classes)[y]
    coef, bias = np.zeros((classes, d)), np.zeros(classes)
    lip = 0.5 * float(np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2) + 1 / c
    vc, vb, t = coef.copy(), bias.copy(), 1.0
    for _ in range(rounds):
        z = x @ vc.T + vb
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - hot).T @ x + vc / c
        nc, nb = vc - g / lip, vb - (p - hot).sum(0) / lip
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vc, vb = nc + (t - 1) / nt * (nc - coef), nb + (t - 1) / nt * (nb - bias)
        if np.abs(nc - coef).max() < 1e-9:
            coef, bias = nc, nb
            break
        coef, bias, t = nc, nb, nt
    return coef, bias


# --- calibration checks ----------------------------------------------------------------------------------


def ece(p, y, w=None, bins: int = 10) -> tuple[float, list[dict]]:
    """Weighted expected calibration error over equal-width bins, and the bins that hold rows."""
    p, y = np.asarray(p, float), np.asarray(y, float)
    w = np.ones(len(p)) if w is None else np.asarray(w, float)
    at = np.minimum((p * bins).astype(int), bins - 1)
    out, total = [], 0.0
    for b in range(bins):
        own = at == b
        if own.any():
            m, o = float(np.average(p[own], weights=w[own])), float(np.average(y[own], weights=w[own]))
            total += w[own].sum() / w.sum() * abs(m - o)
            out.append({"bin": b, "n": int(own.sum()), "mean_predicted": m, "observed_rate": o})
    return float(total), out


def logit(p):
    p = np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def cox_test(p, y, w=None) -> dict:
    """Logistic regression of y on logit(p); likelihood ratio of (slope 1, intercept 0), 2 degrees of freedom."""
    z, y = logit(p), np.asarray(y, float)
    w = np.ones(len(z)) if w is None else np.asarray(w, float)
    a, c = fit_platt(z, y, w)
    ll = lambda b, k: float((w * (y * (b * z + k) - np.logaddexp(0, b * z + k))).sum())
    lr = max(0.0, 2 * (ll(a, c) - ll(1.0, 0.0)))
    return {"slope": a, "intercept": c, "statistic": lr, "p_value": math.exp(-lr / 2)}


def cox_test_corrected(cal: tuple[float, float], cal_cov: np.ndarray, test: tuple[float, float], test_cov: np.ndarray) -> dict:
    """Wald test of equal (slope, intercept) with the calibrator's own covariance added."""
    d = np.array(test) - np.array(cal)
    v = np.asarray(cal_cov) + np.asarray(test_cov)
    if not np.isfinite(v).all() or np.linalg.matrix_rank(v) < 2:
        return {"applied": False, "p_value": math.nan}
    stat = float(d @ np.linalg.solve(v, d))
    return {"applied": True, "statistic": stat, "p_value": math.exp(-stat / 2)}


def region_test(p, y, floor: float, tolerance: float, alpha: float, cal_cov: np.ndarray | None = None, z=None) -> list[dict]:
    """Observed against expected rate in the review region and the top decile; pass, warn or fail each."""
    p, y = np.asarray(p, float), np.asarray(y, float)
    out = []
    for name, own in (("review", p >= floor), ("top", p >= (np.quantile(p, 0.9) if len(p) else 1.0))):
        n = int(own.sum())
        if not n:
            out.append({"region": name, "n": 0, "result": "pass"})
            continue
        obs, exp = float(y[own].mean()), float(p[own].mean())
        se = math.sqrt(max(exp * (1 - exp), 1e-12) / n)
        more = 0.0
        if cal_cov is not None and z is not None:
            zz = np.asarray(z, float)[own]
            g = np.array([np.mean(p[own] * (1 - p[own]) * zz), np.mean(p[own] * (1 - p[own]))])
            more = float(g @ cal_cov @ g)
        gap, sd = abs(obs - exp), math.sqrt(se * se + more)
        beyond = gap - tolerance
        crit = normal_quantile(1 - alpha / 2) * sd
        out.append({"region": name, "n": n, "observed": obs, "expected": exp, "se": se, "se_calibrator": math.sqrt(more), "result": "fail" if beyond > crit else "warn" if beyond > 0 else "pass"})
    return out


# --- digests -----------------------------------------------------------------------------------------------


def canonical_digest(doc: object) -> str:
    """SHA-256 of the JSON with sorted keys and without spaces."""
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def stable_id(value: object, prefix: str = "") -> str:
    """The low 52 bits of the 64-bit FNV-1a over the UTF-16 units of the JSON, in hexadecimal, after the prefix and an underscore."""
    raw = json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode("utf-16-le")
    h = 0xCBF29CE484222325
    for low, high in zip(raw[::2], raw[1::2]):
        h = ((h ^ (low | high << 8)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (f"{prefix}_" if prefix else "") + format(h & 0xFFFFFFFFFFFFF, "013x")
