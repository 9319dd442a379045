import math

import numpy as np
import pytest

from sieveline.functions import stats as s


def test_sizes_for_order_statistics():
    assert s.minimum_samples(0.05) == 19
    assert s.minimum_samples(0.05, 0.05) == 59


@pytest.mark.parametrize(("n", "rate"), [(65, 0.892), (100, 0.870), (500, 0.832)])
def test_recall_headroom(n, rate):
    k = next(k for k in range(n + 1) if s.clopper_pearson_lower(k, n, 0.95) >= 0.8)
    assert round(k / n, 3) == pytest.approx(rate, abs=0.0015)


def test_bounds_at_the_ends():
    assert s.clopper_pearson_lower(0, 10, 0.95) == 0
    assert s.clopper_pearson_upper(10, 10, 0.95) == 1
    assert s.clopper_pearson_upper(0, 10, 0.95) == pytest.approx(1 - 0.05**0.1)
    assert s.wilson(96, 100)[0] >= 0.9 > s.wilson(95, 100)[0]


def test_binomial_cdf_against_direct_sums():
    for n, p in ((10, 0.3), (50, 0.9), (7, 0.5)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert s.binomial_cdf(k, n, p) == pytest.approx(want, abs=1e-12)


def test_conformal_pac_holds_its_confidence():
    rng, fails = np.random.default_rng(1), 0
    for _ in range(400):
        t = s.conformal_lower(rng.random(150), 0.1, 0.05)
        fails += t > 0.1  # uniform scores: the share below t is t
    assert fails / 400 <= 0.05 + 3 * math.sqrt(0.05 * 0.95 / 400)


def test_conformal_is_infeasible_for_few_rows():
    assert s.conformal_lower([0.5] * 18, 0.05) is None
    assert s.conformal_lower([0.5] * 19, 0.05) == 0.5
    assert s.conformal_upper([0.5] * 19, 0.05) == math.nextafter(0.5, 1)


def test_isotonic_and_platt():
    xs, ys = s.fit_isotonic([0.1, 0.2, 0.3, 0.4], [0, 1, 0, 1])
    assert ys == sorted(ys) and s.predict_isotonic(xs, ys, 0.0) == 0 and s.predict_isotonic(xs, ys, 1.0) == 1
    rng = np.random.default_rng(2)
    z = rng.normal(size=4000)
    y = rng.random(4000) < s.sigmoid(1.5 * z - 0.5)
    a, c = s.fit_platt(z, y, firth=True)
    assert a == pytest.approx(1.5, abs=0.2) and c == pytest.approx(-0.5, abs=0.15)
    a, c = s.fit_platt([-1, -2, 1, 2], [0, 0, 1, 1], firth=True)
    assert math.isfinite(a) and a > 0  # separated classes stay finite


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < s.sigmoid(x @ [1, -2, 0.5])).astype(float)
    w, b, ok = s.fit_logistic(x, y)
    p = s.sigmoid(x @ w + b)
    assert ok and np.abs(x.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_stratified_ratio_is_unbiased_and_covers():
    rng = np.random.default_rng(4)
    frame = np.r_[rng.random(200) < 0.6, rng.random(800) < 0.1].astype(float)
    stratum = np.r_[np.zeros(200, int), np.ones(800, int)]
    est, cover = [], 0
    for _ in range(300):
        at = np.r_[rng.choice(200, 60, False), 200 + rng.choice(800, 60, False)]
        r, se, n = s.stratified_ratio(frame[at], np.ones(120), stratum[at], {0: 200, 1: 800})
        est.append(r)
        lo, hi = s.interval(r, se, n)
        cover += lo <= frame.mean() <= hi
    assert np.mean(est) == pytest.approx(frame.mean(), abs=0.01) and cover / 300 >= 0.93


def test_design_risk_threshold_holds_its_confidence():
    rng, fails, feasible = np.random.default_rng(5), 0, 0
    for _ in range(150):
        t = s.design_risk_threshold(rng.random(120), np.repeat([0, 1], 60), {0: 600, 1: 3000}, 0.2, 0.05)
        if t is not None:
            feasible += 1
            fails += t > 0.2
    assert feasible > 100 and fails / feasible <= 0.05 + 3 * math.sqrt(0.05 * 0.95 / feasible)


def test_single_unit_strata_and_empty_inputs():
    r, se, _ = s.stratified_ratio([1, 0, 1], [1, 1, 1], ["a", "b", "c"], {"a": 5, "b": 5, "c": 5})
    assert r == pytest.approx(2 / 3) and se > 0
    assert s.design_risk_threshold([], [], {}, 0.1, 0.05) is None
    assert s.kish([]) == 0.0


def test_calibration_tests():
    rng = np.random.default_rng(6)
    p = rng.uniform(0.05, 0.95, 3000)
    good, bad = rng.random(3000) < p, rng.random(3000) < p**3
    assert s.cox_test(p, good)["p_value"] > 1e-3 > s.cox_test(p, bad)["p_value"]
    assert s.ece(p, good)[0] < 0.05 < s.ece(p, bad)[0]
    same = s.cox_test_corrected((1.0, 0.0), np.eye(2) * 0.01, (1.0, 0.0), np.eye(2) * 0.01)
    assert same["applied"] and same["p_value"] == 1.0
    assert [x["result"] for x in s.region_test(p, bad, 0.5, 0.02, 0.05)] == ["fail", "fail"]


def test_digest_ignores_key_order():
    assert s.canonical_digest({"a": 1, "b": [1, 2]}) == s.canonical_digest({"b": [1, 2], "a": 1}) != s.canonical_digest({"a": 1, "b": [2, 1]})
    assert len(s.stable_id(["x", 1])) == 13


def test_share_bound_holds_its_confidence():
    rng, fails = np.random.default_rng(7), 0
    frames = {"a": (rng.random(600) < 0.3).sum() / 600, "b": (rng.random(3000) < 0.1).sum() / 3000}
    truth = (600 * frames["a"] + 3000 * frames["b"]) / 3600
    for _ in range(400):
        below = {"a": int(rng.hypergeometric(round(600 * frames["a"]), 600 - round(600 * frames["a"]), 60)), "b": int(rng.hypergeometric(round(3000 * frames["b"]), 3000 - round(3000 * frames["b"]), 60))}
        fails += s.share_bound(below, {"a": (60, 600.0), "b": (60, 3000.0)}, 0.05) < truth
    assert fails / 400 <= 0.05 + 3 * math.sqrt(0.05 * 0.95 / 400)


def test_stable_ids_are_the_low_bits_of_fnv():
    h = 0xCBF29CE484222325
    for c in '["x",1]':
        h = ((h ^ ord(c)) * 0x100000001B3) % 2**64
    assert s.stable_id(["x", 1], "d") == f"d_{h % 2**52:013x}" and s.stable_id(["x", 1]) != s.stable_id(["x", 2])
