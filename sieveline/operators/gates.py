"""Gates of a head: a table of independent checks over one evaluation, each with what was measured and what was asked for."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..functions import stats

MIN_SUPPORT, MIN_CALIBRATION_ROWS = 30, 100
#: Error rate that all slices of a head share.
SLICE_ALPHA = 0.05


@dataclass(frozen=True)
class Finding:
    """A check that did not hold; ``fatal`` ones keep the head from being served."""

    gate: str
    fatal: bool
    measured: object
    asked: object
    note: str = ""

    def __str__(self) -> str:
        show = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v)
        return f"{self.gate}: {show(self.measured)}, asked for {show(self.asked)}" + (f" ({self.note})" if self.note else "")


@dataclass
class Case:
    """One head's policy and evaluation, and what the caller asks of calibration."""

    policy: dict
    ev: dict
    max_ece: float = 0.05
    alpha: float | None = None
    calibration: dict = field(default_factory=dict)

    @property
    def recall(self) -> bool:
        return self.policy["kind"] == "recall"

    @property
    def silent(self) -> bool:
        return not self.recall and math.isnan(self.ev["precision"])

    @property
    def guaranteed(self) -> bool:
        g = self.ev.get("guarantee") or {}
        return g.get("kind", "none") != "none" and (self.recall or g.get("metric") == "precision")

    @property
    def reached(self) -> float:
        """What the target is held against: the estimate, or under a guarantee the most that the test split allows."""
        if self.recall:
            return self.ev["certified"]["recall_upper"] if self.guaranteed else self.ev["recall"]
        return self.ev.get("precision_upper", self.ev["precision"]) if self.guaranteed else self.ev["precision"]

    @property
    def support(self) -> tuple[str, float, float | None]:
        """(what is counted, how many, the least number of the policy)."""
        if self.recall:
            return "test positives", self.ev.get("effective_positives", self.ev["positives"]), self.policy.get("min_positives")
        return "fired test rows", self.ev["fired"], self.policy.get("min_fired")


Check = Callable[[Case], Iterator[Finding]]


def support(c: Case) -> Iterator[Finding]:
    what, n, least = c.support
    if least is not None and n < least:
        yield Finding(what, True, n, least)
    if least is None and n < MIN_SUPPORT:
        yield Finding(what, False, n, MIN_SUPPORT, "the policy sets no least number")


def target(c: Case) -> Iterator[Finding]:
    measure, goal = ("recall", c.policy.get("target_recall")) if c.recall else ("precision", c.policy.get("target_precision"))
    if c.silent:
        yield Finding("precision", True, math.nan, goal, f"never fires on the test split at {c.ev['threshold']}")
    elif not c.reached >= goal:
        yield Finding(measure, True, c.reached, goal, "upper bound; the guarantee is contradicted" if c.guaranteed else "")


def lower_bound(c: Case) -> Iterator[Finding]:
    least = c.policy.get("min_recall_lower") if c.recall else None
    if least is not None and not c.ev["recall_ci95"][0] >= least:
        yield Finding("lower bound of recall", True, float(c.ev["recall_ci95"][0]), least)


def baseline(c: Case) -> Iterator[Finding]:
    other = c.ev.get("vs_baseline") if c.recall and c.policy.get("must_beat_baseline", True) else None
    if other and not other["classifier_only"]:
        yield Finding("positives that the baseline misses", True, 0, 1)


def every_slice(c: Case) -> Iterator[Finding]:
    """Recall per slice against the target, at a level that all judged slices share."""
    rule = c.policy.get("slice_gate") if c.recall else None
    if rule is None:
        return
    goal, least, named = rule.get("target", c.policy["target_recall"]), rule.get("min_positives", 10), rule.get("fields")
    own = [(k, s["positives"], s["recall"]) for k, s in c.ev.get("slices", {}).items() if not named or k.partition("=")[0] in named]
    enough = sum(n >= least for _, n, _ in own)
    z = stats.normal_quantile(1 - SLICE_ALPHA / (2 * enough)) if enough else 0.0
    for name, n, r in own:
        if n < least:
            yield Finding(f"positives of slice {name}", False, n, least)
            continue
        low, high = stats.wilson(stats.round_half_up(r * n), n, z)
        if low < goal:
            yield Finding(f"recall of slice {name}", high < goal, r, goal, f"interval {low:.3f} to {high:.3f}")


def groups(c: Case) -> Iterator[Finding]:
    least, n = (c.policy.get("min_positive_groups") if c.recall else None), c.ev.get("positive_groups", 0)
    if least is not None and n < least:
        yield Finding("groups of the test positives", False, n, least)


def calibration_error(c: Case) -> Iterator[Finding]:
    rows = c.ev["calibration_rows"]
    if math.isnan(c.ev["ece"]):
        yield Finding("calibration error", False, "not measured", c.max_ece, "the tiers before left no test rows")
    elif not c.ev["ece"] <= c.max_ece:
        yield Finding("calibration error", rows >= MIN_CALIBRATION_ROWS, c.ev["ece"], c.max_ece, f"{rows} rows")


def calibration_test(c: Case) -> Iterator[Finding]:
    t = c.calibration if c.alpha is not None else None
    if not t:
        return
    name = f"calibration ({t['test']})"
    if t["test"] == "region":
        if t["verdict"] != "pass":
            yield Finding(name, t["verdict"] == "fail", t["verdict"], "pass")
    elif not t.get("applied", True):
        yield Finding(name, False, "not applied", c.alpha, "the fit is singular or unstable")
    elif t["p_value"] <= c.alpha:
        yield Finding(name, True, t["p_value"], c.alpha)


#: The checks in the order of a report; each looks at the case alone.
CHECKS: tuple[Check, ...] = (support, target, lower_bound, baseline, every_slice, groups, calibration_error, calibration_test)


def findings(case: Case) -> list[Finding]:
    """Everything that does not hold.  A head whose threshold is beyond 1 is off, and nothing else is checked."""
    if case.ev["threshold"] > 1:
        return [Finding("disabled", True, case.ev["threshold"], 1, "no threshold met the policy")]
    return [f for check in CHECKS for f in check(case)]


def gate_head(policy: dict, ev: dict, *, max_ece: float = 0.05, calibration_alpha: float | None = None, calibration: dict | None = None) -> tuple[list[str], list[str]]:
    """(failures, warnings) of a head's evaluation against its policy (kind 'recall' or 'precision').

    A guaranteed head fails only where the test split contradicts the guarantee; calibration is gated where enough rows
    were left to the head.  ``calibration``: {'test': 'cox' | 'cox-corrected' | 'region', 'p_value' | 'verdict', 'applied'}.
    """
    found = findings(Case(policy, ev, max_ece, calibration_alpha, calibration or {}))
    return [str(f) for f in found if f.fatal], [str(f) for f in found if not f.fatal]
