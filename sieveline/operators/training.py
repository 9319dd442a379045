"""Training of heads: distributed Newton fits, out-of-fold features, calibration, threshold, evaluation and gates per head."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.folds import poly31
from ..functions.vectors import dot, literal
from ..sources.shared import save, spread
from . import calibration as cals
from . import evaluation, gates, thresholds, tiers
from .scoring import Head, calibrate
from .sums import add_up

KNN_K, PCA_K, FOLDS, AUTO_MARGIN = 10, 50, 3, 0.2
#: Thresholds that a certified precision is tried at.
CANDIDATES = 150
#: References that a task holds at a time.
REFERENCE_ROWS = 1 << 14


def _matrix(b: pa.RecordBatch, vector: str) -> np.ndarray:
    col = b.column(vector)
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def fit_linear(rows: DataFrame, width: int, *, c: float = 1.0, balance: bool = True, vector: str = "x", label: str = "y", weight: str | None = None, rounds: int = 30) -> tuple[np.ndarray, float, bool]:
    """(weights, bias, converged): class-balanced L2 logistic regression by Newton steps over distributed sums.

    Rows (x, y[, w]) stay where they are; per round every task sends one gradient and Hessian.  Rows with a null vector or
    label, of another width or with numbers that are not finite are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    use = rows.select(F.transform(vector, lambda v: v.cast("double")).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")).filter((F.size("x") == width) & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    use = save(use, "fit-rows")  # read once per round
    pos, total = use.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
    if not total or not pos or pos >= total:
        raise ValueError("both classes are needed")
    cw = (total / (2 * pos), total / (2 * (total - pos))) if balance else (1.0, 1.0)
    d = width + 1
    beta, penalty, best = np.zeros(d), np.r_[np.full(width, 1 / c), 0.0], None
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(beta)

        def job(b: pa.RecordBatch, sent=sent) -> np.ndarray:
            x = np.c_[_matrix(b, "x"), np.ones(b.num_rows)]
            y = b.column("y").to_numpy()
            s = b.column("w").to_numpy() * np.where(y > 0, cw[0], cw[1])
            z = x @ sent.value
            p = stats.sigmoid(z)
            return np.r_[(s * (np.logaddexp(0, z) - y * z)).sum(), x.T @ (s * (p - y)), ((x * (s * p * (1 - p))[:, None]).T @ x).ravel()]

        t = add_up(use, job, 1 + d + d * d)
        loss = t[0] + 0.5 * (penalty * beta * beta).sum()
        if best is not None and loss > best[0] + 1e-9 * abs(best[0]):
            beta = (beta + best[1]) / 2  # the step was too long
            continue
        grad = t[1 : 1 + d] + penalty * beta
        step = np.linalg.solve(t[1 + d :].reshape(d, d) + np.diag(penalty + 1e-10), grad)
        best = (loss, beta)
        if np.abs(step).max() < 1e-9 * (1 + np.abs(beta).max()):
            return beta[:-1], float(beta[-1]), True
        beta = beta - step
    return beta[:-1], float(beta[-1]), False


def standardiser(rows: DataFrame, width: int, vector: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations per position (1 where constant), to be folded back into the weights."""
    use = rows.select(F.transform(vector, lambda v: v.cast("double")).alias("x")).filter(F.size("x") == width)
    t = add_up(use, lambda b: np.r_[b.num_rows, (m := _matrix(b, "x")).sum(0), (m**2).sum(0)], 1 + 2 * width)
    mean = t[1 : 1 + width] / max(1, t[0])
    sd = np.sqrt(np.maximum(0, t[1 + width :] / max(1, t[0]) - mean**2))
    return mean, np.where(sd > 1e-12, sd, 1.0)


def knn_feature(rows: DataFrame, reference: DataFrame, k: int = KNN_K, *, out_of_fold: bool = False) -> DataFrame:
    """(id, feature): mean cosine to the k nearest positive references minus that to the k nearest negative ones.

    rows: id, embedding[, fold]; reference: rid, embedding, y[, fold].  With ``out_of_fold`` references of the row's own fold
    don't count; a row is no reference of itself.  The reference is sent in blocks of REFERENCE_ROWS; every Arrow batch
    keeps its k best per class and block, so no pairs are shuffled.  Ties of cosine don't change the mean.
    """
    cols = ["rid", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("y").cast("int").alias("y"), (F.col("fold") if out_of_fold else F.lit(0)).cast("long").alias("f")]
    ref = reference.filter(F.col("embedding").isNotNull()).select(*cols)
    blocks = max(1, -(-ref.count() // REFERENCE_ROWS))
    use = spread(rows.filter(F.col("embedding").isNotNull()).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("fold") if out_of_fold else F.lit(0)).cast("long").alias("f")))
    kind, out = rows.schema["id"].dataType.simpleString(), None
    for b in range(blocks):
        t = (ref if blocks == 1 else ref.filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b)).toArrow()
        if not t.num_rows:
            continue
        r = np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        r = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)
        sent = rows.sparkSession.sparkContext.broadcast((r, np.array(t.column("rid").to_pylist()), t.column("y").to_numpy(), t.column("f").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            r, rid, y, f = sent.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    x = _matrix(part, "x")
                    c = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ r.T
                    c[np.array(part.column("id").to_pylist())[:, None] == rid] = -2
                    if out_of_fold:
                        c[part.column("f").to_numpy()[:, None] == f] = -2
                    for v in (0, 1):
                        own = c[:, y == v]
                        n = min(k, own.shape[1])
                        if n:
                            top = -np.partition(-own, n - 1, axis=1)[:, :n]
                            at, slot = np.nonzero(top > -1.5)
                            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(np.full(len(at), v, np.int32)), pa.array(top[at, slot])], names=["id", "y", "c"])

        near = use.mapInArrow(run, f"id {kind}, y int, c double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return rows.select("id", F.lit(0.0).alias("feature")).limit(0)
    if blocks > 1:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("id", "y").orderBy(F.desc("c")))).filter(F.col("_r") <= k)
    g = out.groupBy("id").agg(F.avg(F.when(F.col("y") == 1, F.col("c"))).alias("p"), F.avg(F.when(F.col("y") == 0, F.col("c"))).alias("n"))
    return g.select("id", (F.coalesce("p", F.lit(0.0)) - F.coalesce("n", F.lit(0.0))).alias("feature"))


def fit_pca(rows: DataFrame, width: int, k: int = PCA_K, vector: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of the top k directions, from distributed second moments."""
    use = rows.select(F.transform(vector, lambda v: v.cast("double")).alias("x")).filter(F.size("x") == width)
    t = add_up(use, lambda b: np.r_[b.num_rows, (m := _matrix(b, "x")).sum(0), (m.T @ m).ravel()], 1 + width + width * width)
    n, mean = max(1, t[0]), t[1 : 1 + width] / max(1, t[0])
    val, vec = np.linalg.eigh(t[1 + width :].reshape(width, width) / n - np.outer(mean, mean))
    return mean, vec[:, ::-1][:, : min(k, width)].T


def route_rates(labels: DataFrame) -> DataFrame:
    """(finer, rate): smoothed share of positives per finer label, (positives + base) / (rows + 1)."""
    base = labels.agg(F.avg("y")).first()[0] or 0.0
    return labels.groupBy("finer").agg(((F.sum("y") + base) / (F.count(F.lit(1)) + 1)).alias("rate"))


def guarantee_cost(rows: DataFrame, target: float, kind: str = "recall", score_col: str = "s", label: str = "y") -> float:
    """False alarms at the target recall, or 1 - the best recall at the target precision; tied scores stay together."""
    if kind == "recall":
        return tiers.cascade_cost(rows.withColumnsRenamed({score_col: "s", label: "y"}) if (score_col, label) != ("s", "y") else rows, target)
    c = thresholds.running_sums(rows, score_col, {"tp": F.col(label), "fired": F.lit(1.0)})
    total = rows.agg(F.sum(label)).first()[0] or 0
    r = c.filter(F.col("tp") >= target * F.col("fired") - 1e-12).agg(F.max("tp")).first()[0]
    return 1.0 - float(r or 0.0) / total if total else 1.0


def choose_type(costs: dict[str, float], margin: float = AUTO_MARGIN) -> str:
    """The cheapest non-linear type where it beats the linear cost by the margin, else linear."""
    rest = {k: v for k, v in costs.items() if k != "linear" and v < costs["linear"] * (1 - margin) - 1e-12}
    return min(rest, key=lambda k: (rest[k], k)) if rest else "linear"


def cross_validated(rows: DataFrame, width: int, *, key: str = "id", folds: int = FOLDS, vector: str = "x", **fit) -> DataFrame:
    """Rows with s, the raw score of a head trained on the other folds (folds by key hash)."""
    f = rows.withColumn("_fold", poly31(F.col(key).cast("string"), folds))
    out = None
    for k in range(folds):
        w, b, _ = fit_linear(f.filter(F.col("_fold") != k), width, vector=vector, **fit)
        part = f.filter(F.col("_fold") == k).withColumn("s", raw_score(F.col(vector), w, b)).drop("_fold")
        out = part if out is None else out.unionByName(part)
    return out


def raw_score(vector: Column, w: np.ndarray, b: float) -> Column:
    return dot(vector, literal(w)) + F.lit(float(b))


def with_weak(train: DataFrame, weak: DataFrame, held: DataFrame, share: float = 0.5) -> tuple[DataFrame, dict]:
    """Training rows with weak positives (id, x, weight, rule_id), and a summary per rule.

    Weak rows carry a weight in [0, 1] and are scaled together to at most ``share`` of the gold positives' weight.  A weak
    vector that a held row (calibration or test) also has is refused.
    """
    bad = weak.filter(~F.coalesce(F.col("weight").between(0, 1), F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("weak weights must lie in [0, 1]")
    v = F.transform("x", lambda e: e.cast("double"))
    leak = weak.select("id", v.alias("x")).join(held.select(v.alias("x")).distinct(), "x", "left_semi").count()
    if leak:
        raise ValueError(f"{leak} weak rows have the vector of a calibration or test row")
    gold = train.filter("y = 1").agg(F.sum("w")).first()[0] or 0.0
    rules = {r.rule_id: {"rows": r.n, "weight": r.w} for r in weak.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    total = sum(r["weight"] for r in rules.values())
    scale = min(1.0, share * gold / total) if total else 1.0
    more = weak.select(F.col("id").cast(train.schema["id"].dataType).alias("id"), v.alias("x"), F.lit(1).alias("y"), (F.col("weight") * scale).alias("w"), F.concat(F.lit("weak "), F.col("id").cast("string")).alias("key"))
    return train.unionByName(more, allowMissingColumns=True), {"scale": scale, "rules": rules}


class CalibrationRemainderError(ValueError):
    """Rules and tiers decide every calibration row, so nothing is left to calibrate the head on."""


def _recall(policy: dict, p: DataFrame, delta: float, background: DataFrame | None) -> dict:
    """Threshold, guarantee, failures and warnings of a recall policy, by its mode."""
    pos, neg = p.filter("y = 1"), p.filter("y = 0")
    cap, rate = policy.get("max_false_alarm"), policy.get("background_rate") if background is not None else None
    out = {"failures": [], "warnings": []}
    if policy.get("mode", "auto") == "design":
        goal = policy["target_recall"] + policy.get("reserve", 0.0)
        t = thresholds.risk_threshold(pos.select(F.col("p").alias("s"), F.col("stratum").alias("h"), F.col("stratum_size").cast("double").alias("N")), 1 - goal, delta)
        kind = "design"
        if t is None:
            out["failures" if not policy.get("allow_heuristic") else "warnings"].append(f"recall {goal} can't be held with the calibration sample")
            t, kind = (thresholds.pick_threshold(pos, neg, policy["design_recall"]) if policy.get("allow_heuristic") else stats.next_up(1.0)), "none"
        limits = [thresholds.false_alarm_cap(neg, cap)] if cap is not None else []
        limits += [thresholds.false_alarm_cap(background, rate)] if rate is not None else []
        if limits and max(limits) > t:
            out["failures"].append(f"the false-alarm limits raise the threshold to {max(limits):.4g}, which voids the guarantee of {t:.4g}")
            t, kind = max(limits), "none"
        return out | {"threshold": t, "guarantee": {"kind": kind, "mode": "design", "alpha": 1 - policy["target_recall"], "delta": delta}}
    per = thresholds.group_scores(pos, "group", "p", True), thresholds.group_scores(neg, "group", "p", False)
    limits = [("false_alarm", per[1], cap)] if cap is not None else []
    limits += [("background_rate", background, rate)] if rate is not None else []
    sel = thresholds.conformal_threshold(policy.get("mode", "auto"), policy["target_recall"], per[0], limits, delta=delta, heuristic_available=policy.get("design_recall") is not None, allow_heuristic=policy.get("allow_heuristic", False))
    t = sel.threshold if sel.threshold is not None else thresholds.pick_threshold(pos, neg, policy["design_recall"], cap)
    g = {"kind": sel.kind, "mode": sel.mode, "alpha": sel.alpha, "delta": sel.delta, "sufficiency": sel.sufficiency, **sel.budgets}
    if policy.get("slices"):
        need = stats.minimum_samples(sel.alpha, sel.delta)
        for r in evaluation.slices(pos, t, policy["slices"]).filter(F.col("positives") < need).orderBy("slice").collect():
            out["warnings"].append(f"slice {r.slice}: {r.positives} calibration positives of {need} that a guarantee of its own would need")
    return {"threshold": t, "guarantee": g, "failures": out["failures"] + sel.failures, "warnings": out["warnings"] + sel.warnings}


def _precision(policy: dict, p: DataFrame, delta: float, reference: DataFrame | None) -> dict:
    """Threshold of a precision policy: the target itself, or certified on a sampled calibration split."""
    goal = policy["target_precision"]
    if policy.get("mode") != "design":
        return {"threshold": goal, "guarantee": {"kind": "none", "mode": "heuristic"}, "failures": [], "warnings": []}
    qs = F.percentile_approx("p", [i / CANDIDATES for i in range(CANDIDATES)], 10 * CANDIDATES)
    steps = (reference if reference is not None else p).agg(qs.alias("q")).first().q
    rows = p.select(F.col("p").alias("s"), "y", F.col("stratum").alias("h"), F.col("stratum_size").cast("double").alias("N"))
    most = thresholds.kth(p, max(1, policy.get("min_fired", gates.MIN_SUPPORT)), "p")  # fewer fired rows certify nothing
    t = thresholds.design_precision(rows, [s for s in steps if most is None or s <= most], goal, delta)
    fine = t is not None
    return {"threshold": t if fine else stats.next_up(1.0), "guarantee": {"kind": "design" if fine else "none", "mode": "design", "metric": "precision", "alpha": 1 - goal, "delta": delta}, "failures": [] if fine else [f"no threshold holds precision {goal}"], "warnings": []}


def train_heads(rows: DataFrame, policies: dict[str, dict], width: int, *, c: float = 1.0, delta: float = 0.05, review_ratio: float = 0.5, calibration: str = "platt-firth", max_ece: float = 0.05, calibration_alpha: float | None = None, calibration_gate: str = "cox-corrected", weak: dict[str, DataFrame] | None = None, max_weak_share: float = 0.5, background: DataFrame | None = None, refit: str = "none") -> dict[str, dict]:
    """Per head: spec, features, guarantee, evaluation, failures and warnings.

    rows: id, x, split (train, calibration, test), group and label columns y_<head> (null: not labelled); optional w
    (training weight), finer (finer label), stratum and stratum_size (design modes), fired_<head> and dismissed_<head>
    (decided by rules or tiers before).  The test split chooses nothing.  A policy names its ``type`` (linear, knn, stack,
    finer, or auto among ``types``).  A recall policy {'kind': 'recall', 'target_recall', 'mode', 'max_false_alarm'?,
    'design_recall'?} goes through the conformal selection or, in mode design, through the survey bounds; a precision
    policy {'kind': 'precision', 'target_precision'} fires at the target, in mode design at a certified threshold.
    Decided rows count with score 1 or 0 for recall, false alarms and precision and not for calibration.  refit 'pooled'
    fits the calibrator again on calibration and test together; no decision changes.  No rows of a split reach the driver.
    """
    return {name: _train_head(rows, name, policy, width, c, delta, review_ratio, calibration, max_ece, calibration_alpha, calibration_gate, (weak or {}).get(name), max_weak_share, background, refit) for name, policy in policies.items()}


def _train_head(rows, name, policy, width, c, delta, review_ratio, method, max_ece, alpha, gate, weak, max_weak_share, background, refit) -> dict:
    from . import features as feats

    warnings: list[str] = []
    fired, dismissed = (F.coalesce(F.col(f"{k}_{name}"), F.lit(False)) if f"{k}_{name}" in rows.columns else F.lit(False) for k in ("fired", "dismissed"))
    own = rows.withColumn("y", F.col(f"y_{name}")).withColumn("preset", F.when(fired & dismissed, -1.0).when(fired, 1.0).when(dismissed, 0.0)).filter("y is not null")
    if own.filter("preset < 0").limit(1).count():
        raise ValueError(f"head {name}: rows are both fired and dismissed")
    key = F.coalesce(F.col("group").cast("string"), F.concat(F.lit("row "), F.col("id").cast("string")))  # a row without group is its own
    more = ["finer"] if "finer" in rows.columns else []
    train = own.filter("split = 'train'").select("id", F.transform("x", lambda v: v.cast("double")).alias("x"), "y", (F.col("w").cast("double") if "w" in rows.columns else F.lit(1.0)).alias("w"), key.alias("key"), *more)
    held = own.filter("split in ('calibration', 'test')").withColumn("group", key)
    summary = None
    if weak is not None:
        train, summary = with_weak(train, weak, held, max_weak_share)
    train = save(train, "training-rows")
    kinds = policy.get("types", ("linear", "knn", "stack")) if policy.get("type") == "auto" else (policy.get("type", "linear"),)
    fits, costs = {}, {}
    for kind in kinds:
        model, f = feats.fit_features(train, kind, width, c=c)
        f = save(train.join(f, "id").select("id", "key", "f", "y", "w"), "training-features")
        fits[kind] = model, f
        if len(kinds) > 1:
            scores = cross_validated(f, feats.feature_width(kind, width), key="key", vector="f", c=c, weight="w")
            costs[kind] = guarantee_cost(scores, policy.get("target_recall", policy.get("target_precision")), policy["kind"])
    kind = choose_type(costs) if len(kinds) > 1 else kinds[0]
    model, f = fits[kind]
    w, b, ok = fit_linear(f, feats.feature_width(kind, width), c=c, vector="f", weight="w")
    if not ok:
        warnings.append("the fit did not converge")
    vectors = held.select("id", "x").dropDuplicates(["id"])
    scored = held.drop("x", "f").join(model.apply(vectors), "id").withColumn("z", raw_score(F.col("f"), w, b)).drop("f")
    scored = save(scored, "head-scores")
    cal = scored.filter("split = 'calibration' and preset is null")
    n, pos = cal.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        raise CalibrationRemainderError(f"head {name}: no calibration row is left undecided")
    if not 0 < pos < n:
        raise ValueError(f"head {name}: the calibration split needs both classes")
    pair = None
    if method == "isotonic":
        fit = ("isotonic", *map(tuple, cals.fit_isotonic(cal.withColumn("p", 1 / (1 + F.exp(-F.col("z")))))))
    else:
        pair = cals.fit_pair(cal, firth=method == "platt-firth")
        fit = ("platt", pair.a, pair.c)
    head = Head(name, tuple(float(v) for v in w), b, fit, features=None if kind == "linear" else kind)
    p = scored.withColumn("p", F.coalesce("preset", calibrate(F.col("z"), fit)))
    apply = lambda d: model.apply(d.select("id", "x")).select("id", calibrate(raw_score(F.col("f"), w, b), fit).alias("p"))
    back = save(apply(background), "head-background") if background is not None and policy.get("background_rate") is not None else None
    pc = p.filter("split = 'calibration'")
    chosen = _recall(policy, pc, delta, back) if policy["kind"] == "recall" else _precision(policy, pc, delta, back)
    t, guarantee, failures = chosen["threshold"], chosen["guarantee"], list(chosen["failures"])
    warnings += chosen["warnings"]
    if fit[0] == "platt" and fit[1] <= 0 and guarantee["kind"] != "none":
        guarantee["kind"] = "none"
        failures.append("the calibrator's slope is not positive, which voids the guarantee")
    if t <= 0:
        failures.append("threshold of zero")
        t = stats.next_up(1.0)
    if back is not None:
        guarantee["background_upper"] = thresholds.background_upper(back, t, policy["background_rate"], 1 - delta)
    floor = t * review_ratio if policy.get("review_epsilon") is None else thresholds.review_floor(t, positives=pc.filter("y = 1"), epsilon=policy["review_epsilon"])
    test = p.filter("split = 'test'").withColumn("decided", F.col("preset").isNotNull())
    ev = evaluation.evaluate_head(test, t, group="group", decided="decided", fields=policy.get("slices", ()), guarantee=guarantee, delta=delta, gate=gate if alpha is not None else None, calibrator=pair, floor=floor, alpha=alpha)
    if "stratum_size" in rows.columns:
        ev["design"] = evaluation.design_estimates(test.filter("stratum_size is not null"), t)
    bad, warn = gates.gate_head(policy, ev, max_ece=max_ece, calibration_alpha=alpha, calibration=ev.get("calibration_test"))
    if refit == "pooled" and pair is not None and pair.a > 0 and t <= 1:
        again, levels = pooled_refit(scored.filter("preset is null"), (pair.a, pair.c), [t, floor])
        head, t, floor = replace(head, calibration=("platt", again.a, again.c)), *levels
    head = replace(head, threshold=float(t), review_floor=float(floor))
    return {"spec": head, "type": kind, "costs": costs, "features": model, "weak": summary, "guarantee": guarantee, "evaluation": ev, "failures": failures + bad, "warnings": warnings + warn}


def pooled_refit(rows: DataFrame, old: tuple[float, float], levels: Sequence[float]) -> tuple[cals.Pair, list[float]]:
    """The pair fitted on all rows (z, y), and the levels moved so that no row changes sides: each goes to the least score that reached it."""
    new = cals.fit_pair(rows, firth=True)
    out = []
    for t in levels:
        z = (float(stats.logit(t)) - old[1]) / old[0]
        least = rows.filter(F.col("z") >= z - 1e-12).agg(F.min("z")).first()[0]
        out.append(float(stats.sigmoid(new.a * (z if least is None else least) + new.c)))
    return new, out
