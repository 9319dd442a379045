"""Training and scoring of the cheap tiers: an edge that blends rules, n-grams and small vectors, and a middle model behind it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fnv_fold
from ..functions.vectors import dot, literal
from ..sources.shared import save
from . import thresholds, tiers, training
from .artifact import digest

#: The component scores of an edge, in the order of the blend.
SCORERS = ("rules", "lexical", "static", "vector")
FOLDS, DELTA = 5, 0.05

#: A fitted component: adds its score as a column of the given name.
Apply = Callable[[DataFrame, str], DataFrame]


@dataclass
class EdgeModel:
    """Blend of component scores with strict thresholds: fires above ``fire``, dismisses below ``dismiss``."""

    components: dict[str, Apply]
    parts: dict[str, dict]
    blend: tuple[np.ndarray, float]
    fire: float | None = None
    dismiss: float | None = None
    claims: dict = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with edge_score and edge_decision."""
        out = rows
        for name, apply in self.components.items():
            out = apply(out, f"_{name}")
        s = sum((F.lit(float(w)) * F.col(f"_{n}") for n, w in zip(self.components, self.blend[0])), F.lit(float(self.blend[1])))
        out = out.withColumn("edge_score", s).drop(*(f"_{n}" for n in self.components))
        return out.withColumn("edge_decision", tiers.tier_decision(F.col("edge_score"), self.fire, self.dismiss))

    def document(self) -> dict:
        """The head as JSON: parts, blend, thresholds and claims."""
        return {"scorers": list(self.components), "parts": self.parts, "blend": {"weights": [float(w) for w in self.blend[0]], "bias": self.blend[1]}, "fire": self.fire, "dismiss": self.dismiss, "claims": self.claims}

    def digest(self) -> str:
        return digest(self.document())


def _linear(rows: DataFrame, column: str) -> tuple[Apply, dict]:
    width = rows.filter(F.col(column).isNotNull()).select(F.size(column)).first()[0]
    w, b, _ = training.fit_linear(rows, width, vector=column)
    return (lambda d, out: d.withColumn(out, F.coalesce(dot(F.col(column), literal(w)) + F.lit(b), F.lit(0.0)))), {"weights": [float(v) for v in w], "bias": b}


def _lexical(rows: DataFrame, bits: int) -> tuple[Apply, dict]:
    model = tiers.lexical_model(tiers.lexical_features(rows, bits=bits))
    at = np.flatnonzero(model.coefficients.toArray())

    def apply(d: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(tiers.lexical_features(d, bits=bits))
        return scored.withColumn(out, vector_to_array("rawPrediction")[1]).drop("lexical", "rawPrediction", "probability", "prediction")

    return apply, {"bits": bits, "index": at.tolist(), "weight": model.coefficients.toArray()[at].tolist(), "bias": model.intercept}


def _fit(rows: DataFrame, scorers: Sequence[str], bits: int) -> dict[str, tuple[Apply, dict]]:
    fits: dict[str, tuple[Apply, dict]] = {}
    for name in scorers:
        if name == "rules":
            fits[name] = (lambda d, out: d.withColumn(out, F.coalesce(F.col("rule"), F.lit(False)).cast("double"))), {}
        else:
            fits[name] = _lexical(rows, bits) if name == "lexical" else _linear(rows, name)
    return fits


def _both(rows: DataFrame) -> bool:
    return rows.select("y").distinct().count() == 2


def train_edge(rows: DataFrame, *, max_false_alarms: float = tiers.EDGE_MAX_FALSE_ALARMS, max_dismissed: float | Sequence[float] = 0.0, scorers: Sequence[str] = ("rules", "lexical"), delta: float = DELTA, bits: int = tiers.BITS) -> dict:
    """The edge of one head: rungs (one model per dismissal share, boldest first), out-of-fold train scores, warnings.

    rows: id, text, y, split, group; rule (boolean) for the rules, static and vector (arrays) for these scorers;
    optional stratum and stratum_size of a sampled calibration split.  The blend is fitted on component scores of the
    other folds (by group); a fold whose rest has one class takes the whole fit and scores 0.  Thresholds are certified on
    the calibration split.  Null texts have no n-grams; rows without a label are left out.
    """
    warnings = []
    names = [s for s in SCORERS if s in scorers]
    if "rules" in names and "rule" not in rows.columns:
        names.remove("rules")
        warnings.append("no rule column: the edge goes without rules")
    own = rows.filter("y is not null")
    train = save(own.filter("split = 'train'").withColumn("_fold", fnv_fold(F.coalesce(F.col("group").cast("string"), F.col("id").cast("string")), FOLDS)), "edge-train")
    if not names or not _both(train):
        raise ValueError("an edge needs a scorer and training rows of both classes")
    whole = _fit(train.drop("_fold"), names, bits)
    parts = []
    for k in range(FOLDS):
        rest, mine = train.filter(F.col("_fold") != k).drop("_fold"), train.filter(F.col("_fold") == k).drop("_fold")
        known = _both(rest)
        out = mine
        for n, (apply, _) in (_fit(rest, names, bits) if known else whole).items():
            out = apply(out, f"_{n}")
        parts.append(out.select("id", "y", F.array(*(F.col(f"_{n}") for n in names)).alias("x"), F.lit(known).alias("known")))
    folded = parts[0]
    for p in parts[1:]:
        folded = folded.unionByName(p)
    folded = save(folded, "edge-folds")
    w, b, _ = training.fit_linear(folded, len(names))
    model = EdgeModel({n: f[0] for n, f in whole.items()}, {n: f[1] for n, f in whole.items()}, (w, b))
    scores = folded.select("id", F.when(F.col("known"), dot(F.col("x"), literal(w)) + F.lit(b)).otherwise(F.lit(float(b))).alias("s"))
    cal = save(model.score(own.filter("split = 'calibration'")), "edge-calibration")
    sampled = {"stratum": "stratum", "size": "stratum_size"} if "stratum_size" in rows.columns else {}
    shares = [max_dismissed] if isinstance(max_dismissed, (int, float)) else list(max_dismissed)
    rungs = []
    for share in sorted(set(shares), reverse=True):
        fire, dismiss = tiers.certify(cal, max_false_alarms, share, delta, score="edge_score", **sampled)
        rungs.append(EdgeModel(model.components, model.parts, model.blend, fire, dismiss if share > 0 else None, {"max_false_alarms": max_false_alarms, "max_dismissed": share, "delta": delta}))
    return {"rungs": rungs, "train_scores": scores, "warnings": warnings}


@dataclass
class MiddleModel:
    """A linear score behind the edge; decides only what the edge left open."""

    weights: np.ndarray
    bias: float
    fire: float | None
    dismiss: float | None
    claims: dict

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows (with edge_decision) with middle_score, middle_decision and tier_decision of both."""
        s = dot(F.col("middle"), literal(self.weights)) + F.lit(self.bias)
        own = F.when(F.col("edge_decision").isNull(), tiers.tier_decision(F.col("middle_score"), self.fire, self.dismiss))
        out = rows.withColumn("middle_score", s).withColumn("middle_decision", own)
        return out.withColumn("tier_decision", F.coalesce("edge_decision", "middle_decision"))

    def document(self) -> dict:
        return {"weights": [float(w) for w in self.weights], "bias": self.bias, "fire": self.fire, "dismiss": self.dismiss, "claims": self.claims}

    def digest(self) -> str:
        return digest(self.document())


def train_middle(rows: DataFrame, edge: EdgeModel, target_recall: float, *, max_false_alarms: float = tiers.MIDDLE_MAX_FALSE_ALARMS, max_dismissed: float | None = None, delta: float = DELTA) -> MiddleModel | None:
    """The middle tier of one head, None where it would decide nothing.

    rows: as for the edge, with the vector ``middle``.  Budgets are cumulative: on the calibration split the edge's
    decisions stand first and last, so what it has fired or dismissed wrongly is spent.  With no larger firing budget
    than the edge's the middle only dismisses.
    """
    own = rows.filter("y is not null")
    width = own.filter("middle is not null").select(F.size("middle")).first()[0]
    w, b, _ = training.fit_linear(own.filter("split = 'train'"), width, vector="middle")
    share = edge.claims["max_dismissed"] + tiers.EXTRA_DISMISSAL * (1 - target_recall) if max_dismissed is None else max_dismissed
    cal = edge.score(own.filter("split = 'calibration'")).withColumn("_s", dot(F.col("middle"), literal(w)) + F.lit(b))
    cal = save(cal.withColumn("s", tiers.pin(F.col("edge_decision"), F.col("_s"))), "middle-calibration")
    sampled = {"stratum": "stratum", "size": "stratum_size"} if "stratum_size" in rows.columns else {}
    fire, dismiss = tiers.certify(cal, max_false_alarms, share, delta, **sampled)
    open_ = lambda t: t if t is not None and abs(t) < tiers.PIN else None
    fire = open_(fire) if max_false_alarms > edge.claims["max_false_alarms"] else None
    dismiss = open_(dismiss)
    if fire is None and dismiss is None:
        return None
    return MiddleModel(w, b, fire, dismiss, {"max_false_alarms": max_false_alarms, "max_dismissed": share, "delta": delta, "edge": edge.digest()})


def assemble(schema: str, heads: dict[str, EdgeModel | MiddleModel]) -> dict:
    """The tier's document with every head's digest."""
    return {"schema": schema, "heads": {n: m.document() for n, m in sorted(heads.items())}, "digests": {n: m.digest() for n, m in sorted(heads.items())}}


def train_with_edge(rows: DataFrame, name: str, policy: dict, width: int, edge: dict, **options) -> dict:
    """A head behind each rung of its edge in turn, from the boldest: the first that passes its gates with a guarantee, else the last.

    rows: as for ``training.train_heads`` with id; the rung's decisions on them are presets of the head.  The guarantee
    names the rung, its digest and the joint delta of everything that was tried.
    """
    rungs, tried = edge["rungs"], None
    for i, rung in enumerate(rungs):
        d = rung.score(rows).withColumn(f"fired_{name}", F.col("edge_decision").eqNullSafe("fire")).withColumn(f"dismissed_{name}", F.col("edge_decision").eqNullSafe("dismiss")).drop("edge_score", "edge_decision")
        try:
            tried = training.train_heads(d, {name: policy}, width, **options)[name]
        except training.CalibrationRemainderError:
            continue
        g = tried["guarantee"]
        claims = int(rung.fire is not None) + int(rung.dismiss is not None)
        g["chain"] = thresholds.guarantee_chain(claims, len(rungs), rung.claims["delta"])
        g["edge"] = {"rung": i, "digest": rung.digest(), **rung.claims}
        tried["edge"] = rung
        if g["kind"] != "none" and not tried["failures"]:
            break
    if tried is None:
        raise training.CalibrationRemainderError(f"head {name}: every rung decides all calibration rows")
    return tried
