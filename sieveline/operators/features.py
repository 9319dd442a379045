"""Features of heads beyond the vector itself: nearest references, a stack of scores, a finer label's routes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fnv_fold, poly31
from ..functions.vectors import dot, literal
from ..sources.shared import save
from .scoring import Head, calibrate
from .training import FOLDS, KNN_K, fit_linear, fit_pca, knn_feature, route_rates

HEAD_TYPES = ("linear", "knn", "stack", "finer")
FINER_SCALE, FINER_C, FINER_FOLDS = 0.25, 0.01, 5


@dataclass
class FinerModel:
    """Softmax over finer labels and each label's route rate towards the head."""

    classes: list[str]
    coef: np.ndarray
    intercept: np.ndarray
    rates: dict[str, float] = field(default_factory=dict)
    scale: float = FINER_SCALE

    def problems(self, width: int) -> list[str]:
        bad = []
        if len(self.classes) < 2 or len(set(self.classes)) != len(self.classes):
            bad.append("finer labels must be two or more, and different")
        if self.coef.shape != (len(self.classes), width) or self.intercept.shape != (len(self.classes),):
            bad.append(f"finer coefficients must be {len(self.classes)} x {width}")
        elif not (np.isfinite(self.coef).all() and np.isfinite(self.intercept).all()):
            bad.append("finer coefficients must be finite")
        if any(not 0 <= self.rates.get(c, -1) <= 1 for c in self.classes):
            bad.append("every finer label needs a route rate in [0, 1]")
        return bad

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.coef.T + self.intercept
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def route(self, x: np.ndarray) -> np.ndarray:
        """scale * logit of the expected route rate, kept 1e-6 from 0 and 1."""
        r = np.clip(self.probabilities(x) @ np.array([self.rates[c] for c in self.classes]), 1e-6, 1 - 1e-6)
        return self.scale * np.log(r / (1 - r))


def fit_finer(rows: DataFrame, c: float = FINER_C) -> FinerModel:
    """Multinomial regression of ``finer`` on the standardised x, L2 with strength c; null labels are left out."""
    use = save(rows.filter(F.col("finer").isNotNull() & F.col("x").isNotNull()).select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"), F.col("finer").cast("string").alias("finer")), "finer-rows")
    classes = [r.finer for r in use.select("finer").distinct().orderBy("finer").collect()]  # the labels of a head
    if len(classes) < 2:
        raise ValueError("two finer labels are needed")
    number = F.element_at(F.create_map(*(x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(float(i))))), F.col("finer"))
    fit = LogisticRegression(family="multinomial", regParam=1 / (c * use.count()), standardization=True, maxIter=200).fit(use.withColumn("label", number))
    return FinerModel(classes, fit.coefficientMatrix.toArray(), fit.interceptVector.toArray())


def _with_vector(rows: DataFrame, job, out: str = "f") -> DataFrame:
    """Rows (id, x, ...) with ``out``: an array per row from the matrix of a batch's x."""
    kinds = rows.withColumn(out, F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(job(x).tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return rows.mapInArrow(run, kinds)


def project(rows: DataFrame, mean: np.ndarray, parts: np.ndarray, vector: str, keep: Sequence[str]) -> DataFrame:
    """Rows with ``embedding`` on the principal directions, of unit length."""

    def job(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ parts.T
        n = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(n > 0, n, 1.0)

    return _with_vector(rows.select(*keep, F.col(vector).alias("x")), job, "embedding").drop("x")


@dataclass
class Features:
    """What a head of a type needs at scoring time."""

    kind: str
    reference: DataFrame | None = None
    linear: tuple[np.ndarray, float] | None = None
    pca: tuple[np.ndarray, np.ndarray] | None = None
    finer: FinerModel | None = None
    k: int = KNN_K

    def apply(self, rows: DataFrame) -> DataFrame:
        """(id, f) of rows (id, x)."""
        if self.kind == "linear":
            return rows.select("id", F.transform("x", lambda v: v.cast("double")).alias("f"))
        if self.kind == "finer":
            route = self.finer.route
            return _with_vector(rows.select("id", "x"), lambda x: np.c_[x, route(x)]).drop("x")
        near = knn_feature(rows.select("id", F.col("x").alias("embedding")), self.reference, self.k).withColumnRenamed("feature", "near")
        if self.kind == "knn":
            return near.select("id", F.array("near").alias("f"))
        w, b = self.linear
        raw = rows.select("id", (dot(F.col("x"), literal(w)) + F.lit(b)).alias("raw"))
        inside = knn_feature(project(rows, *self.pca, "x", ["id"]), project(self.reference, *self.pca, "embedding", ["rid", "y"]), self.k).withColumnRenamed("feature", "inside")
        return raw.join(near, "id").join(inside, "id").select("id", F.array("raw", "near", "inside").alias("f"))


def fit_features(train: DataFrame, kind: str, width: int, *, c: float = 1.0) -> tuple[Features, DataFrame]:
    """(features, (id, f) of the training rows): the latter out of fold, so that no row is its own evidence.

    train: id, x, y, key [, finer].  The references and models that a row is held against are of the other folds of its
    key (three folds; five for finer labels, where a fold without two labels takes the whole model).
    """
    if kind == "linear":
        f = Features("linear")
        return f, f.apply(train)
    if kind == "finer":
        whole = fit_finer(train)
        whole.rates = {r.finer: r.rate for r in route_rates(train.filter("finer is not null")).collect()}
        folded = train.withColumn("fold", fnv_fold(F.col("key").cast("string"), FINER_FOLDS))
        parts = []
        for k in range(FINER_FOLDS):
            rest = folded.filter(F.col("fold") != k)
            try:
                model = fit_finer(rest)
                base = {r.finer: r.rate for r in route_rates(rest.filter("finer is not null")).collect()}
                model.rates = {x: base.get(x, whole.rates[x]) for x in model.classes}
            except ValueError:
                model = whole
            parts.append(Features("finer", finer=model).apply(folded.filter(F.col("fold") == k)))
        return Features("finer", finer=whole), _union(parts)
    folded = save(train.select("id", "x", "y", poly31(F.col("key").cast("string"), FOLDS).alias("fold")), "features-train")
    reference = folded.select(F.col("id").alias("rid"), F.col("x").alias("embedding"), "y", "fold")
    near = knn_feature(folded.select("id", F.col("x").alias("embedding"), "fold"), reference, KNN_K, out_of_fold=True).withColumnRenamed("feature", "near")
    if kind == "knn":
        return Features("knn", reference), near.select("id", F.array("near").alias("f"))
    if kind != "stack":
        raise ValueError(f"unknown head type {kind}")
    parts = []
    for k in range(FOLDS):
        rest, own = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
        w, b, _ = fit_linear(rest, width, c=c)
        part = Features("stack", reference.filter(F.col("fold") != k), (w, b), fit_pca(rest, width)).apply(own)
        parts.append(part)
    w, b, _ = fit_linear(folded, width, c=c)
    return Features("stack", reference, (w, b), fit_pca(folded, width)), _union(parts)


def score_featured(rows: DataFrame, head: Head, model: Features) -> DataFrame:
    """(id, p_<head>) of rows (id, x) for a head of any type."""
    raw = dot(F.col("f"), literal(head.weights)) + F.lit(head.bias)
    return model.apply(rows).select("id", calibrate(raw, head.calibration).alias(f"p_{head.name}"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_width(kind: str, width: int) -> int:
    return {"linear": width, "knn": 1, "stack": 3, "finer": width + 1}[kind]
