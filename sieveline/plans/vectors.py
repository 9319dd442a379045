"""Queries over vectors: scoring, decisions, thresholds, evaluation, tiers, training."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, vectors
from ..functions.folds import split_of
from ..operators import artifact, evaluation, scoring, thresholds, tiers, training
from ..operators.scoring import Head, Policy
from ..sources.shared import save, table
from .registry import query, stats_sql

#: Heads of the test vectors: name and the class they fire on.
CLASSES = {"urgent": 0, "refund": 1, "spam": 2}
SLOPE, OFFSET = 8.0, -2.0
POLICY = Policy(("urgent", "spam", "refund"), ((("spam",), ("refund",)),))
LEVELS = {"urgent": (0.8, 0.5), "refund": (0.8, 0.5), "spam": (0.7, 0.4)}


def heads(spark: SparkSession, d: str) -> list[Head]:
    """A head per class: the difference of the class means (width x heads numbers reach the driver)."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    diff = [(F.avg(F.when(F.col("label") == k, v)) - F.avg(F.when(F.col("label") != k, v))).alias(n) for n, k in CLASSES.items()]
    rows = e.groupBy("i").agg(*diff).orderBy("i").collect()
    return [Head(n, tuple(float(r[n]) for r in rows), 0.0, ("platt", SLOPE, OFFSET), *LEVELS[n]) for n in CLASSES]


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(table(spark, d, "embeddings"), heads(spark, d)).withColumn("split", split_of(F.col("vec_id"))).withColumn("grp", F.floor(F.col("vec_id") / 3).cast("bigint"))


SCORES = """
WITH u AS (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings),
hd(h, k) AS (VALUES ('urgent', 0), ('refund', 1), ('spam', 2)),
df AS (SELECT h, i, avg(CASE WHEN label = k THEN embedding[i]::DOUBLE END) - avg(CASE WHEN label <> k THEN embedding[i]::DOUBLE END) AS d FROM u, hd GROUP BY h, i),
w AS (SELECT h, list(d ORDER BY i) AS w FROM df GROUP BY h),
lg AS (SELECT vec_id, label, h, 1 / (1 + exp(-(8.0 * list_dot_product(embedding::DOUBLE[], w) + -2.0))) AS p FROM embeddings, w),
b AS (SELECT vec_id, ('0x' || substr(md5('split:' || vec_id), 1, 8))::BIGINT % 100 AS b FROM embeddings),
s AS (SELECT vec_id, label, max(CASE WHEN h = 'urgent' THEN p END) AS p_urgent, max(CASE WHEN h = 'refund' THEN p END) AS p_refund, max(CASE WHEN h = 'spam' THEN p END) AS p_spam,
  any_value(CASE WHEN b < 50 THEN 'train' WHEN b < 75 THEN 'calibration' ELSE 'test' END) AS split, vec_id // 3 AS grp FROM lg JOIN b USING (vec_id) GROUP BY vec_id, label)
"""


@query(SCORES + "SELECT vec_id, round(p_urgent, 9) AS p_urgent, round(p_refund, 9) AS p_refund, round(p_spam, 9) AS p_spam FROM s")
def score_linear(spark, d):
    return scored(spark, d).select("vec_id", *(F.round(f"p_{n}", 9).alias(f"p_{n}") for n in CLASSES))


@query(SCORES + "SELECT vec_id, round(p_urgent, 9) AS urgent, round(p_refund, 9) AS refund, round(p_spam, 9) AS spam FROM s")
def score_many_heads(spark, d):
    m = scoring.score_many(table(spark, d, "embeddings"), heads(spark, d), "vec_id")
    return m.select("vec_id", *(F.round(F.col("scores")[n], 9).alias(n) for n in CLASSES))


@query("SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS null_vectors, count(*) FILTER (len(embedding) <> 64) AS wrong_width, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite FROM embedded")
def invalid_vectors(spark, d):
    return scoring.invalid_vectors(table(spark, d, "embedded"), 64)


DECIDED = SCORES + """, dec AS (SELECT vec_id, label, CASE WHEN p_urgent >= 0.8 THEN 'urgent' WHEN p_spam >= 0.7 THEN 'spam' WHEN p_refund >= 0.8 AND NOT p_spam >= 0.4 THEN 'refund' END AS head,
  p_urgent >= 0.5 OR p_spam >= 0.4 OR p_refund >= 0.5 AS near FROM s)
"""


@query(DECIDED + "SELECT head, CASE WHEN head IS NOT NULL THEN 'above_threshold' WHEN near THEN 'near_threshold' ELSE 'none' END AS reason, count(*) AS n FROM dec GROUP BY 1, 2")
def decide_policy(spark, d):
    rows = scored(spark, d).select(scoring.decide(heads(spark, d), POLICY).alias("x"))
    return rows.groupBy(F.col("x.head").alias("head"), F.col("x.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _rules(rows: DataFrame) -> DataFrame:
    """Rule results by class: class 3 fires spam, class 4 fires refund and dismisses spam, class 5 dismisses all, class 6 dismisses urgent."""
    k = F.col("label")
    fired = F.when(k == 3, F.array(F.lit("spam"))).when(k == 4, F.array(F.lit("refund"))).otherwise(F.array().cast("array<string>"))
    off = F.when(k == 4, F.array(F.lit("spam"), F.lit("urgent"))).when(k == 5, F.array(F.lit("urgent"), F.lit("spam"), F.lit("refund"))).when(k.isin(3, 6), F.array(F.lit("urgent"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("fired", fired).withColumn("dismissed", off)


@query("SELECT vec_id, label IN (3, 4, 5) AS settled, CASE label WHEN 3 THEN 'spam' WHEN 4 THEN 'refund' END AS head, CASE WHEN label IN (3, 4) THEN 'rule' WHEN label = 5 THEN 'none' END AS reason FROM embeddings")
def settle_rules(spark, d):
    rows = _rules(table(spark, d, "embeddings"))
    return rows.select("vec_id", scoring.settle(POLICY, F.col("fired"), F.col("dismissed")).alias("x")).select("vec_id", "x.settled", "x.head", "x.reason")


@query(DECIDED.replace("CASE WHEN p_urgent >= 0.8", "CASE WHEN label = 3 THEN 'spam' WHEN label = 4 THEN 'refund' WHEN label = 5 THEN NULL WHEN label <> 6 AND p_urgent >= 0.8").replace("p_urgent >= 0.5 OR p_spam >= 0.4 OR p_refund >= 0.5 AS near", "label <> 5 AND ((label <> 6 AND p_urgent >= 0.5) OR p_spam >= 0.4 OR p_refund >= 0.5) AS near") + "SELECT vec_id, head, CASE WHEN label IN (3, 4) THEN 'rule' WHEN head IS NOT NULL THEN 'above_threshold' WHEN near THEN 'near_threshold' ELSE 'none' END AS reason FROM dec")
def decide_with_rules(spark, d):
    rows = _rules(scored(spark, d))
    return rows.select("vec_id", scoring.decide(heads(spark, d), POLICY, F.col("fired"), F.col("dismissed")).alias("x")).select("vec_id", "x.head", "x.reason")


KNOTS = ([0.1, 0.3, 0.6, 0.9], [0.0, 0.2, 0.7, 1.0])


@query("SELECT event_id, round(CASE WHEN p <= 0.1 THEN 0.0 WHEN p < 0.3 THEN (p - 0.1) / (0.3 - 0.1) * (0.2 - 0.0) WHEN p < 0.6 THEN 0.2 + (p - 0.3) / (0.6 - 0.3) * (0.7 - 0.2) WHEN p < 0.9 THEN 0.7 + (p - 0.6) / (0.9 - 0.6) * (1.0 - 0.7) ELSE 1.0 END, 9) AS p FROM (SELECT event_id, 1 / (1 + exp(-(value / 50 - 2))) AS p FROM events)")
def calibrate_isotonic(spark, d):
    z = F.col("value") / 50 - 2
    return table(spark, d, "events").select("event_id", F.round(scoring.calibrate(z, ("isotonic", *KNOTS)), 9).alias("p"))


POS, NEG = "label = 0", "label <> 0"


def _p(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", F.col("p_urgent")).withColumn("y", (F.col("label") == 0).cast("int"))


def _one(spark: SparkSession, value, name: str = "threshold") -> DataFrame:
    return spark.createDataFrame([(None if value is None else round(float(value), 9),)], f"{name} double")


@query(SCORES + "SELECT round(p_urgent, 9) AS threshold FROM (SELECT p_urgent, row_number() OVER (ORDER BY p_urgent DESC) AS r, count(*) OVER () AS n FROM s WHERE label = 0) WHERE r = greatest(1, ceil(0.9 * n - 1e-12))")
def pick_threshold(spark, d):
    p = _p(scored(spark, d))
    return _one(spark, thresholds.pick_threshold(p.filter(POS), p.filter(NEG), 0.9))


@query(SCORES + "SELECT round(p_urgent, 9) AS threshold FROM (SELECT p_urgent, row_number() OVER (ORDER BY p_urgent DESC) AS r, count(*) OVER () AS n FROM s WHERE label <> 0) WHERE r = floor(0.02 * n) + 1")
def false_alarm_cap(spark, d):
    return _one(spark, thresholds.false_alarm_cap(_p(scored(spark, d)).filter(NEG), 0.02))


@query(SCORES + "SELECT round(greatest(0.5, p_urgent), 9) AS threshold FROM (SELECT p_urgent, row_number() OVER (ORDER BY p_urgent DESC) AS r, count(*) OVER () AS n FROM s WHERE split = 'train') WHERE r = floor(0.01 * n) + 1")
def budget_threshold(spark, d):
    return _one(spark, thresholds.budget_threshold(0.5, _p(scored(spark, d)).filter("split = 'train'"), 0.01))


@query(SCORES + ", c AS (SELECT p_urgent AS p, sum(1 + vec_id % 3) OVER (ORDER BY p_urgent DESC) / sum(1.0 + vec_id % 3) OVER () AS share FROM s WHERE label = 0) SELECT round(max(p), 9) AS threshold FROM c WHERE share >= 0.9 - 1e-12")
def pick_threshold_weighted(spark, d):
    p = _p(scored(spark, d)).withColumn("w", 1.0 + F.col("vec_id") % 3)
    return _one(spark, thresholds.pick_threshold(p.filter(POS), p.filter(NEG), 0.9, weight="w"))


@query(SCORES + "SELECT grp, round(min(p_urgent), 9) AS p FROM s WHERE label = 0 GROUP BY grp")
def group_scores(spark, d):
    return thresholds.group_scores(_p(scored(spark, d)).filter(POS), "grp").withColumn("p", F.round("p", 9))


@query(SCORES + ", g AS (SELECT min(p_urgent) AS p FROM s WHERE label = 0 GROUP BY grp), r AS (SELECT p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM g) SELECT round(p, 9) AS threshold FROM r WHERE r = floor(0.2 * (n + 1) + 1e-12)")
def conformal_expected(spark, d):
    pos = thresholds.group_scores(_p(scored(spark, d)).filter(POS), "grp")
    return _one(spark, thresholds.conformal_limit(pos, 0.2, None, True)[0])


@query(SCORES + f", g AS (SELECT min(p_urgent) AS p FROM s WHERE label = 0 GROUP BY grp), r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS r, count(*) OVER () AS n FROM g) SELECT round(max(p), 9) AS threshold FROM r WHERE {stats_sql('r', 'n', '0.2')} <= 0.05")
def conformal_pac(spark, d):
    pos = thresholds.group_scores(_p(scored(spark, d)).filter(POS), "grp")
    return _one(spark, thresholds.conformal_limit(pos, 0.2, 0.05, True)[0])


SELECTION = SCORES + f""", gp AS (SELECT min(p_urgent) AS p FROM s WHERE label = 0 GROUP BY grp), gn AS (SELECT max(p_urgent) AS p FROM s WHERE label <> 0 GROUP BY grp),
rp AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM gp), rn AS (SELECT p, row_number() OVER (ORDER BY p DESC) - 1 AS i, count(*) OVER () AS n FROM gn),
l AS (SELECT 'pac' AS kind, (SELECT max(p) FROM rp WHERE {stats_sql('i', 'n', '0.2')} <= 0.025) AS most, (SELECT min(p) FROM rn WHERE {stats_sql('i', 'n', '0.3')} <= 0.025) AS least
UNION ALL SELECT 'expected', (SELECT max(p) FROM rp WHERE i = floor(0.2 * (n + 1) + 1e-12) - 1), (SELECT max(p) FROM rn WHERE i = floor(0.3 * (n + 1) + 1e-12) - 1)),
c AS (SELECT kind, most, least, CASE WHEN most IS NULL OR least IS NULL THEN 'few' WHEN least >= most THEN 'conflict' ELSE 'ok' END AS state FROM l),
one AS (SELECT 'conformal-' || kind AS mode, CASE state WHEN 'ok' THEN kind ELSE 'none' END AS kind, CASE state WHEN 'ok' THEN most WHEN 'conflict' THEN least ELSE (SELECT coalesce(min(p), 0) FROM gp) END AS t, (state <> 'ok')::INT AS failures, 0 AS warnings, state FROM c),
auto AS (SELECT 'auto' AS mode, o.kind, o.t, o.failures, (o.mode = 'conformal-expected' AND o.state = 'ok')::INT AS warnings FROM one o WHERE o.mode = CASE WHEN (SELECT state FROM one WHERE mode = 'conformal-pac') = 'few' THEN 'conformal-expected' ELSE 'conformal-pac' END)
SELECT mode, kind, round(t, 9) AS threshold, failures, warnings, (SELECT count(*) FROM gp) AS positive_groups FROM (SELECT mode, kind, t, failures, warnings FROM one UNION ALL SELECT * FROM auto)"""


@query(SELECTION)
def conformal_selection(spark, d):
    """Guarantee and threshold in every mode."""
    p = save(_p(scored(spark, d)).select("grp", "p", "label"), "scores")
    pos, neg = thresholds.group_scores(p.filter(POS), "grp"), thresholds.group_scores(p.filter(NEG), "grp", positive=False)
    out = []
    for mode in ("auto", "conformal-pac", "conformal-expected"):
        s = thresholds.conformal_threshold(mode, 0.8, pos, [("false_alarm", neg, 0.3)])
        out.append((mode, s.kind, round(s.threshold, 9), len(s.failures), len(s.warnings), s.sufficiency["positive_groups"]))
    return spark.createDataFrame(out, "mode string, kind string, threshold double, failures int, warnings int, positive_groups long")


CONFUSION = "count(*) FILTER (label = 0) AS positives, count(*) FILTER (label <> 0) AS negatives, count(*) FILTER (p_urgent >= 0.6) AS fired, count(*) FILTER (p_urgent >= 0.6 AND label = 0) AS caught, count(*) FILTER (p_urgent >= 0.6 AND label <> 0) AS false_alarms"


@query(SCORES + f"SELECT split, {CONFUSION} FROM s GROUP BY split")
def confusion(spark, d):
    return evaluation.confusion(_p(scored(spark, d)), 0.6, by=["split"])


@query(SCORES + """, c AS (SELECT count(*) FILTER (label = 0) AS n, count(*) FILTER (p_urgent >= 0.6 AND label = 0) AS k FROM s), q AS (SELECT n, k, k / n AS p, 1.959963984540054 AS z FROM c)
SELECT n AS positives, k AS caught, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS lower, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS upper FROM q""")
def recall_wilson(spark, d):
    c = evaluation.confusion(_p(scored(spark, d)), 0.6).first()
    lo, hi = stats.wilson(c.caught, c.positives)
    return spark.createDataFrame([(c.positives, c.caught, round(lo, 9), round(hi, 9))], "positives long, caught long, lower double, upper double")


@query(SCORES + ", l AS (SELECT p_urgent AS p, unnest(['split=' || split, 'parity=' || vec_id % 2]) AS slice FROM s WHERE label = 0) SELECT slice, count(*) AS positives, count(*) FILTER (p >= 0.6) AS caught, count(*) FILTER (p >= 0.6) / count(*) AS recall FROM l GROUP BY slice")
def slice_recall(spark, d):
    return evaluation.slices(_p(scored(spark, d)).withColumn("parity", F.col("vec_id") % 2), 0.6, ["split", "parity"])


@query(SCORES + ", r AS (SELECT label = 0 AS y, p_urgent >= 0.6 AS f, vec_id % 2 = 0 AS b FROM s) SELECT count(*) FILTER (y AND f AND b) AS \"both\", count(*) FILTER (y AND f AND NOT b) AS classifier_only, count(*) FILTER (y AND NOT f AND b) AS baseline_only, count(*) FILTER (y AND NOT f AND NOT b) AS neither FROM r")
def baseline_2x2(spark, d):
    return evaluation.confusion(_p(scored(spark, d)).withColumn("b", F.col("vec_id") % 2 == 0), 0.6, baseline="b").select("both", "classifier_only", "baseline_only", "neither")


@query(SCORES + "SELECT least(9, floor(p_urgent * 10))::INT AS bin, count(*) AS n, round(avg(p_urgent), 9) AS mean_predicted, round(avg((label = 0)::INT), 9) AS observed_rate FROM s GROUP BY 1")
def reliability(spark, d):
    r = evaluation.reliability(_p(scored(spark, d)))
    return r.select("bin", "n", F.round("mean_predicted", 9).alias("mean_predicted"), F.round("observed_rate", 9).alias("observed_rate"))


@query(SCORES + ", g AS (SELECT grp, label = 0 AS y, bool_and(p_urgent >= 0.6) AS a, bool_or(p_urgent >= 0.6) AS o FROM s GROUP BY ALL) SELECT count(*) FILTER (y) AS positive_groups, count(*) FILTER (y AND a) AS caught_all, count(*) FILTER (y AND o) AS caught_any, count(*) FILTER (NOT y) AS negative_groups, count(*) FILTER (NOT y AND o) AS fired_any FROM g")
def group_outcomes(spark, d):
    return evaluation.group_outcomes(_p(scored(spark, d)), 0.6, "grp")


CERTIFIED = SCORES.replace("WITH u AS", "WITH RECURSIVE u AS") + f""", g AS (SELECT grp, label = 0 AS y, bool_and(p_urgent >= 0.6) AS a, bool_or(p_urgent >= 0.6) AS o FROM s GROUP BY ALL),
c AS (SELECT count(*) FILTER (y) AS n, count(*) FILTER (y AND a) AS k, count(*) FILTER (y AND o) AS ko, count(*) FILTER (NOT y) AS m, count(*) FILTER (NOT y AND o) AS f FROM g),
halving AS (SELECT *, 0 AS i, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS u0, 1.0::DOUBLE AS u1, 0.0::DOUBLE AS f0, 1.0::DOUBLE AS f1 FROM c
UNION ALL SELECT n, k, ko, m, f, i + 1, CASE WHEN low < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN low < 0.025 THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN up > 0.025 THEN (u0 + u1) / 2 ELSE u0 END, CASE WHEN up > 0.025 THEN u1 ELSE (u0 + u1) / 2 END, CASE WHEN fa > 0.025 THEN (f0 + f1) / 2 ELSE f0 END, CASE WHEN fa > 0.025 THEN f1 ELSE (f0 + f1) / 2 END
FROM (SELECT *, 1 - {stats_sql("k - 1", "n", "(l0 + l1) / 2")} AS low, {stats_sql("ko", "n", "(u0 + u1) / 2")} AS up, {stats_sql("f", "m", "(f0 + f1) / 2")} AS fa FROM halving WHERE i < 60)),
r AS (SELECT CASE WHEN k = 0 THEN 0 ELSE l0 END AS lo, CASE WHEN ko = n THEN 1 ELSE u0 END AS up, CASE WHEN f = m THEN 1 ELSE f0 END AS fa, (SELECT avg((label = 0)::INT) FROM s) AS pi FROM halving WHERE i = 60)
SELECT round(lo, 8) AS recall_lower, round(up, 8) AS recall_upper, round(fa, 8) AS false_alarm_upper, round(pi * lo / (pi * lo + (1 - pi) * fa), 8) AS precision_lower FROM r"""


@query(CERTIFIED)
def certified_bounds(spark, d):
    """Exact one-sided bounds by group."""
    e = evaluation.evaluate_head(_p(scored(spark, d)), 0.6, group="grp")
    return spark.createDataFrame([tuple(round(float(e["certified"][k]), 8) for k in ("recall_lower", "recall_upper", "false_alarm_upper", "precision_lower"))], "recall_lower double, recall_upper double, false_alarm_upper double, precision_lower double")


KNN = """
WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 3 AS fold FROM embeddings),
r AS (SELECT vec_id AS rid, embedding::DOUBLE[] AS v, (label = 0)::INT AS y, vec_id % 3 AS fold FROM embeddings),
c AS (SELECT id, rid, y, list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))) AS c FROM q JOIN r ON id <> rid %s),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, y ORDER BY c DESC, rid) <= 10)
SELECT id, round(coalesce(avg(c) FILTER (y = 1), 0) - coalesce(avg(c) FILTER (y = 0), 0), 9) AS feature FROM t GROUP BY id
"""


def _knn(spark: SparkSession, d: str, oof: bool) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("fold", F.col("vec_id") % 3)
    ref = e.select(F.col("vec_id").alias("rid"), "embedding", (F.col("label") == 0).cast("int").alias("y"), "fold")
    return training.knn_feature(e.select(F.col("vec_id").alias("id"), "embedding", "fold"), ref, out_of_fold=oof).withColumn("feature", F.round("feature", 9))


@query(KNN.replace("%s", ""))
def knn_feature(spark, d):
    return _knn(spark, d, False)


@query(KNN.replace("%s", "AND q.fold <> r.fold"))
def knn_out_of_fold(spark, d):
    return _knn(spark, d, True)


@query("WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS t FROM embeddings), s AS (SELECT vec_id, v, CASE WHEN t > 0 THEN t / 127 ELSE 1.0 END AS scale FROM m) SELECT vec_id, round(scale, 12) AS scale, list_transform(v, lambda x: greatest(-127, least(127, floor(x / scale + 0.5)::INT))) AS q FROM s")
def encode_int8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vectors.int8(F.col("embedding")).alias("e")).select("vec_id", F.round("e.scale", 12).alias("scale"), "e.q")


COST = SCORES + ", g AS (SELECT p_urgent AS p, count(*) FILTER (label = 0) AS a, count(*) FILTER (label <> 0) AS n FROM s GROUP BY 1), c AS (SELECT sum(a) OVER w AS tp, sum(n) OVER w AS fp, sum(a) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY p DESC)) "


@query(COST + "SELECT round(min(fp / neg), 9) AS cost FROM c WHERE tp / pos >= 0.9")
def cascade_cost(spark, d):
    return _one(spark, tiers.cascade_cost(_p(scored(spark, d)), 0.9, "p"), "cost")


@query(COST + "SELECT round(min(fp / neg), 9) AS recall_cost, round(1 - (SELECT max(tp / pos) FROM c WHERE tp >= 0.5 * (tp + fp) - 1e-12), 9) AS precision_cost FROM c WHERE tp >= 0.9 * pos - 1e-12")
def guarantee_cost(spark, d):
    p = _p(scored(spark, d))
    a, b = training.guarantee_cost(p, 0.9, "recall", "p"), training.guarantee_cost(p, 0.5, "precision", "p")
    return spark.createDataFrame([(round(a, 9), round(b, 9))], "recall_cost double, precision_cost double")


EDGE = SCORES + """, n AS (SELECT p_urgent AS f FROM (SELECT p_urgent, row_number() OVER (ORDER BY p_urgent DESC) AS r, count(*) OVER () AS n FROM s WHERE label <> 0) WHERE r = floor(0.01 * n) + 1),
m AS (SELECT p_urgent AS x FROM (SELECT p_urgent, row_number() OVER (ORDER BY p_urgent) AS r, count(*) OVER () AS n FROM s WHERE label = 0) WHERE r = floor(0.1 * n) + 1),
t AS (SELECT vec_id, label, p_refund, CASE WHEN p_urgent > f THEN 'fire' WHEN p_urgent < x THEN 'dismiss' END AS decision FROM s, n, m)
"""


def _edge(spark: SparkSession, d: str) -> DataFrame:
    p = save(_p(scored(spark, d)), "edge")
    fire, dismiss = tiers.fire_at(p, 0.01, "p"), tiers.dismiss_at(p, 0.1, "p")
    return p.withColumn("decision", tiers.tier_decision(F.col("p"), fire, dismiss))


@query(EDGE + "SELECT decision, count(*) AS n, count(*) FILTER (label = 0) AS positives FROM t GROUP BY decision")
def edge_decide(spark, d):
    return _edge(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("positives"))


@query(EDGE + "SELECT vec_id, round(CASE decision WHEN 'fire' THEN 1e9 WHEN 'dismiss' THEN -1e9 ELSE p_refund END, 9) AS pinned FROM t")
def middle_pinned(spark, d):
    return _edge(spark, d).select("vec_id", F.round(tiers.pin(F.col("decision"), F.col("p_refund")), 9).alias("pinned"))


def _kth(table: str, column: str, y: int, share: float, spent: str, order: str) -> str:
    """SQL: the row of a class that a budget, less what is spent, leaves outside."""
    return f"(SELECT x FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column} {order}) AS i FROM {table} WHERE y = {y}) WHERE i = floor({share}::DOUBLE * (SELECT count(*) FROM r WHERE y = {y})) + 1 - {spent})"


def _cost(settled: str) -> str:
    """SQL: false alarms at a recall of 0.9, settled rows first or last."""
    return f"(SELECT min(fp / neg) FROM (SELECT sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pos, sum(b) OVER () AS neg FROM (SELECT CASE {settled} WHEN 'fire' THEN 1e9 WHEN 'dismiss' THEN -1e9 ELSE h END AS v, sum(y) AS a, sum(1 - y) AS b FROM t GROUP BY 1) WINDOW w AS (ORDER BY v DESC)) WHERE tp / pos >= 0.9::DOUBLE)"


CASCADE = SCORES + f""", r AS (SELECT (label = 0)::INT AS y, p_refund AS e, (p_urgent + p_refund) / 2 AS m, p_urgent AS h FROM s),
ce AS (SELECT {_kth("r", "e", 0, 0.005, "0", "DESC")} AS f, CASE WHEN 0.02::DOUBLE * (SELECT count(*) FROM r WHERE y = 1) >= 1 THEN {_kth("r", "e", 1, 0.02, "0", "ASC")} END AS d),
a AS (SELECT r.*, CASE WHEN e > f THEN 'fire' WHEN e < d THEN 'dismiss' END AS one FROM r, ce),
o AS (SELECT * FROM a WHERE one IS NULL),
cm AS (SELECT {_kth("o", "m", 0, 0.01, "(SELECT count(*) FROM a WHERE one = 'fire' AND y = 0)", "DESC")} AS f, CASE WHEN 0.07::DOUBLE * (SELECT count(*) FROM r WHERE y = 1) >= 1 THEN {_kth("o", "m", 1, 0.07, "(SELECT count(*) FROM a WHERE one = 'dismiss' AND y = 1)", "ASC")} END AS d),
t AS (SELECT a.*, coalesce(one, CASE WHEN m > f THEN 'fire' WHEN m < d THEN 'dismiss' END) AS two FROM a, cm)
SELECT three <= 1.1 * two + 0.001 AS cascade, round(two, 9) AS two_tier, round(three, 9) AS three_tier FROM (SELECT {_cost("one")} AS two, {_cost("two")} AS three)"""


@query(CASCADE)
def choose_cascade(spark, d):
    """The choice between two and three tiers on the training split."""
    rows = save(_p(scored(spark, d)).select("y", F.col("p_refund").alias("edge"), ((F.col("p_urgent") + F.col("p_refund")) / 2).alias("middle"), F.col("p_urgent").alias("head")), "cascade")
    c = tiers.choose_cascade(rows, {"edge_fire": 0.005, "edge_dismiss": 0.02, "middle_fire": 0.01, "middle_dismiss": 0.07}, 0.9)
    return spark.createDataFrame([(c["cascade"], round(c["two_tier"], 9), round(c["three_tier"], 9))], "cascade boolean, two_tier double, three_tier double")


def _certain(y: int, alpha: float, order: str) -> str:
    """SQL: the row next to as many of a class as may lie beyond a threshold with confidence 0.95, frame without end."""
    n = f"(SELECT count(*) FROM x WHERE y = {y})"
    most = f"(SELECT max(c) FROM (SELECT unnest(range(0, {n} + 1)) AS c, {n}::DOUBLE AS n) WHERE {stats_sql('c', 'n', str(alpha))} <= 0.05 AND c / n + 1.6448536269514722 * sqrt(c / n * (1 - c / n) / (n - 1)) <= {alpha}::DOUBLE)"
    return f"(SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s {order}) AS i FROM x WHERE y = {y}) WHERE i = {most} + 1)"


CERTIFICATES = SCORES + f""", x AS (SELECT p_urgent AS s, (label = 0)::INT AS y FROM s WHERE split <> 'test'), t AS (SELECT {_certain(0, 0.05, "DESC")} AS f, {_certain(1, 0.2, "ASC")} AS d)
SELECT round(f, 9) AS fire, round(CASE WHEN d IS NULL OR f IS NULL THEN d ELSE least(d, f) END, 9) AS dismiss FROM t"""


@query(CERTIFICATES)
def tier_certificates(spark, d):
    """Fire and dismissal thresholds that hold with confidence."""
    p = _p(scored(spark, d)).filter("split <> 'test'")
    fire, dismiss = tiers.certify(p.select(F.col("p").alias("s"), "y"), 0.05, 0.2, 0.05)
    return spark.createDataFrame([tuple(None if t is None else round(t, 9) for t in (fire, dismiss))], "fire double, dismiss double")


def _training_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("split", split_of(F.col("vec_id")))
    ys = [(F.col("label") == k).cast("int").alias(f"y_{n}") for n, k in CLASSES.items()]
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "split", F.floor(F.col("vec_id") / 3).alias("group"), *ys)


POLICIES = {"urgent": {"kind": "recall", "target_recall": 0.8, "mode": "auto", "design_recall": 0.9, "allow_heuristic": True}, "refund": {"kind": "precision", "target_precision": 0.8}}


@query()
def train_heads(spark, d):
    """Fit, calibrate, choose thresholds, evaluate and gate; iterative."""
    r = training.train_heads(_training_rows(spark, d), POLICIES, 64)
    rows = [(n, x["spec"].threshold, x["guarantee"]["kind"], float(x["evaluation"]["recall"]), float(x["evaluation"]["false_alarm"]), len(x["failures"]), len(x["warnings"])) for n, x in r.items()]
    return spark.createDataFrame(rows, "head string, threshold double, guarantee string, recall double, false_alarm double, failures int, warnings int")


@query(SCORES + "SELECT vec_id, round(p_urgent, 9) AS urgent, round(p_refund, 9) AS refund, true AS same FROM s")
def artifact_round_trip(spark, d):
    """Scores by the heads as written to JSON and read again, and whether they are the same numbers as before."""
    before = heads(spark, d)
    back = [artifact.head_of(h.name, json.loads(json.dumps(artifact.head_json(h)))) for h in before]
    both = scoring.score(scoring.score(table(spark, d, "embeddings"), before).withColumnsRenamed({f"p_{n}": f"was_{n}" for n in CLASSES}), back)
    return both.select("vec_id", F.round("p_urgent", 9).alias("urgent"), F.round("p_refund", 9).alias("refund"), F.forall(F.array(*(F.col(f"p_{n}") == F.col(f"was_{n}") for n in CLASSES)), lambda x: x).alias("same"))


@query()
def train_types(spark, d):
    """A head of each further type; iterative."""
    e = _training_rows(spark, d).withColumn("finer", (F.col("id") % 5).cast("string"))
    rows = []
    for kind in ("knn", "stack", "finer"):
        r = training.train_heads(e, {"urgent": POLICIES["urgent"] | {"type": kind}}, 64)["urgent"]
        rows.append((kind, r["spec"].threshold, r["guarantee"]["kind"], float(r["evaluation"]["recall"]), float(r["evaluation"]["false_alarm"]), len(r["spec"].weights)))
    return spark.createDataFrame(rows, "type string, threshold double, guarantee string, recall double, false_alarm double, weights int")


@query()
def report_markdown(spark, d):
    """The report page, line by line."""
    text = evaluation.report_markdown(training.train_heads(_training_rows(spark, d), POLICIES, 64))
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line int, text string")


@query()
def cross_validated_scores(spark, d):
    """Out-of-fold raw scores of the linear head."""
    rows = _training_rows(spark, d).withColumn("y", F.col("y_urgent"))
    return training.cross_validated(rows, 64).select("id", "y", "s")


@query("SELECT label AS finer, round((sum(y) + any_value(base)) / (count(*) + 1), 9) AS rate FROM (SELECT label, (vec_id % 4 = 0)::INT AS y, avg((vec_id % 4 = 0)::INT) OVER () AS base FROM embeddings) GROUP BY label")
def finer_route_rates(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("finer"), (F.col("vec_id") % 4 == 0).cast("int").alias("y"))
    return training.route_rates(e).withColumn("rate", F.round("rate", 9))
