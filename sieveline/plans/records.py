"""Queries over records, frames, documents and events: provenance, sampling, labelling, coverage, retrieval, documents, drift."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds, stats, vectors
from ..functions.text import truncate_text
from ..operators import artifact, design, document_heads, documents, evaluation, records, retrieval, scoring, tiers
from ..sources.shared import save, table
from ..streaming import monitor
from .registry import query, stats_sql

HEAD = "refund"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Example records, repeated rows once."""
    return table(spark, d, "example_records").dropDuplicates(["id"])


R = "WITH r AS (SELECT DISTINCT ON (id) * FROM example_records)"


# --- keys, text, vectors --------------------------------------------------------------------------------

POLY = "list_reduce(list_prepend({seed}::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda a, b: {step})"
POLY31 = POLY.format(seed=7, step="(a * 31 + b) & 4294967295")
FNV = POLY.format(seed=2166136261, step="(xor(a, b) * 16777619) & 4294967295")


@query(f"SELECT k, ({POLY31} % 3)::INT AS poly3, ({FNV} % 3)::INT AS fnv3, ({FNV} % 5)::INT AS fnv5 FROM (SELECT 'doc-' || doc_id AS k FROM documents)")
def fold_assign(spark, d):
    k = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("k"))
    return k.select("k", folds.poly31(F.col("k")).alias("poly3"), folds.fnv_fold(F.col("k"), 3).alias("fnv3"), folds.fnv_fold(F.col("k"), 5).alias("fnv5"))


HASHED = """
WITH t AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS b, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM t),
g AS (SELECT id, b, sum(s) AS v FROM h GROUP BY id, b), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM g GROUP BY id)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN list(round(coalesce(g.v / nullif(n.n, 0), 0), 9) ORDER BY i) END AS embedding
FROM documents d CROSS JOIN range(64) AS x(i) LEFT JOIN n ON n.id = d.doc_id LEFT JOIN g ON g.id = d.doc_id AND g.b = i GROUP BY d.doc_id
"""


@query(HASHED)
def hash_embedding(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.transform(vectors.hash_embedding(F.col("text"), 64), lambda x: F.round(x, 9)).alias("embedding"))


@query("SELECT doc_id, left(text, 80) AS short FROM documents")
def truncate_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate_text(F.col("text"), 80).alias("short"))


@query("WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0)")
def missing_texts(spark, d):
    """Cache keys to embed when the texts of even documents are cached."""
    k = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    return k.select("key").distinct().join(k.filter("doc_id % 2 = 0").select("key"), "key", "left_anti")


# --- provenance -----------------------------------------------------------------------------------------

VIOLATIONS = R + """, v AS (
SELECT 'P1' AS code, id FROM r WHERE role IN ('calibration', 'test') AND NOT coalesce(source.kind = 'sampled' AND labelled_by = 'human' AND source.inclusion_prob > 0 AND source.inclusion_prob <= 1, false)
UNION ALL SELECT 'P2', id FROM r WHERE role = 'background' AND NOT coalesce(source.kind = 'traffic' AND (labels IS NULL OR len(list_filter(map_values(labels), lambda x: x IS NOT NULL)) = 0) AND background_use IS NOT NULL, false)
UNION ALL SELECT 'P3', id FROM r WHERE group_id IN (SELECT group_id FROM r WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT role) > 1 OR count(DISTINCT CASE WHEN role = 'background' THEN coalesce(background_use, '') END) > 1)
UNION ALL SELECT 'P4', id FROM r WHERE source.kind IN ('retrieved', 'generated') AND NOT coalesce(role IN ('train', 'stress'), false)
UNION ALL SELECT 'P7', id FROM r WHERE source.kind = 'generated' AND NOT coalesce(verified OR (source.batch_id IN ('b00-000') AND labels['urgent'] IS NULL), false))
"""


@query(VIOLATIONS + "SELECT code, id FROM v")
def provenance_violations(spark, d):
    return records.violations(_records(spark, d), accepted_batches=["b00-000"], safety_critical=["urgent"])


@query(VIOLATIONS + "SELECT code, count(*) AS n FROM v GROUP BY code")
def provenance_counts(spark, d):
    return records.violations(_records(spark, d), accepted_batches=["b00-000"], safety_critical=["urgent"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


VALID = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    ok = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return table(spark, d, "embedded").filter(ok).select(F.col("record_id").alias("id"), "used_as", "option_no", "embedding").dropDuplicates(["id"])


@query(R + f", e AS (SELECT DISTINCT record_id AS id, embedding::DOUBLE[] AS v FROM embedded WHERE {VALID}), m AS (SELECT id, v FROM r JOIN e USING (id) WHERE role = 'train' AND source.kind IN ('retrieved', 'generated')), h AS (SELECT id, v FROM r JOIN e USING (id) WHERE role IN ('calibration', 'test')) SELECT DISTINCT m.id FROM m JOIN h ON list_cosine_similarity(m.v, h.v) >= 0.95")
def provenance_p5(spark, d):
    return retrieval.drop_near_evaluation(_records(spark, d), _vectors(spark, d))


P6 = R + """, t AS (SELECT *, coalesce(weight, 1.0) AS w0, labels['refund'] AS y, coalesce(source.kind = 'retrieved' AND labels['refund'] = 1, false) AS rp, coalesce(source.kind = 'generated' AND labels['refund'] = 0, false) AS gn FROM r WHERE role = 'train'),
s AS (SELECT coalesce(sum(w0) FILTER (rp), 0) AS rp, coalesce(sum(w0) FILTER (y = 1 AND NOT rp), 0) AS op, coalesce(sum(w0) FILTER (gn), 0) AS gn, coalesce(sum(w0) FILTER (y = 0 AND NOT gn), 0) AS n FROM t),
c AS (SELECT CASE WHEN rp > op * 0.5 / 0.5 THEN op * 0.5 / 0.5 / rp ELSE 1.0 END AS a, CASE WHEN gn > n * 0.3 / 0.7 THEN n * 0.3 / 0.7 / gn ELSE 1.0 END AS b FROM s)
"""


@query(P6 + "SELECT id, round(w0 * CASE WHEN rp THEN a WHEN gn THEN b ELSE 1.0 END, 9) AS weight FROM t, c")
def weight_caps(spark, d):
    w = records.capped_weights(_records(spark, d).filter("role = 'train'"), HEAD)
    return w.select("id", F.round("_weight", 9).alias("weight"))


@query(P6 + """, q AS (SELECT id, text, y, gn, source.rule_id AS rule, w0 * CASE WHEN rp THEN a WHEN gn THEN b ELSE 1.0 END AS w FROM t, c),
l AS (SELECT unnest(list_filter(['rule-0', 'rule-1', 'rule-2'], lambda x: contains(text, CASE x WHEN 'rule-0' THEN 'order' WHEN 'rule-1' THEN 'refund' ELSE 'bank' END))) AS rule, w FROM q WHERE y = 1),
m AS (SELECT rule, sum(w) AS lim FROM l GROUP BY rule), h AS (SELECT rule, sum(w) AS have FROM q WHERE gn GROUP BY rule)
SELECT q.id, round(q.w * CASE WHEN q.gn AND have > coalesce(lim, 0) THEN coalesce(lim, 0) / have ELSE 1.0 END, 9) AS weight FROM q LEFT JOIN h ON q.rule = h.rule LEFT JOIN m ON q.rule = m.rule""")
def weight_caps_by_rule(spark, d):
    rules = {"rule-0": "order", "rule-1": "refund", "rule-2": "bank"}
    fires = F.filter(F.array(*(F.when(F.col("text").contains(w), F.lit(r)) for r, w in rules.items())), lambda x: x.isNotNull())
    return records.capped_weights(_records(spark, d).filter("role = 'train'"), HEAD, rule_matches=fires).select("id", F.round("_weight", 9).alias("weight"))


@query(R + "SELECT id FROM r WHERE role = 'train' AND source.kind IN ('sampled', 'traffic', 'retrieved') AND labelled_by = 'human' AND labels['refund'] = 0 AND regexp_matches(text, 'order|bank')")
def real_hard_negatives(spark, d):
    return records.real_hard_negatives(_records(spark, d), HEAD, "order|bank").select("id")


GENERATED = R + ", g AS (SELECT id, source.batch_id AS batch_id, coalesce(labels['refund'], labels['complaint'], labels['access'], labels['urgent'], labels['cancel'], 0) AS intended FROM r WHERE source.kind = 'generated')"


def _generated(spark: SparkSession, d: str) -> DataFrame:
    intended = F.coalesce(*(F.col("labels")[h] for h in ("refund", "complaint", "access", "urgent", "cancel")), F.lit(0))
    return _records(spark, d).filter("source.kind = 'generated'").select("id", F.col("source.batch_id").alias("batch_id"), intended.alias("intended"))


@query(GENERATED + ", k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY md5('0:' || id), id) AS r, count(*) OVER (PARTITION BY batch_id) AS n FROM g) SELECT id, batch_id FROM k WHERE r <= greatest(ceil(n * 0.2 - 1e-9), 5)")
def select_for_review(spark, d):
    return records.select_for_review(_generated(spark, d), least=5).select("id", "batch_id")


REVIEWED = GENERATED + """, v AS (SELECT id, CASE WHEN md5(id) < '08' THEN 1 - intended ELSE intended END AS label FROM g WHERE md5('review:' || id) < 'c'),
s AS (SELECT batch_id, count(label) AS reviewed, count(*) FILTER (label = intended) AS agreed FROM g LEFT JOIN v USING (id) GROUP BY batch_id),
z AS (SELECT *, CASE WHEN reviewed > 0 THEN (agreed / reviewed + 3.841458820694124 / (2 * reviewed) - 1.959963984540054 * sqrt(agreed / reviewed * (1 - agreed / reviewed) / reviewed + 3.841458820694124 / (4.0 * reviewed * reviewed))) / (1 + 3.841458820694124 / reviewed) ELSE 0 END AS lower FROM s)
"""


def _verified(spark: SparkSession, d: str):
    g = _generated(spark, d)
    v = g.filter(F.md5(F.concat(F.lit("review:"), "id")) < "c").select("id", F.when(F.md5("id") < "08", 1 - F.col("intended")).otherwise(F.col("intended")).alias("label"))
    return records.verify_batches(g, v, 0.75)


@query(REVIEWED + "SELECT batch_id, reviewed, agreed, round(lower, 9) AS lower, reviewed > 0 AND lower >= 0.75 AS accepted FROM z")
def verify_batches(spark, d):
    return _verified(spark, d)[1].withColumn("lower", F.round("lower", 9))


@query(REVIEWED + "SELECT g.id, v.label IS NOT NULL AS verified, round(CASE WHEN v.label IS NULL THEN lower ELSE 1.0 END, 9) AS weight FROM g JOIN z USING (batch_id) LEFT JOIN v ON v.id = g.id WHERE reviewed > 0 AND lower >= 0.75 AND (v.label IS NULL OR v.label = g.intended)")
def verified_records(spark, d):
    return _verified(spark, d)[0].select("id", "verified", F.round("weight", 9).alias("weight"))


@query(R + ", x AS (SELECT unnest(source.seed_ids) AS seed_id, labels['refund'] AS y FROM r WHERE source.kind = 'retrieved' AND labels['refund'] IN (0, 1)) SELECT seed_id, count(*) AS labelled, sum(y) AS confirmed, sum(y) / count(*) AS hit_rate, count(*) >= 2 AND sum(y) / count(*) < 0.1 AS retire FROM x GROUP BY seed_id")
def seed_stats(spark, d):
    return records.seed_stats(_records(spark, d), HEAD, least_labelled=2)


# --- coverage -------------------------------------------------------------------------------------------

AXES = {"kind": ["sampled", "traffic", "retrieved", "imported"], "band": ["low", "high"]}


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).withColumn("kind", F.col("source.kind")).withColumn("band", F.when(F.length("text") < 400, "low").otherwise("high"))


TAGGED = R + ", t AS (SELECT *, source.kind AS kind, CASE WHEN len(text) < 400 THEN 'low' ELSE 'high' END AS band, labels['refund'] AS y FROM r WHERE source.kind IN ('sampled', 'traffic', 'retrieved') AND labelled_by = 'human' AND labels['refund'] IN (0, 1))"


@query(TAGGED + """, ax(axis, value) AS (VALUES ('kind', 'sampled'), ('kind', 'traffic'), ('kind', 'retrieved'), ('kind', 'imported'), ('band', 'low'), ('band', 'high')),
g AS (SELECT axis, value, role FROM ax, (SELECT DISTINCT role FROM t))
SELECT g.axis, g.value, g.role, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives, count(DISTINCT CASE WHEN y = 1 THEN group_id END) AS positive_groups
FROM g LEFT JOIN t ON t.role = g.role AND CASE g.axis WHEN 'kind' THEN t.kind ELSE t.band END = g.value GROUP BY ALL""")
def coverage_values(spark, d):
    return records.coverage_values(_tagged(spark, d), HEAD, AXES)


@query(TAGGED + ", k(v) AS (VALUES ('sampled'), ('traffic'), ('retrieved'), ('imported')), b(v) AS (VALUES ('low'), ('high')) SELECT 'kind=' || k.v AS a, 'band=' || b.v AS b, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM k CROSS JOIN b LEFT JOIN t ON t.kind = k.v AND t.band = b.v GROUP BY ALL HAVING positives < 10 OR negatives < 10")
def coverage_gaps(spark, d):
    return records.coverage_gaps(_tagged(spark, d), HEAD, AXES)


@query(TAGGED + ", c AS (SELECT band, sum(1 / source.inclusion_prob) AS s, sum(1 / source.inclusion_prob / source.inclusion_prob) AS q FROM t WHERE role = 'calibration' AND y = 1 GROUP BY band) SELECT v.b AS value, 59 AS needed, round(coalesce(s * s / q, 0), 9) AS available FROM (VALUES ('low'), ('high')) v(b) LEFT JOIN c ON c.band = v.b")
def coverage_slices(spark, d):
    rows = records.coverage_slices(_tagged(spark, d).filter("source.kind <> 'generated'"), HEAD, AXES, ["band"])
    return spark.createDataFrame([(r["value"], r["needed"], round(r["available"], 9)) for r in rows], "value string, needed int, available double")


# --- sampling and labelling -----------------------------------------------------------------------------


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of all designs: repeated rows once, slices in one spelling; items without design are in none."""
    f = table(spark, d, "frame_items").filter("design_id is not null").dropDuplicates(["design_id", "id"])
    return f.select("design_id", "id", F.col("group_id").alias("group"), F.col("signals.rule_fires").alias("rule_fires"), F.col("signals.score").alias("score"), F.lower(F.trim("signals.slice")).alias("slice"))


F_ = "WITH f AS (SELECT DISTINCT ON (design_id, id) design_id, id, group_id AS g, signals.rule_fires AS rule_fires, signals.score AS score, lower(trim(signals.slice)) AS slice FROM frame_items WHERE design_id IS NOT NULL), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY design_id, coalesce(g, 'item ' || id) ORDER BY md5('0:' || id), id) = 1)"


@query(F_ + "SELECT design_id, id FROM o")
def one_per_group(spark, d):
    return design.one_per_group(_frames(spark, d), by=["design_id"]).select("design_id", "id")


@query(F_ + ", c AS (SELECT design_id, quantile_disc(score, 0.95) AS a, quantile_disc(score, 0.8) AS b FROM o WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY design_id) SELECT design_id, rule_fires, CASE WHEN score >= a THEN 0 WHEN score >= b THEN 1 ELSE 2 END AS band, slice, count(*) AS n FROM o JOIN c USING (design_id) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL")
def score_bands(spark, d):
    o = design.one_per_group(_frames(spark, d), by=["design_id"]).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    o = design.with_bands(o, [0.05, 0.2])
    return o.groupBy("design_id", "rule_fires", F.col("_band").alias("band"), "slice").agg(F.count(F.lit(1)).alias("n"))


@query(F_ + "SELECT design_id, least(300, count(*)) AS drawn, count(*)::DOUBLE AS estimated FROM o GROUP BY design_id")
def design_totals(spark, d):
    """Per design the items drawn, and the frame's size as its calibration sample estimates it."""
    s, _ = design.design_samples(_frames(spark, d), 300, floor=10)
    weight = F.when(F.col("role") == "calibration", 1 / F.col("inclusion_prob"))
    return s.groupBy("design_id").agg(F.count(F.lit(1)).alias("drawn"), F.round(F.sum(weight), 6).alias("estimated"))


@query()
def design_sample(spark, d):
    """A stratified sample of every design with roles; merging and allocation are driver decisions."""
    s, _ = design.design_samples(_frames(spark, d), 300, floor=10)
    return s.select("design_id", "id", "stratum", "role", F.round("inclusion_prob", 9).alias("inclusion_prob"), "stratum_size")


@query()
def design_summary(spark, d):
    return design.design_samples(_frames(spark, d), 300, floor=10)[1]


SAMPLED = R + ", s AS (SELECT id, role, source.design_id AS design_id, source.stratum AS stratum, source.stratum_size AS stratum_size, labels FROM r WHERE source.kind = 'sampled')"


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter("source.kind = 'sampled'").select("id", "role", F.col("source.design_id").alias("design_id"), F.col("source.stratum").alias("stratum"), F.col("source.stratum_size").alias("stratum_size"), "labels")


@query(SAMPLED + "SELECT id, round(count(*) OVER (PARTITION BY design_id, stratum) / nullif(max(stratum_size) OVER (PARTITION BY design_id, stratum), 0), 9) AS inclusion_prob FROM s WHERE role = 'calibration'")
def design_of(spark, d):
    return design.design_of(_sampled(spark, d).filter("role = 'calibration'")).select("id", F.round("inclusion_prob", 9).alias("inclusion_prob"))


@query(SAMPLED + "SELECT design_id, stratum, count(*) AS n, min(stratum_size) AS least_size, max(stratum_size) AS most_size FROM s GROUP BY ALL HAVING min(stratum_size) <> max(stratum_size) OR count(*) > max(stratum_size) OR max(stratum_size) IS NULL")
def design_problems(spark, d):
    return design.design_problems(_sampled(spark, d))


@query(SAMPLED + ", w AS (SELECT role, max(stratum_size) OVER p / count(*) OVER p AS w FROM s WINDOW p AS (PARTITION BY role, design_id, stratum)) SELECT role, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n FROM w GROUP BY role")
def kish_effective(spark, d):
    per = _sampled(spark, d).groupBy("role", "design_id", "stratum").agg(F.count(F.lit(1)).alias("n"), F.max("stratum_size").alias("size"))
    w = F.col("size") / F.col("n")
    return per.groupBy("role").agg(F.round(F.sum(w * F.col("n")) * F.sum(w * F.col("n")) / F.sum(w * w * F.col("n")), 6).alias("effective_n"))


@query(SAMPLED + ", w AS (SELECT labels['refund'] AS y, design_id || stratum AS h, stratum_size FROM s WHERE role = 'test' AND labels['refund'] IN (0, 1)), x AS (SELECT y, max(stratum_size) OVER (PARTITION BY h) / count(*) OVER (PARTITION BY h) AS w FROM w) SELECT round(sum(w * y) / sum(w), 9) AS prevalence FROM x")
def ht_prevalence(spark, d):
    t = _sampled(spark, d).filter("role = 'test'").withColumn("y", F.col("labels")[HEAD]).filter("y in (0, 1)").withColumn("stratum", F.concat("design_id", "stratum")).withColumn("p", F.lit(1.0))
    e = evaluation.design_estimates(t, 0.5)
    return spark.createDataFrame([(round(e["prevalence"]["estimate"], 9),)], "prevalence double")


@query()
def design_intervals(spark, d):
    """Ratio estimates with standard errors and intervals; exact bounds are not SQL."""
    t = _sampled(spark, d).filter("role = 'test'").withColumn("y", F.col("labels")[HEAD]).filter("y in (0, 1)").withColumn("stratum", F.concat("design_id", "stratum")).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(100)) / 100)
    e = evaluation.design_estimates(t, 0.5)
    return spark.createDataFrame([(k, float(v["estimate"]), float(v["se"]), float(v["effective_n"]), float(v["ci95"][0]), float(v["ci95"][1])) for k, v in e.items()], "measure string, estimate double, se double, effective_n double, lower double, upper double")


def _items(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).filter("source.kind in ('sampled', 'retrieved') and role in ('train', 'calibration', 'test')")
    return r.select("id", "text", F.array(F.lit("refund"), F.lit("urgent")).alias("heads"), F.col("source.kind").alias("mechanism"), F.substring("id", 2, 20).cast("long").alias("position"), "role", F.col("source.design_id").alias("design_id"), F.col("source.stratum").alias("stratum"), F.col("source.stratum_size").alias("stratum_size"), "labels")


QUEUE = R + ", i AS (SELECT id, text, source.kind AS m, lpad(substr(id, 2)::BIGINT::VARCHAR, 20, '0') AS pos FROM r WHERE source.kind IN ('sampled', 'retrieved') AND role IN ('train', 'calibration', 'test')), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY CASE WHEN m = 'sampled' THEN md5('0:' || id) ELSE pos END, id) AS n FROM i)"


@query(QUEUE + "SELECT substr(md5('1:' || id), 1, 16) AS item_id, text FROM k WHERE n <= CASE m WHEN 'sampled' THEN 200 ELSE 50 END")
def label_queue(spark, d):
    return design.label_queue(_items(spark, d), {"sampled": 200, "retrieved": 50})[0].select("item_id", "text")


@query(QUEUE + "SELECT substr(md5('1:' || id), 1, 16) AS item_id, id, m AS mechanism FROM k WHERE n <= CASE m WHEN 'sampled' THEN 200 ELSE 50 END")
def label_queue_key(spark, d):
    return design.label_queue(_items(spark, d), {"sampled": 200, "retrieved": 50})[1].select("item_id", "id", "mechanism")


def _reviewed(spark: SparkSession, d: str):
    key = _sampled(spark, d).withColumn("item_id", F.col("id")).withColumn("heads", F.array(F.lit("refund"), F.lit("access")))
    return design.apply_reviews(key.drop("labels"), key.select("item_id", "labels"))


@query(SAMPLED + ", c AS (SELECT design_id, stratum, role, count(*) AS items, count(*) FILTER (labels['refund'] IN (0, 1) AND labels['access'] IN (0, 1)) AS labelled FROM s GROUP BY ALL) SELECT *, round(1 - labelled / items, 9) AS skip_rate, 1 - labelled / items > 0.05 AS warn FROM c")
def skip_rates(spark, d):
    return _reviewed(spark, d)[1].withColumn("skip_rate", F.round("skip_rate", 9))


@query(SAMPLED + "SELECT id, round(count(*) OVER (PARTITION BY design_id, stratum, role) / nullif(stratum_size, 0), 9) AS inclusion_prob FROM s WHERE labels['refund'] IN (0, 1) AND labels['access'] IN (0, 1)")
def apply_reviews(spark, d):
    return _reviewed(spark, d)[0].select("id", F.round("inclusion_prob", 9).alias("inclusion_prob"))


# --- retrieval ------------------------------------------------------------------------------------------


@query()
def retrieve_seeds(spark, d):
    """Neighbours of the seeds, diversified and merged; the greedy choice is not SQL."""
    v = _vectors(spark, d)
    return retrieval.retrieve_from_seeds(v.filter("used_as = 'seed'"), v.filter("used_as = 'pool'"), evaluation=v.filter("used_as = 'evaluation'")).select("id", "seed_ids", F.round("similarity", 6).alias("similarity"), "round")


@query(f"""WITH e AS (SELECT DISTINCT record_id AS id, used_as, embedding::DOUBLE[] AS v FROM embedded WHERE {VALID}),
p AS (SELECT id, v FROM e WHERE used_as = 'pool' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.used_as = 'evaluation' AND list_cosine_similarity(x.v, e.v) >= 0.95)),
c AS (SELECT s.id AS seed_id, p.id, list_cosine_similarity(s.v, p.v) AS c FROM e s JOIN p ON s.used_as = 'seed')
SELECT id, list_sort(list(seed_id)) AS seed_ids, round(max(c), 6) AS similarity FROM (SELECT * FROM c WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY c DESC, id) <= 5) GROUP BY id""")
def retrieve_nearest(spark, d):
    """The same with lambda 1: the nearest of each seed, merged."""
    v = _vectors(spark, d)
    return retrieval.retrieve_from_seeds(v.filter("used_as = 'seed'"), v.filter("used_as = 'pool'"), k=5, candidates=5, mmr_lambda=1.0, evaluation=v.filter("used_as = 'evaluation'")).select("id", "seed_ids", F.round("similarity", 6).alias("similarity"))


# --- documents ------------------------------------------------------------------------------------------


@query()
def document_chunks(spark, d):
    return documents.chunks(table(spark, d, "documents"))


@query()
def document_features(spark, d):
    """One pooled vector per document and the digest of its text."""
    f = documents.document_features(table(spark, d, "documents").select("doc_id", "text"))
    return f.select("doc_id", "chunks", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"), "text_digest")


@query("SELECT label AS doc_id, count(*)::INT AS chunks, list_transform(range(1, 65), lambda i: round(list_avg(list_transform(list(embedding), lambda e: e[i]::DOUBLE)), 9)) AS embedding FROM embeddings GROUP BY label")
def pool_vectors(spark, d):
    """Vectors of a class pooled as if they were the chunks of one document."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), "embedding")
    return documents.pool(v, 64).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 9)))


@query("SELECT account_id, count(DISTINCT split) AS splits FROM (SELECT account_id, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents WHERE account_id IS NOT NULL) GROUP BY account_id HAVING count(DISTINCT split) > 1")
def divided_groups(spark, d):
    rows = table(spark, d, "documents").filter("account_id is not null").withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))
    return documents.divided_groups(rows, "account_id")


@query("SELECT a.vec_id AS id, list_transform(list_concat(a.embedding, b.embedding), lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def context_features(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = documents.context_features(e, e.select((F.col("id") - 1).alias("id"), "embedding"))
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


LEXICAL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, coalesce(len(w) + greatest(0, len(w) - 1) + coalesce(list_sum(list_transform(w, lambda x: greatest(0, len(x)) + greatest(0, len(x) - 1) + greatest(0, len(x) - 2))), 0), 0)::BIGINT AS tokens FROM w
"""


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    f = tiers.lexical_features(table(spark, d, "documents").select("doc_id", "text"))
    return f.select("doc_id", F.unwrap_udt("lexical").alias("v"))


@query()
def lexical_features(spark, d):
    """Different hashed n-grams of every document's whole text, and all of them; the hash is not SQL."""
    total = F.aggregate("v.values", F.lit(0.0), lambda s, x: s + x)
    return _lexical(spark, d).select("doc_id", F.size("v.indices").alias("features"), total.cast("long").alias("tokens"))


@query(LEXICAL)
def lexical_tokens(spark, d):
    """Words, word pairs and character 3- to 5-grams of every document."""
    total = F.aggregate("v.values", F.lit(0.0), lambda s, x: s + x)
    return _lexical(spark, d).select("doc_id", total.cast("long").alias("tokens"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 0")
def document_chunk_words(spark, d):
    """Words of all chunks of a document: chunking loses none."""
    c = documents.chunks(table(spark, d, "documents"))
    return c.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("chunk"), r"\s+"))).alias("words"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text, E' \\t\\n\\r') = '' THEN 'INVALID_INPUT' END AS error_code, NOT (text IS NULL OR trim(text, E' \\t\\n\\r') = '') AS scored FROM documents")
def document_scores(spark, d):
    """Every document is scored whole or has the code of what stopped it."""
    encoder, pipeline = document_heads.Encoder("words", "1", 64), document_heads.Pipeline(max_chunks=1 << 20, max_bytes=1 << 30)
    v = document_heads.document_vectors(table(spark, d, "documents"), encoder, pipeline)
    head = scoring.Head("long", tuple(1.0 if i % 2 else -1.0 for i in range(64)))
    doc = {"classifier": {"heads": {"long": artifact.head_json(head)}}}
    return document_heads.score_vectors(v, doc).select("doc_id", "error_code", F.col("p_long").isNotNull().alias("scored"))


# --- monitoring -----------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (value >= 90) AS firing, count(*) FILTER (value >= 60) AS review FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1")
def drift_counts(spark, d):
    return monitor.window_counts(table(spark, d, "events"), 90.0, 60.0, score="value")


DRIFT = f"""
WITH RECURSIVE w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (value >= 90) AS firing, count(*) FILTER (value >= 60) AS review FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1),
u AS (SELECT min(window_start) + INTERVAL 7 DAY AS until FROM w),
r AS (SELECT sum(n)::BIGINT AS m, sum(firing)::BIGINT AS firing, sum(review)::BIGINT AS review FROM w, u WHERE window_start < until),
k AS (SELECT 'firing' AS name, m, firing AS k FROM r UNION ALL SELECT 'review', m, review FROM r),
h AS (SELECT name, m, k, 0 AS i, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS u0, 1.0::DOUBLE AS u1 FROM k
UNION ALL SELECT name, m, k, i + 1, CASE WHEN low < 0.00125 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN low < 0.00125 THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN up > 0.00125 THEN (u0 + u1) / 2 ELSE u0 END, CASE WHEN up > 0.00125 THEN u1 ELSE (u0 + u1) / 2 END
FROM (SELECT *, 1 - {stats_sql("k - 1", "m", "(l0 + l1) / 2")} AS low, {stats_sql("k", "m", "(u0 + u1) / 2")} AS up FROM h WHERE i < 55)),
v AS (SELECT w.window_start, h.name, CASE h.name WHEN 'firing' THEN w.firing ELSE w.review END AS x, w.n AS rows, l0 AS lo, u0 AS hi FROM w, u, h WHERE h.i = 55 AND w.window_start >= until),
p AS (SELECT window_start, name || '-up' AS test, x, rows, 1 - {stats_sql("x - 1", "rows", "hi")} AS p FROM v UNION ALL SELECT window_start, name || '-down', x, rows, {stats_sql("x", "rows", "lo")} FROM v)
SELECT window_start, 'head' AS head, test, x AS live_count, rows AS live_rows, round(p, 7) AS p_value, p <= 0.00125 AS alert FROM p
"""


@query(DRIFT)
def drift_checks(spark, d):
    """Four exact tests per day against the first week."""
    counts = save(monitor.window_counts(table(spark, d, "events"), 90.0, 60.0, score="value"), "windows")
    first = counts.agg(F.min("window_start")).first()[0]
    until = first + datetime.timedelta(days=7)
    ref = tuple(int(x) for x in counts.filter(F.col("window_start") < F.lit(until)).agg(F.sum("n"), F.sum("firing"), F.sum("review")).first())
    return monitor.monitor(counts.filter(F.col("window_start") >= F.lit(until)), ref).withColumn("p_value", F.round("p_value", 7))


@query(f"""
WITH RECURSIVE c(n, k) AS (VALUES (30, 15), (30, 27), (65, 32), (65, 62), (100, 50), (100, 97)),
b AS (SELECT n, k, 0 AS i, 0.0::DOUBLE AS llo, 1.0::DOUBLE AS lhi, 0.0::DOUBLE AS ulo, 1.0::DOUBLE AS uhi FROM c
UNION ALL SELECT n, k, i + 1, CASE WHEN low < 0.05 THEN (llo + lhi) / 2 ELSE llo END, CASE WHEN low < 0.05 THEN lhi ELSE (llo + lhi) / 2 END, CASE WHEN up > 0.05 THEN (ulo + uhi) / 2 ELSE ulo END, CASE WHEN up > 0.05 THEN uhi ELSE (ulo + uhi) / 2 END
FROM (SELECT *, 1 - {stats_sql("k - 1", "n", "(llo + lhi) / 2")} AS low, {stats_sql("k", "n", "(ulo + uhi) / 2")} AS up FROM b WHERE i < 60))
SELECT n, k, round(llo, 9) AS lower, round(ulo, 9) AS upper, round({stats_sql("k", "n", "0.8")}, 9) AS cdf FROM b WHERE i = 60""")
def numeric_bounds(spark, d):
    """Exact bounds and sizes of the numerics for a few counts."""
    rows = [(n, k, *(round(x, 9) for x in (stats.clopper_pearson_lower(k, n, 0.95), stats.clopper_pearson_upper(k, n, 0.95), stats.binomial_cdf(k, n, 0.8)))) for n in (30, 65, 100) for k in (n // 2, n - 3)]
    return spark.createDataFrame(rows, "n int, k int, lower double, upper double, cdf double")
