"""Provenance rules, weight caps, reviews of generated batches, hard negatives, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import random_rank
from ..functions.stats import minimum_samples
from .ranks import hex_bucket, ranked

REAL = ("sampled", "traffic", "retrieved")
ORDER = ("P1", "P2", "P3", "P4", "P7")


class ProvenanceError(ValueError):
    def __init__(self, code: str, count: int):
        super().__init__(f"{code}: {count} records break the rule")
        self.code, self.count = code, count


def is_real(kind: Column = None) -> Column:
    return (F.col("source.kind") if kind is None else kind).isin(*REAL)


def violations(records: DataFrame, *, accepted_batches: Sequence[str] = (), safety_critical: Sequence[str] = (), group: str = "group_id") -> DataFrame:
    """(code, id) of every record that breaks P1, P2, P3, P4 or P7.

    P1 calibration and test records are sampled, human-labelled, with 0 < inclusion probability <= 1.  P2 background is
    unlabelled traffic with a use.  P3 a group has one role and, in the background, one use.  P4 retrieved and generated
    records are train or stress.  P7 generated records are verified, or of an accepted batch without safety-critical label.
    Records without group share none.
    """
    kind, role = F.col("source.kind"), F.col("role")
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    pi = F.col("source.inclusion_prob")
    p1 = role.isin("calibration", "test") & no((kind == "sampled") & (F.col("labelled_by") == "human") & (pi > 0) & (pi <= 1))
    unlabelled = F.coalesce(F.forall(F.map_values("labels"), lambda v: v.isNull()), F.lit(True))
    p2 = (role == "background") & no((kind == "traffic") & unlabelled & F.col("background_use").isNotNull())
    p4 = kind.isin("retrieved", "generated") & no(role.isin("train", "stress"))
    batch = F.col("source.batch_id").isin(list(accepted_batches)) if accepted_batches else F.lit(False)
    critical = F.lit(False)
    for h in safety_critical:
        critical = critical | F.col("labels")[h].isNotNull()
    p7 = (kind == "generated") & no((F.col("verified") == True) | (batch & ~critical))  # noqa: E712
    flat = [records.filter(c).select(F.lit(n).alias("code"), "id") for n, c in (("P1", p1), ("P2", p2), ("P4", p4), ("P7", p7))]
    split = records.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct("role").alias("r"), F.countDistinct(F.when(role == "background", F.coalesce("background_use", F.lit("")))).alias("u")).filter("r > 1 or u > 1").select(group)
    flat.append(records.join(split, group, "left_semi").select(F.lit("P3").alias("code"), "id"))
    out = flat[0]
    for f in flat[1:]:
        out = out.unionByName(f)
    return out


def validate_provenance(records: DataFrame, *, overrides: Sequence[str] = (), **options) -> dict[str, int]:
    """Raise for a duplicate id or the first broken rule in the order P1, P2, P3, P4, P7; overridden rules and their counts come back."""
    if set(overrides) - set(ORDER):
        raise ValueError("only P1, P2, P3, P4 and P7 can be overridden")
    twice = records.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate record id {twice[0].id}")
    found = {r.code: r["count"] for r in violations(records, **options).groupBy("code").count().collect()}
    for code in ORDER:
        if code in found and code not in overrides:
            raise ProvenanceError(code, found[code])
    return found


def capped_weights(records: DataFrame, head: str, *, retrieved_share: float = 0.5, generated_share: float = 0.3, rule_matches: Column | None = None) -> DataFrame:
    """P6: train records with _weight after the caps.

    Retrieved positives may hold at most a share of the positives' weight, generated negatives of the negatives'; then
    the generated negatives of each rule may not outweigh the (already capped) positives that the rule matches.
    rule_matches: array of the rule ids that fire on the text; without it the per-rule cap is left out.
    """
    for s in (retrieved_share, generated_share):
        if not 0 <= s < 1:
            raise ValueError("a share must lie in [0, 1)")
    y, kind = F.col("labels")[head], F.col("source.kind")
    rows = records.withColumn("_w", F.coalesce(F.col("weight"), F.lit(1.0))).withColumn("_y", y).withColumn("_rp", F.coalesce((kind == "retrieved") & (y == 1), F.lit(False))).withColumn("_gn", F.coalesce((kind == "generated") & (y == 0), F.lit(False)))
    s = rows.agg(F.sum(F.when(F.col("_rp"), F.col("_w"))).alias("rp"), F.sum(F.when((F.col("_y") == 1) & ~F.col("_rp"), F.col("_w"))).alias("op"), F.sum(F.when(F.col("_gn"), F.col("_w"))).alias("gn"), F.sum(F.when((F.col("_y") == 0) & ~F.col("_gn"), F.col("_w"))).alias("on")).first()

    def scale(x: float | None, other: float | None, share: float) -> float:
        limit = (other or 0.0) * share / (1 - share)
        return limit / x if x and x > limit else 1.0

    a, b = scale(s.rp, s.op, retrieved_share), scale(s.gn, s.on, generated_share)
    rows = rows.withColumn("_w", F.col("_w") * F.when(F.col("_rp"), a).when(F.col("_gn"), b).otherwise(1.0))
    if rule_matches is None:
        return rows.withColumnRenamed("_w", "_weight").drop("_y", "_rp", "_gn")
    matched = rows.filter("_y = 1").select("_w", F.explode(F.array_distinct(rule_matches)).alias("_rule")).groupBy("_rule").agg(F.sum("_w").alias("_limit"))
    own = rows.filter("_gn").groupBy(F.col("source.rule_id").alias("_rule")).agg(F.sum("_w").alias("_have"))
    cap = own.join(matched, "_rule", "left").select("_rule", F.when(F.col("_have") > F.coalesce("_limit", F.lit(0.0)), F.coalesce("_limit", F.lit(0.0)) / F.col("_have")).otherwise(1.0).alias("_scale"))
    rows = rows.withColumn("_rule", F.when(F.col("_gn"), F.col("source.rule_id"))).join(cap, "_rule", "left")
    return rows.withColumn("_weight", F.col("_w") * F.coalesce("_scale", F.lit(1.0))).drop("_w", "_y", "_rp", "_gn", "_rule", "_scale")


def real_hard_negatives(records: DataFrame, head: str, rule: str) -> DataFrame:
    """Real human-labelled train negatives on whose text the rule (a regular expression) fires."""
    return records.filter((F.col("role") == "train") & is_real() & (F.col("labelled_by") == "human") & (F.col("labels")[head] == 0) & F.col("text").rlike(rule))


def select_for_review(batch: DataFrame, share: float = 0.2, least: int = 100, seed: int = 0) -> DataFrame:
    """A random part of each batch: the greater of share and ``least`` records, by md5 rank."""
    order = random_rank(F.col("id"), seed)
    sizes = batch.groupBy(F.col("batch_id").alias("_batch")).agg(F.greatest(F.ceil(F.count(F.lit(1)) * share - 1e-9), F.lit(least)).alias("_n"))
    placed = ranked(batch, ["batch_id"], [order, "id"], hex_bucket(order))
    return placed.join(sizes, F.col("batch_id").eqNullSafe(F.col("_batch"))).filter(F.col("_r") <= F.col("_n")).drop("_r", "_n", "_batch")


def wilson_lower(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(0.0)


def verify_batches(batch: DataFrame, reviews: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(records, summary) of generated batches: accepted where the lower bound of agreement reaches ``least``.

    batch: batch_id, id, intended; reviews: id, label.  Agreed records are verified with weight 1, disagreed ones dropped,
    unreviewed ones kept with the bound as weight; records of refused batches are dropped.
    """
    both = batch.join(reviews.select("id", "label"), "id", "left")
    s = both.groupBy("batch_id").agg(F.count("label").alias("reviewed"), F.count_if(F.col("label") == F.col("intended")).alias("agreed"))
    s = s.withColumn("lower", wilson_lower(F.col("agreed").cast("double"), F.col("reviewed").cast("double"))).withColumn("accepted", (F.col("reviewed") > 0) & (F.col("lower") >= least))
    kept = both.join(s.filter("accepted").select("batch_id", "lower"), "batch_id").filter(F.col("label").isNull() | (F.col("label") == F.col("intended")))
    return kept.withColumn("verified", F.col("label").isNotNull()).withColumn("weight", F.when(F.col("label").isNotNull(), 1.0).otherwise(F.col("lower"))).drop("lower", "label"), s


def seed_stats(records: DataFrame, head: str, least_rate: float = 0.1, least_labelled: int = 10) -> DataFrame:
    """(seed_id, labelled, confirmed, hit_rate, retire) over retrieved records labelled for the head."""
    y = F.col("labels")[head]
    rows = records.filter((F.col("source.kind") == "retrieved") & y.isin(0, 1)).select(F.explode("source.seed_ids").alias("seed_id"), y.alias("y"))
    s = rows.groupBy("seed_id").agg(F.count(F.lit(1)).alias("labelled"), F.sum("y").alias("confirmed"))
    return s.withColumn("hit_rate", F.col("confirmed") / F.col("labelled")).withColumn("retire", (F.col("labelled") >= least_labelled) & (F.col("hit_rate") < least_rate))


def coverage_values(records: DataFrame, head: str, axes: dict[str, Sequence[str]], group: str = "group_id") -> DataFrame:
    """(axis, value, role, positives, negatives, positive_groups) of real human-labelled records; every axis value has its roles' zero cells."""
    rows = _labelled(records, head)
    long = rows.select("role", "_y", F.col(group).alias("_g"), F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))).alias("t")).select("role", "_y", "_g", "t.*")
    counts = long.groupBy("axis", "value", "role").agg(F.count_if(F.col("_y") == 1).alias("positives"), F.count_if(F.col("_y") == 0).alias("negatives"), F.countDistinct(F.when(F.col("_y") == 1, F.col("_g"))).alias("positive_groups"))
    every = records.sparkSession.createDataFrame([(a, v) for a, vs in axes.items() for v in vs], "axis string, value string")
    roles = rows.select("role").distinct()
    grid = every.join(F.broadcast(roles), F.lit(True))  # axis values x roles: a few hundred rows
    return grid.join(counts, ["axis", "value", "role"], "left").fillna(0, ["positives", "negatives", "positive_groups"])


def _labelled(records: DataFrame, head: str) -> DataFrame:
    return records.filter(is_real() & (F.col("labelled_by") == "human") & F.col("labels")[head].isin(0, 1)).withColumn("_y", F.col("labels")[head])


def coverage_gaps(records: DataFrame, head: str, axes: dict[str, Sequence[str]], least: int = 10) -> DataFrame:
    """(a, b, positives, negatives): pairs of values of two axes with too few positives or negatives, zero cells included."""
    rows, names, out = _labelled(records, head), list(axes), None
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            c = rows.groupBy(F.col(x).cast("string").alias("va"), F.col(y).cast("string").alias("vb")).agg(F.count_if(F.col("_y") == 1).alias("positives"), F.count_if(F.col("_y") == 0).alias("negatives"))
            grid = records.sparkSession.createDataFrame([(va, vb) for va in axes[x] for vb in axes[y]], "va string, vb string")
            j = grid.join(c, ["va", "vb"], "left").fillna(0).filter((F.col("positives") < least) | (F.col("negatives") < least))
            part = j.select(F.concat(F.lit(f"{x}="), "va").alias("a"), F.concat(F.lit(f"{y}="), "vb").alias("b"), "positives", "negatives")
            out = part if out is None else out.unionByName(part)
    return out


def axis_problems(axes: dict[str, Sequence[str]], observable: Sequence[str] = (), slice_fields: Sequence[str] = ()) -> list[str]:
    """Why axes can't be used: empty or repeated values, observable names that are no axis, slices gated on axes that serving can't observe."""
    bad = [f"axis {a!r} needs a name" for a in axes if not a or "=" in a]
    for a, values in axes.items():
        if not values or any(not isinstance(v, str) or not v for v in values):
            bad.append(f"axis {a} needs values that are not empty")
        elif len(set(values)) != len(values):
            bad.append(f"axis {a} repeats a value")
    bad += [f"{a} is no axis" for a in [*observable, *slice_fields] if a not in axes]
    return bad + [f"axis {a} is not observable when serving, so no slice can be gated on it" for a in slice_fields if a in axes and a not in observable]


def coverage_slices(records: DataFrame, head: str, axes: dict[str, Sequence[str]], observable: Sequence[str], alpha: float = 0.05, delta: float = 0.05, group: str = "group_id") -> list[dict]:
    """Per value of an observable axis the calibration groups there are and needed; weighted samples count their Kish number."""
    need, out = minimum_samples(alpha, delta), []
    cal = _labelled(records, head).filter((F.col("role") == "calibration") & (F.col("_y") == 1)).withColumn("_iw", 1 / F.col("source.inclusion_prob"))
    bad = axis_problems(axes, observable)
    if bad:
        raise ValueError("; ".join(bad))
    for a in observable:
        got = {r.v: r for r in cal.groupBy(F.col(a).cast("string").alias("v")).agg(F.countDistinct(group).alias("g"), F.count(F.lit(1)).alias("n"), F.count("_iw").alias("m"), F.sum("_iw").alias("s"), F.sum(F.col("_iw") * F.col("_iw")).alias("ss")).collect()}
        for v in axes[a]:
            r = got.get(v)
            have = 0.0 if r is None else r.s * r.s / r.ss if r.m == r.n and r.ss else float(r.g)
            out.append({"axis": a, "value": v, "needed": need, "available": have, "shortfall": max(0, -int(-(need - have) // 1))})
    return out

