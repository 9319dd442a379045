import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import stats
from sieveline.operators import calibration, document_heads, evaluation, features, gates, ranks, scoring, thresholds, tiers, training
from sieveline.sources import cache


def world(n=600, seed=3, clusters=False):
    """Unit vectors of 8 numbers; labels by a half-space, or by three small clusters."""
    rng = np.random.default_rng(seed)
    if clusters:
        centers = rng.normal(size=(12, 8))
        at = rng.integers(0, 12, n)
        x, y = centers[at] + 0.25 * rng.normal(size=(n, 8)), np.isin(at, (0, 3, 6)).astype(int)
    else:
        at, x = np.zeros(n, int), rng.normal(size=(n, 8))
        y = (x[:, 0] + x[:, 1] + 0.6 * rng.normal(size=n) > 0.9).astype(int)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    split = ["train", "train", "calibration", "test"]
    return [(i, v.tolist(), split[i % 4], f"g{i}", int(k), f"c{a}") for i, (v, k, a) in enumerate(zip(x, y, at))]


SCHEMA = "id long, x array<double>, split string, group string, y_h int, finer string"


@pytest.fixture(scope="module")
def half(spark):
    return spark.createDataFrame(world(), SCHEMA)


@pytest.fixture(scope="module")
def spots(spark):
    return spark.createDataFrame(world(clusters=True), SCHEMA)


def test_ranks_equal_a_window_over_the_whole_key(spark):
    rows = [(k, i) for k in ("a", "b", None) for i in range(200)] + [("c", 7)]
    df = spark.createDataFrame(rows, "k string, id int").withColumn("h", F.md5(F.concat(F.coalesce("k", F.lit("")), F.col("id").cast("string"))))
    got = ranks.ranked(df, ["k"], ["h", "id"], ranks.hex_bucket(F.col("h"))).collect()
    for k in ("a", "b", None, "c"):
        own = sorted((r.h, r.id, r._r) for r in got if r.k == k)
        assert [r for *_, r in own] == list(range(1, len(own) + 1))
    assert len(got) == len(rows) and "_bucket" not in got[0]


def test_pair_fits_equal_the_local_ones(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=400) * 2
    y = (rng.random(400) < stats.sigmoid(0.7 * z - 0.5)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y)], "z double, y int")
    for firth in (False, True):
        fit = calibration.fit_pair(df, firth=firth)
        assert (fit.a, fit.c) == pytest.approx(stats.fit_platt(z, y, firth=firth), abs=1e-6)
        assert fit.covariance == pytest.approx(stats.platt_covariance(z, y, None, fit.a, fit.c), rel=1e-4) and fit.stable
    p = df.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    mine, local = calibration.cox(p), stats.cox_test(stats.sigmoid(z), y)
    assert mine["p_value"] == pytest.approx(local["p_value"], rel=1e-3) and mine["slope"] == pytest.approx(local["slope"], abs=1e-4)
    good = p.withColumn("p", 1 / (1 + F.exp(-(0.7 * F.col("z") - 0.5))))
    assert calibration.cox(good)["p_value"] > 0.01 > mine["p_value"]
    assert calibration.cox_corrected(df, calibration.fit_pair(df))["p_value"] == pytest.approx(1, abs=1e-6)
    assert calibration.regions(good, 0.3, 0.05, 0.05)["verdict"] in ("pass", "warn") and calibration.regions(p, 0.5, 0.0, 0.2)["verdict"] == "fail"
    xs, ys = calibration.fit_isotonic(p)
    lx, ly = stats.fit_isotonic(stats.sigmoid(z), y)
    assert np.interp(0.5, xs, ys) == pytest.approx(np.interp(0.5, lx, ly), abs=0.02) and ys == sorted(ys)
    with pytest.raises(ValueError):
        calibration.fit_pair(df.limit(0))


def test_risk_thresholds_equal_the_scan(spark):
    rng = np.random.default_rng(9)
    rows = [(float(s), f"h{k}", float(n)) for k, n in enumerate((400, 90, 3000)) for s in rng.random((60, 20, 40)[k])]
    df = spark.createDataFrame(rows, "s double, h string, N double")
    s, h = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for alpha in (0.1, 0.2, 0.4):
        want = stats.design_risk_threshold(s, h, {"h0": 400, "h1": 90, "h2": 3000}, alpha, 0.05)
        assert thresholds.risk_threshold(df, alpha, 0.05) == pytest.approx(want)
    assert thresholds.risk_threshold(df, 0.001, 0.05) is None and thresholds.risk_threshold(df.limit(0), 0.1, 0.05) is None
    y = [int(v > 0.4) for v in s]
    both = spark.createDataFrame([(*r, k) for r, k in zip(rows, y)], "s double, h string, N double, y int")
    steps = [i / 20 for i in range(20)]
    want = stats.design_precision_threshold(s, y, h, {"h0": 400, "h1": 90, "h2": 3000}, steps, 0.8, 0.05)
    assert thresholds.design_precision(both, steps, 0.8, 0.05) == want
    p = df.withColumn("p", F.col("s"))
    assert thresholds.background_upper(p, 2.0, 0.05, 0.95) == pytest.approx(stats.clopper_pearson_upper(6, 120, 0.95))


def test_running_sums(spark):
    rows = [(x / 7, x % 3) for x in range(-40, 60)] + [(1.0, 1), (float("nan"), 5), (None, 5)]
    df = spark.createDataFrame(rows, "p double, y int")
    got = {r.s: (r.n, r.t) for r in thresholds.running_sums(df, "p", {"n": F.lit(1), "t": F.col("y")}).collect()}
    real = [(s, t) for s, t in rows if s is not None and s == s]
    assert got == {s: (sum(a >= s for a, _ in real), sum(t for a, t in real if a >= s)) for s, _ in real}
    assert thresholds.running_sums(df.limit(0), "p", {"n": F.lit(1)}).count() == 0


def test_tiers_settle_within_their_budgets(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(800) < 0.25).astype(int)
    rows = [(int(k), float(k + 0.8 * rng.normal()), float(k + 0.5 * rng.normal()), float(k + 0.3 * rng.normal())) for k in y]
    df = spark.createDataFrame(rows, "y int, edge double, middle double, head double")
    tier = [tiers.Tier("edge", 0.01, 0.05), tiers.Tier("middle", 0.02, 0.1)]
    out, cuts = tiers.settle(df, tier)
    got = out.collect()
    neg, pos = sum(y == 0), sum(y == 1)
    assert sum(r.settled == "fire" and r.y == 0 for r in got) <= 0.02 * neg and sum(r.settled == "dismiss" and r.y == 1 for r in got) <= 0.1 * pos
    first, _ = tiers.settle(df, tier[:1])
    kept = {(r.edge, r.settled) for r in first.collect() if r.settled}
    assert kept <= {(r.edge, r.settled) for r in got} and cuts[0][0] is not None and cuts[1][0] is not None
    assert tiers.settle(df, [tiers.Tier("edge", 0.01, 0.05), tiers.Tier("middle", 0.01, 0.1)])[1][1][0] is None  # no larger firing budget

    def brute(t):
        order = sorted(((2, 0) if r.settled == "fire" else (0, 0) if r.settled == "dismiss" else (1, r.head), r.y) for r in got)[::-1]
        return min(sum(k == 0 for s, k in order if s >= cut) / neg for cut in {s for s, _ in order} if sum(k for s, k in order if s >= cut) / pos >= t)

    for t in (0.2, 0.8, 0.9, 0.97, 1.0):
        assert tiers.cascade_cost(out, t, "head", settled="settled") == pytest.approx(brute(t))
    choice = tiers.choose_cascade(df, {"edge_fire": 0.01, "edge_dismiss": 0.02, "middle_fire": 0.02, "middle_dismiss": 0.04}, 0.9)
    assert set(choice) == {"cascade", "two_tier", "three_tier"}
    fire, dismiss = tiers.certify(df.select(F.col("edge").alias("s"), "y"), 0.05, 0.2, 0.05)
    assert dismiss <= fire and sum(r.edge > fire and r.y == 0 for r in got) <= 0.05 * neg


@pytest.mark.parametrize("kind", ["knn", "stack", "finer"])
def test_featured_heads_find_clusters(spark, spots, kind):
    policy = {"kind": "recall", "target_recall": 0.8, "mode": "auto", "design_recall": 0.9, "allow_heuristic": True, "type": kind}
    r = training.train_heads(spots, {"h": policy}, 8)["h"]
    assert r["type"] == kind and len(r["spec"].weights) == features.feature_width(kind, 8) and r["evaluation"]["recall"] >= 0.8 and r["evaluation"]["false_alarm"] < 0.1
    p = features.score_featured(spots, r["spec"], r["features"])
    assert p.count() == 600 and p.filter("p_h between 0 and 1").count() == 600
    if kind == "finer":
        assert not r["features"].finer.problems(8) and r["features"].finer.problems(7)


def test_out_of_fold_features_ignore_the_own_fold(spark, spots):
    train = spots.filter("split = 'train'").select("id", "x", F.col("y_h").alias("y"), F.col("group").alias("key"), F.lit(1.0).alias("w"))
    model, f = features.fit_features(train, "knn", 8)
    own = {r.id: r.f[0] for r in f.collect()}
    whole = {r.id: r.f[0] for r in model.apply(train).collect()}
    assert len(own) == 300 and any(abs(own[i] - whole[i]) > 1e-9 for i in own)


def test_auto_takes_the_cheapest_type(spark, spots):
    policy = {"kind": "recall", "target_recall": 0.9, "mode": "auto", "design_recall": 0.9, "allow_heuristic": True, "type": "auto", "types": ("linear", "knn")}
    r = training.train_heads(spots, {"h": policy}, 8)["h"]
    assert r["type"] == "knn" and r["costs"]["knn"] < r["costs"]["linear"]


def test_presets_weak_rows_and_refit(spark, half):
    policy = {"kind": "recall", "target_recall": 0.7, "mode": "auto", "design_recall": 0.8, "allow_heuristic": True}
    weak = half.filter("split = 'train' and y_h = 1").limit(40).select((F.col("id") + 10000).alias("id"), F.transform("x", lambda v: v * 0.999).alias("x"), F.lit(1.0).alias("weight"), F.lit("r1").alias("rule_id"))
    r = training.train_heads(half, {"h": policy}, 8, weak={"h": weak}, refit="pooled", calibration_alpha=0.001)["h"]
    assert r["weak"]["rules"]["r1"]["rows"] == 40 and 0 < r["weak"]["scale"] <= 1 and "calibration_test" in r["evaluation"]
    with pytest.raises(ValueError, match="vector of a calibration"):
        training.train_heads(half, {"h": policy}, 8, weak={"h": half.filter("split = 'test'").select("id", "x", F.lit(0.5).alias("weight"), F.lit("r").alias("rule_id"))})
    with pytest.raises(ValueError, match="weights"):
        training.train_heads(half, {"h": policy}, 8, weak={"h": weak.withColumn("weight", F.lit(2.0))})
    with pytest.raises(training.CalibrationRemainderError):
        training.train_heads(half.withColumn("dismissed_h", F.lit(True)), {"h": policy}, 8)
    with pytest.raises(ValueError, match="both fired"):
        training.train_heads(half.withColumn("dismissed_h", F.lit(True)).withColumn("fired_h", F.col("id") == 1), {"h": policy}, 8)
    preset = half.withColumn("fired_h", (F.col("y_h") == 1) & (F.col("id") % 5 == 0))
    ev = training.train_heads(preset, {"h": policy}, 8)["h"]["evaluation"]
    assert ev["calibration_rows"] < 150


def test_refit_moves_no_decision(spark, half):
    z = half.select("id", (F.col("x")[0] * 4 + F.col("x")[1]).alias("z"), F.col("y_h").alias("y"))
    old = calibration.fit_pair(z.filter("id % 2 = 0"))
    new, levels = training.pooled_refit(z, (old.a, old.c), [0.5, 0.2])
    for before, after in zip((0.5, 0.2), levels):
        a = z.filter(1 / (1 + F.exp(-(old.a * F.col("z") + old.c))) >= before).count()
        assert a == z.filter(1 / (1 + F.exp(-(new.a * F.col("z") + new.c))) >= after - 1e-12).count()


def test_design_modes(spark, half):
    df = half.withColumn("stratum", F.when(F.col("id") % 3 == 0, "a").otherwise("b")).withColumn("stratum_size", F.when(F.col("id") % 3 == 0, 500).otherwise(4000))
    r = training.train_heads(df, {"h": {"kind": "recall", "target_recall": 0.6, "mode": "design"}}, 8)["h"]
    assert r["guarantee"]["kind"] == "design" and r["evaluation"]["design"]["recall"]["estimate"] > 0.5
    strict = training.train_heads(df, {"h": {"kind": "recall", "target_recall": 0.6, "mode": "design", "max_false_alarm": 0.0}}, 8)["h"]
    assert strict["guarantee"]["kind"] == "none" and any("void" in f for f in strict["failures"])
    none = training.train_heads(df, {"h": {"kind": "recall", "target_recall": 0.999, "mode": "design"}}, 8)["h"]
    assert none["spec"].threshold > 1 and none["failures"][-1].startswith("disabled")
    p = training.train_heads(df, {"h": {"kind": "precision", "target_precision": 0.5, "mode": "design"}}, 8)["h"]
    assert p["guarantee"]["kind"] == "design" and p["evaluation"]["precision"] > 0.5
    back = half.select((F.col("id") + 5000).alias("id"), "x")
    b = training.train_heads(half, {"h": {"kind": "recall", "target_recall": 0.7, "mode": "auto", "design_recall": 0.8, "allow_heuristic": True, "background_rate": 0.9}}, 8, background=back)["h"]
    assert 0 < b["guarantee"]["background_upper"] <= 1


def test_design_bootstrap_covers_the_estimate(spark):
    rng = np.random.default_rng(6)
    rows = [(float(p), int(rng.random() < p), f"h{i % 3}", 1000 * (i % 3 + 1)) for i, p in enumerate(rng.random(400))]
    e = evaluation.design_estimates(spark.createDataFrame(rows, "p double, y int, stratum string, stratum_size long"), 0.5, replicates=500)
    for k in ("recall", "precision", "false_alarm", "prevalence"):
        lo, hi = e[k]["bootstrap95"]
        assert lo <= e[k]["estimate"] <= hi and hi - lo == pytest.approx(2 * 1.96 * e[k]["se"], rel=0.25)


def test_gates_are_independent_checks():
    ev = {"threshold": 0.5, "recall": 0.7, "recall_ci95": (0.6, 0.8), "positives": 50, "fired": 60, "precision": 0.6, "ece": 0.2, "calibration_rows": 50, "certified": {"recall_upper": 0.85}, "positive_groups": 3, "slices": {"web=x": {"positives": 40, "recall": 0.5}, "web=y": {"positives": 3, "recall": 1.0}}, "vs_baseline": {"classifier_only": 0}}
    bad, warn = gates.gate_head({"kind": "recall", "target_recall": 0.8, "min_positives": 60, "min_recall_lower": 0.65, "slice_gate": {}, "min_positive_groups": 5}, ev)
    assert [b.split(":")[0] for b in bad] == ["test positives", "recall", "lower bound of recall", "positives that the baseline misses", "recall of slice web=x"]
    assert [w.split(":")[0] for w in warn] == ["positives of slice web=y", "groups of the test positives", "calibration error"]
    sure = ev | {"guarantee": {"kind": "pac"}, "calibration_rows": 500}
    bad, _ = gates.gate_head({"kind": "recall", "target_recall": 0.8, "must_beat_baseline": False}, sure, calibration_alpha=0.01, calibration={"test": "cox", "p_value": 1e-5})
    assert [b.split(":")[0] for b in bad] == ["calibration error", "calibration (cox)"]
    bad, warn = gates.gate_head({"kind": "precision", "target_precision": 0.7, "min_fired": 100}, ev | {"ece": math.nan}, calibration_alpha=0.01, calibration={"test": "region", "verdict": "warn"})
    assert len(bad) == 2 and len(warn) == 2


def test_documents_all_or_nothing(spark):
    enc, pipe = document_heads.Encoder("m", "1", 8), document_heads.Pipeline(max_words=5, max_chunks=4)
    rows = [(i, ("Please refund my order. " if i % 3 == 0 else "") + f"Filler {i % 5} one. Filler two {i % 7}.", ["train", "train", "calibration", "test"][i % 4], f"g{i}", int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, split string, group string, y_refund int")
    v = document_heads.document_vectors(docs, enc, pipe)
    assert v.filter("error_code is null").count() == 240
    feats = docs.join(v, "doc_id").select(F.col("doc_id").alias("id"), F.col("embedding").alias("x"), "split", "group", "y_refund")
    policy = {"refund": {"kind": "recall", "target_recall": 0.8, "mode": "auto", "design_recall": 0.9, "allow_heuristic": True}}
    result = document_heads.train_document_heads(feats, policy, enc, pipe)
    doc = document_heads.build_document_artifact(result, "v1", "2024-01-01T00:00:00+00:00")
    assert document_heads.validate_document_artifact(doc) == [] and document_heads.is_document_artifact(doc) and not document_heads.is_document_artifact({})
    assert document_heads.validate_document_artifact(doc | {"pipeline": doc["pipeline"] | {"max_words": 6}}) == ["the digest is not that of encoder and pipeline"]
    odd = spark.createDataFrame([(1, None), (2, "  "), (3, "A b c d e. " * 9), (4, "Please refund my order."), (4, "again"), (None, "x")], "doc_id long, text string")
    s = {r.doc_id: r for r in document_heads.score_documents(odd, doc).collect()}
    assert {k: r.error_code for k, r in s.items() if k != 4} == {1: "INVALID_INPUT", 2: "INVALID_INPUT", 3: "INPUT_LIMIT_EXCEEDED"}
    assert all((r.error_code is None) == (r.p_refund is not None) for r in s.values()) and s[4].error_code is None
    bad = lambda chunks: chunks.select("doc_id", "pos", F.array(*(F.lit(float("nan") if i == 3 else 0.1) for i in range(8))).alias("embedding"))
    half = lambda chunks: bad(chunks).filter("pos > 0")
    get = lambda e: {r.error_code for r in document_heads.score_documents(docs.limit(5), doc, e).collect()}
    assert get(bad) == {"INVALID_EMBEDDING"} and get(half) == {"ENCODER_FAILURE"}
    with pytest.raises(document_heads.DocumentError, match="several splits"):
        document_heads.train_document_heads(feats.withColumn("group", F.lit("one")), policy, enc, pipe)
    with pytest.raises(document_heads.DocumentError, match="linear only"):
        document_heads.train_document_heads(feats, {"refund": {"kind": "recall", "type": "knn"}}, enc, pipe)
    assert document_heads.compatibility_problems(document_heads.Encoder("m", "1", 8, max_input_words=3), pipe)


def test_cache_files(spark, tmp_path):
    a, b = cache.text_key("a"), cache.text_key("b")
    path = str(tmp_path / "c")
    with open(f"{path}.bin", "wb") as f:
        f.write(bytes.fromhex(a) + b"\0" * 5)  # an interrupted writer
    cache.write_binary([(a, [1.0, 2.5]), (b, [0.0, -1.0])], f"{path}.bin")
    assert {r.key: r.embedding for r in cache.read_binary(spark, f"{path}.bin", 2).collect()} == {a: [1.0, 2.5], b: [0.0, -1.0]}
    cache.write_json([(a, [1.0])], f"{path}.json")
    cache.write_json([(b, [2.0]), (a, [3.0])], f"{path}.json")
    assert {r.key: r.embedding for r in cache.read_json(spark, f"{path}.json").collect()} == {a: [3.0], b: [2.0]}
    assert cache.read_json(spark, f"{path}.none").count() == 0
    with open(f"{path}.keys", "w") as f:
        f.write(f"{a}\n{b}\nabc")
    with open(f"{path}.f32", "wb") as f:
        f.write(np.array([1, 2, 3, 4, 5], "<f4").tobytes())
    assert {r.key: r.embedding for r in cache.read_two_files(spark, path, 2).collect()} == {a: [1.0, 2.0], b: [3.0, 4.0]}
    with cache.locked(path), pytest.raises(TimeoutError), cache.locked(path, 0.1):
        pass


def test_scores_of_invalid_vectors_are_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0])], "id int, embedding array<double>")
    got = {r.id: r.scores for r in scoring.score_many(df, [scoring.Head("h", (1.0, -1.0), 0.5)], "id").collect()}
    assert got[2] is None and got[3] is None and got[4] is None
    assert got[1]["h"] == pytest.approx(stats.sigmoid(-0.5)) and got[5]["h"] == pytest.approx(stats.sigmoid(0.5))


def edge_world(n=900):
    rng = np.random.default_rng(12)
    words = "parcel order where late card login page price plan thanks hello again".split()
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.25)
        text = list(rng.choice(words, 8))
        if rng.random() < (0.85 if y else 0.01):
            text[int(rng.integers(0, 8))] = str(rng.choice(["stolen", "fraud"]))
        x = (rng.normal(size=6) + 1.6 * y).tolist()
        rows.append((i, " ".join(map(str, text)), y, ["train", "train", "calibration", "test"][i % 4], f"g{i}", bool(y and rng.random() < 0.3), x, [v + float(rng.normal()) for v in x[:3]]))
    return rows


def test_edge_and_middle_hold_their_budgets(spark):
    from sieveline.operators import edge

    df = spark.createDataFrame(edge_world(), "id long, text string, y int, split string, group string, rule boolean, x array<double>, middle array<double>")
    e = edge.train_edge(df, max_false_alarms=0.05, max_dismissed=(0.2, 0.1, 0.0), bits=10)
    assert [r.claims["max_dismissed"] for r in e["rungs"]] == [0.2, 0.1, 0.0] and e["rungs"][-1].dismiss is None
    assert e["train_scores"].count() == 450 and not e["warnings"] and len({r.digest() for r in e["rungs"]}) == 3
    bold = e["rungs"][0]
    out = bold.score(df.filter("split = 'calibration'")).collect()
    neg, pos = [r for r in out if r.y == 0], [r for r in out if r.y == 1]
    assert 0 < sum(r.edge_decision == "fire" for r in pos) and sum(r.edge_decision == "fire" for r in neg) <= 0.05 * len(neg) and sum(r.edge_decision == "dismiss" for r in pos) <= 0.2 * len(pos)
    again = edge.EdgeModel(bold.components, bold.parts, bold.blend, bold.fire, 0.0, bold.claims)
    assert again.digest() != bold.digest() and edge.assemble("edge/1", {"h": bold})["digests"]["h"] == bold.digest() and not tiers.validate_tier(edge.assemble("edge/1", {"h": bold}))
    m = edge.train_middle(df, bold, 0.8, max_false_alarms=0.1)
    both = m.score(bold.score(df.filter("split = 'calibration'"))).collect()
    assert all(r.tier_decision == r.edge_decision for r in both if r.edge_decision) and any(r.middle_decision for r in both)
    assert sum(r.tier_decision == "fire" for r in both if r.y == 0) <= 0.1 * len(neg)
    same = edge.train_middle(df, bold, 0.8, max_false_alarms=0.05)
    assert same is None or same.fire is None
    none = edge.train_edge(df.drop("rule"), scorers=("rules", "lexical"), bits=10)
    assert none["warnings"] and list(none["rungs"][0].components) == ["lexical"]
    with pytest.raises(ValueError):
        edge.train_edge(df.filter("y = 1"), bits=10)


def test_head_behind_an_edge(spark):
    from sieveline.operators import edge

    df = spark.createDataFrame(edge_world(), "id long, text string, y int, split string, group string, rule boolean, x array<double>, middle array<double>")
    e = edge.train_edge(df, max_false_alarms=0.05, max_dismissed=(0.1, 0.0), scorers=("rules", "lexical", "middle"), bits=10)
    r = edge.train_with_edge(df.withColumn("y_h", F.col("y")), "h", {"kind": "recall", "target_recall": 0.7, "mode": "auto"}, 6, e)
    assert r["guarantee"]["edge"]["digest"] == r["edge"].digest() and 0 < r["guarantee"]["chain"]["joint_delta"] <= 1
    assert r["evaluation"]["calibration_rows"] < 225 and r["evaluation"]["recall"] > 0.6
