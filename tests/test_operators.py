import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import vectors
from sieveline.functions.text import group_key, truncate_text
from sieveline.operators import artifact, design, documents, evaluation, gates, records, retrieval, scoring, thresholds, tiers, training
from sieveline.operators.scoring import Head, Policy
from sieveline.sources.cache import EmbeddingCache, read_binary, text_key, write_binary
from sieveline.streaming import monitor

HEADS = [Head(n, (1.0,), 0.0, ("platt", 1.0, 0.0), 0.9, 0.4) for n in "abc"]


def test_settled_decisions_equal_decide_for_all_scores(spark):
    rng = random.Random(7)
    names, levels = ["a", "b", "c"], [0.1, 0.5, 0.95]
    grid = [dict(zip(names, c)) for c in itertools.product(levels, repeat=3)]
    for _ in range(6):
        policy = Policy(tuple(rng.sample(names, 3)), tuple(((rng.choice(names),), (rng.choice(names),)) for _ in range(rng.randint(0, 2))))
        rows = [(i, [n for n in names if rng.random() < 0.3], [n for n in names if rng.random() < 0.3], *s.values()) for i, s in enumerate(grid)]
        df = spark.createDataFrame(rows, "id int, fired array<string>, dismissed array<string>, p_a double, p_b double, p_c double")
        out = df.select(scoring.settle(policy, F.col("fired"), F.col("dismissed")).alias("s"), scoring.decide(HEADS, policy, F.col("fired"), F.col("dismissed")).alias("d"))
        assert out.filter("s.settled and not (s.head <=> d.head and s.reason <=> d.reason)").count() == 0


def test_decide_suppression_and_floor(spark):
    policy = Policy(("a", "b"), ((("c",), ("a",)),))
    df = spark.createDataFrame([(0.95, 0.1, 0.5), (0.95, 0.1, 0.1), (0.5, 0.1, 0.1), (0.1, 0.1, 0.9)], "p_a double, p_b double, p_c double")
    got = [tuple(r.d) for r in df.select(scoring.decide(HEADS, policy).alias("d")).collect()]
    assert got == [(None, "near_threshold"), ("a", "above_threshold"), (None, "near_threshold"), (None, "none")]
    scoring.check_scores(df, ["a", "b"])
    with pytest.raises(ValueError):
        scoring.check_scores(spark.createDataFrame([(1.5,)], "p_a double"), ["a"])
    assert scoring.missing_policy_heads(Policy(("a", "z")), HEADS) == ["z"]


def test_calibrate_isotonic_holds_the_ends(spark):
    df = spark.createDataFrame([(-50.0,), (0.0,), (50.0,)], "z double")
    got = [r.p for r in df.select(scoring.calibrate(F.col("z"), ("isotonic", [0.2, 0.6], [0.1, 0.9])).alias("p")).collect()]
    assert got == pytest.approx([0.1, 0.7, 0.9])


def test_order_statistics_with_ties_and_nulls(spark):
    vals = [0.5] * 50 + [0.1, 0.9, None, float("nan"), 0.7]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    clean = sorted((v for v in vals if v is not None and v == v), reverse=True)
    for k in (1, 2, 3, 30, 53):
        assert thresholds.kth(df, k) == clean[k - 1]
        assert thresholds.kth(df, k, descending=False) == clean[::-1][k - 1]
    assert thresholds.kth(df, 54) is None and thresholds.kth(df.limit(0), 1) is None


def test_false_alarm_cap_and_budget(spark):
    neg = spark.createDataFrame([(i / 100,) for i in range(100)], "p double")
    t = thresholds.false_alarm_cap(neg, 0.05)
    assert t == math.nextafter(0.94, 1) and neg.filter(F.col("p") >= t).count() == 5
    assert thresholds.false_alarm_cap(neg, 1.0) == 0.0
    assert thresholds.budget_threshold(0.99, neg, 0.05) == 0.99


def test_conformal_selection_order(spark):
    pos = lambda n: spark.createDataFrame([((i + 1) / (n + 1),) for i in range(n)], "p double")
    neg = spark.createDataFrame([(0.99,)] * 200, "p double")
    s = thresholds.conformal_threshold("auto", 0.9, pos(200))
    assert s.kind == "pac" and not s.failures
    s = thresholds.conformal_threshold("auto", 0.9, pos(15))
    assert s.kind == "expected" and s.warnings
    s = thresholds.conformal_threshold("auto", 0.9, pos(3), heuristic_available=True)
    assert s.kind == "none" and s.threshold is None and s.warnings
    s = thresholds.conformal_threshold("auto", 0.9, pos(3), heuristic_available=True, allow_heuristic=False)
    assert s.failures and s.threshold == pytest.approx(0.25)
    s = thresholds.conformal_threshold("auto", 0.9, pos(200), [("false_alarm", neg, 0.1)])
    assert s.failures and s.kind == "none"  # the budget conflicts with the recall


def test_evaluate_and_gate(spark):
    rows = [(0.9, 1, "g1"), (0.2, 1, "g1"), (0.8, 1, "g2"), (0.1, 0, "g3"), (0.7, 0, "g4")]
    df = spark.createDataFrame(rows, "p double, y int, grp string").withColumn("b", F.col("p") > 0.85).withColumn("web", F.lit("x"))
    e = evaluation.evaluate_head(df, 0.6, group="grp", baseline="b", fields=["web"])
    assert (e["caught"], e["false_alarms"], e["positive_groups"]) == (2, 1, 2)
    assert e["vs_baseline"] == {"both": 1, "classifier_only": 1, "baseline_only": 0, "neither": 1}
    assert e["slices"] == {"web=x": {"positives": 3, "recall": pytest.approx(2 / 3)}}
    bad, warn = gates.gate_head({"kind": "recall", "target_recall": 0.9}, e)
    assert any("recall" in x for x in bad) and any("positives" in x for x in warn)
    assert gates.gate_head({"kind": "recall", "target_recall": 0.9}, e | {"threshold": math.nextafter(1, 2)})[0][0].startswith("disabled")
    never = evaluation.evaluate_head(df, 0.99)
    assert math.isnan(never["precision"]) and "never fires" in gates.gate_head({"kind": "precision", "target_precision": 0.5}, never)[0][0]
    assert "| head |" in evaluation.report_markdown({"h": {"evaluation": e, "failures": bad, "warnings": warn}})


def test_mmr_first_pick_has_no_penalty_and_ties_keep_the_lowest():
    v = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert retrieval.mmr_select(v, np.array([0.9, 0.9, 0.5]), 2, 0.5) == [0, 2]
    assert retrieval.mmr_select(v, np.array([0.9, 0.9, 0.5]), 3, 1.0) == [0, 1, 2]


def test_allocation_adds_up_and_keeps_floors():
    sizes = {"a": 1000, "b": 40, "c": 5}
    n = design.allocate(sizes, 200, floor=30)
    assert sum(n.values()) == 200 and n["c"] == 5 and n["b"] >= 30
    assert sum(design.allocate(sizes, 5000).values()) == 1045
    assert design.allocate(sizes, 300, method="manual", floor=1, manual={"a": 100}) == {"a": 100, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        design.allocate(sizes, 20, floor=30)
    ney = design.allocate({"a": 500, "b": 500}, 100, method="neyman", floor=1, rates={"a": 0.5, "b": 0.01})
    assert ney["a"] > 4 * ney["b"]
    assert design.required_size(sizes, {"a": 0.1, "b": 0.5}) <= 1045


def test_design_sample_weights_estimate_the_frame(spark):
    rng = random.Random(3)
    rows = [(f"i{i}", f"g{i // 2}", rng.random() < 0.1, rng.random() if i % 50 else None, rng.choice(["web", "app", None])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id string, group string, rule_fires boolean, score double, slice string")
    s, summary = design.design_sample(frame, 300, floor=5)
    got = s.toPandas()
    assert len(got) == 300 and got.group.is_unique
    assert summary.agg(F.sum("n_frame")).first()[0] == 1000
    cal = got[got.role == "calibration"]
    assert (1 / cal.inclusion_prob).sum() == pytest.approx(1000, rel=1e-6)


def test_provenance_raises_in_order(spark, data):
    r = spark.read.parquet(f"{data}/example_records.parquet").dropDuplicates(["id"])
    with pytest.raises(records.ProvenanceError):
        records.validate_provenance(r)
    found = records.validate_provenance(r, overrides=["P1", "P2", "P3", "P4", "P7"])
    assert set(found) <= {"P1", "P2", "P3", "P4", "P7"}
    with pytest.raises(ValueError):
        records.validate_provenance(r.unionByName(r.limit(1)), overrides=["P1"])
    assert records.violations(r.limit(0)).count() == 0


def test_retrieval_with_empty_sides(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6])], "id string, embedding array<double>")
    assert retrieval.retrieve_from_seeds(e.limit(0), e).count() == 0
    assert retrieval.retrieve_from_seeds(e.filter("id = 'a'"), e.limit(0)).count() == 0
    got = retrieval.retrieve_from_seeds(e.filter("id = 'a'"), e).orderBy("id").collect()
    assert [(r.id, r.seed_ids) for r in got] == [("a", ["a"]), ("b", ["a"])]
    assert retrieval.near_any(e, e.limit(0), 0.5).count() == 0


def test_cascade_cost_keeps_ties_together(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    assert tiers.cascade_cost(df, 1.0) == 0.5 and tiers.cascade_cost(df, 0.5) == 0.0
    assert tiers.cascade_cost(df.filter("y = 1"), 0.5) == 1.0
    assert tiers.validate_tier({"heads": {"h": {"fire": 0.1, "dismiss": 0.5}}}) and not tiers.validate_tier({"heads": {"h": {"fire": 0.5}}})
    assert tiers.edge_ladder([0.1], 0.8)[0]["remaining_target"] == pytest.approx(0.8 / 0.9)


def test_lexical_cross_fit(spark):
    rows = [(f"t{i}", "my card was stolen by fraud" if i % 2 else "where is the parcel now", i % 2) for i in range(60)]
    df = tiers.lexical_features(spark.createDataFrame(rows, "id string, text string, y int"), bits=10)
    out = tiers.cross_fit(df, lambda r: tiers.lexical_model(r), lambda m, r: m.transform(r).select("id", "y", "prediction"), folds=3)
    assert out.count() == 60 and out.filter("prediction = y").count() == 60


def test_distributed_fit_equals_the_local_one(spark):
    from sieveline.functions.stats import fit_logistic

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.5).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, y int").repartition(3)
    w, b, ok = training.fit_linear(df, 4)
    lw, lb, _ = fit_logistic(x, y, balance=True)
    assert ok and w == pytest.approx(lw, abs=1e-6) and b == pytest.approx(lb, abs=1e-6)
    mean, sd = training.standardiser(df, 4)
    assert mean == pytest.approx(x.mean(0)) and sd == pytest.approx(x.std(0))
    mean, comp = training.fit_pca(df, 4, 2)
    assert comp.shape == (2, 4) and np.linalg.norm(comp, axis=1) == pytest.approx([1, 1])
    assert training.choose_type({"linear": 0.5, "knn": 0.45}) == "linear" and training.choose_type({"linear": 0.5, "knn": 0.3}) == "knn"


def test_artifact_validation_and_round_trip(spark):
    h = Head("a", (0.1, 1 / 3), 0.2, ("platt", 1.1, -0.3), 0.7, 0.35)
    ev = evaluation.evaluate_head(spark.createDataFrame([(0.9, 1), (0.1, 0)], "p double, y int"), 0.7)
    doc = artifact.build({"a": {"spec": h, "guarantee": {"mode": "auto", "kind": "pac"}, "evaluation": ev, "failures": []}}, {"model_id": "m", "dimensions": 2, "normalize": True})
    assert artifact.validate(doc, mode="enforce") == [] and artifact.head_of("a", doc["heads"]["a"]) == h
    df = spark.createDataFrame([([0.3, 0.4],), ([1.0, -1.0],)], "embedding array<double>")
    assert artifact.round_trip(df, [h]).count() == 0
    assert artifact.validate(doc | {"gates": {"passed": False}}, mode="enforce") == ["gates did not pass"]
    wrong = doc | {"heads": {"a": doc["heads"]["a"] | {"weights": [1.0], "review_floor": 0.9}}}
    assert len(artifact.validate(wrong)) == 2
    assert artifact.validate_embedding_spec({"model_id": "m", "dimensions": 7, "layers": [1, 2]}) == ["dimensions must be a multiple of the layers"]
    rows = [[0.5, -1.0, 0.25], [0.0, 0.0, 0.0]]
    assert artifact.decode_reference(artifact.encode_reference(rows)) == rows
    back = artifact.decode_reference(artifact.encode_reference(rows, "int8"))
    assert back[0] == pytest.approx(rows[0], abs=0.5 / 127) and back[1] == rows[1]
    assert artifact.check_pairing({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"}) == ["b", "c"]
    good, bad = {"gates": {"passed": True}}, {"gates": {"passed": False}}
    assert artifact.publication(good, {"promoted"}, generated=True) == (None, ["evidence"]) and artifact.publication(good, {"promoted"}, blocked=True)[1] == ["unblocked"]
    assert artifact.publication(good, {"promoted"}) == ("promoted", []) and artifact.publication(bad, set()) == (None, ["gates or leave"])
    assert artifact.publication(bad, {"shadow-candidate"})[0] == "shadow-candidate" and artifact.publication(good, {"promoted", "shadow-candidate"})[1] == ["one role"]
    places = {"promoted": "p", "shadow-candidate": "c"}
    assert artifact.load_order("shadow", places)[0] == ("c", "shadow-candidate") and artifact.load_order("enforce", places) == [("p", "promoted")]
    assert not artifact.servable("enforce", bad) and artifact.servable("shadow", bad)


def test_document_chunks_keep_all_sentences(spark):
    text = "One two three. Four five! " + "word " * 20 + "end. Last one?"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "single")], "doc_id long, text string")
    c = documents.chunks(df, 8).orderBy("doc_id", "pos").collect()
    assert " ".join(r.chunk for r in c if r.doc_id == 1).split() == text.split()
    assert {r.doc_id for r in c} == {1, 4}
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 0.0])], "doc_id long, embedding array<double>")
    assert {(r.doc_id, r.error_code) for r in documents.problems(v, 2).collect()} == {(2, "wrong_width"), (3, "not_finite")}


def test_text_expressions(spark):
    df = spark.createDataFrame([(" G-0005 ", "a😀b"), ("g-5", ""), (None, None), ("g-000", "abc")], "g string, t string")
    assert [r[0] for r in df.select(group_key(F.col("g"))).collect()] == ["g-5", "g-5", None, "g-0"]
    assert [r[0] for r in df.select(truncate_text(F.col("t"), 2)).collect()] == ["a", "", None, "ab"]
    assert [r[0] for r in df.select(truncate_text(F.col("t"), 3)).collect()] == ["a😀", "", None, "abc"]
    e = spark.createDataFrame([("Hello hello world",), ("",), (None,)], "t string").select(vectors.hash_embedding(F.col("t"), 8).alias("e")).collect()
    assert sum(x * x for x in e[0].e) == pytest.approx(1) and set(e[1].e) == {0.0} and e[2].e is None


def test_cache_embeds_each_text_once(spark, tmp_path):
    calls = []

    def embed(missing):
        calls.append(missing.count())
        return missing.select("key", F.array(F.length("text").cast("float")).alias("embedding"))

    cache = EmbeddingCache(spark, str(tmp_path / "cache"), embed, max_chars=5)
    df = spark.createDataFrame([(1, "alpha one"), (2, "alpha two"), (3, None), (4, "beta")], "id int, text string")
    out = {r.id: r.embedding for r in cache.embed_many(df).collect()}
    assert out == {1: [5.0], 2: [5.0], 3: None, 4: [4.0]}
    cache.embed_many(df).collect()
    assert calls == [2, 0]
    path = str(tmp_path / "c.bin")
    write_binary([(text_key("a"), [1.0, 2.5]), (text_key("b"), [0.0, -1.0])], path)
    with open(path, "ab") as f:
        f.write(b"torn")
    assert {r.key: r.embedding for r in read_binary(spark, path, 2).collect()} == {text_key("a"): [1.0, 2.5], text_key("b"): [0.0, -1.0]}


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=i), (i * 37 % 100) / 100) for i in range(24 * 10)]
    df = spark.createDataFrame(rows, "ts timestamp, score double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    ref = (1000, 100, 300)
    q = monitor.start_monitor(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 0.9, 0.6, ref, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    batch = monitor.monitor(monitor.window_counts(df, 0.9, 0.6), ref)
    live = spark.read.schema(monitor.CHECKS).parquet(str(tmp_path / "out"))
    assert live.count() > 0 and live.exceptAll(batch).count() == 0


def test_drift_checks_find_a_shift():
    ref = (20000, 320, 1700)
    assert not any(c["alert"] for c in monitor.drift_checks((10000, 160, 850), ref))
    assert any(c["alert"] for c in monitor.drift_checks((10000, 400, 850), ref))
    with pytest.raises(ValueError):
        monitor.drift_checks((0, 0, 0), ref)


def test_every_design_is_sampled_like_its_own_frame(spark, tmp_path):
    from sieveline.operators import design
    from sieveline.plans import registry

    rows = [(d, f"{d}{i}", f"g{i % 90}", i % 3 == 0, None if i % 17 == 0 else (i * k) % 101 / 101, "en" if i % 4 else None) for d, k in (("a", 7), ("b", 13)) for i in range(300)]
    frames = spark.createDataFrame(rows, "design_id string, id string, group string, rule_fires boolean, score double, slice string")
    sample, strata = design.design_samples(frames, 60, floor=5)
    got = {(r.design_id, r.id, r.stratum, r.role) for r in sample.collect()}
    for d in "ab":
        alone, its = design.design_sample(frames.filter(f"design_id = '{d}'").drop("design_id"), 60, floor=5, design_id=d)
        assert {x for x in got if x[0] == d} == {(r.design_id, r.id, r.stratum, r.role) for r in alone.collect()} and len([x for x in got if x[0] == d]) == 60
        assert sorted(strata.filter(f"design_id = '{d}'").collect()) == sorted(its.collect())
    items = frames.selectExpr("regexp_replace(regexp_replace(design_id, 'a', 'd00-0000'), 'b', 'd00-0001') AS design_id", "id", "group AS group_id", "struct(rule_fires, score, slice) AS signals")
    items.write.parquet(f"{tmp_path}/frame_items.parquet")
    for name in ("design_sample", "design_summary"):
        assert {r.design_id for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == {"d00-0000", "d00-0001"}


def test_axes_are_checked():
    assert records.axis_problems({"web": ["a", "b"]}, ["web"], ["web"]) == []
    bad = records.axis_problems({"web": ["a", "a"], "": ["x"], "none": []}, ["other"], ["web"])
    assert len(bad) == 5 and any("not observable" in b for b in bad)


def test_lexical_features_equal_a_plain_count(spark):
    text = "My card's card, it's 5 a"
    words = ["my", "card", "s", "card", "it", "s", "5", "a"]
    want = words + [f"{a} {b}" for a, b in zip(words, words[1:])] + [f"#_{w}_"[0] + f"_{w}_"[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.t for r in df.select("id", tiers.lexical_tokens(F.col("text")).alias("t")).collect()}
    assert sorted(got[1]) == sorted(want) and not got[2] and got[3] == []
    v = {r.id: r.lexical for r in tiers.lexical_features(df).collect()}
    assert v[1].size == 1 << 18 and v[1].toArray().sum() == len(want) and v[2].toArray().sum() == 0


def test_chunks_by_a_tokenizer_of_the_caller(spark):
    def count(texts):
        return [-(-len(t) // 4) for t in texts]  # four letters a token

    def embed(texts):
        return np.array([[1.0, 0.0] if "card" in t else [0.0, 1.0] for t in texts])

    text = "My card is lost. The card was blue.\nWhere is it? " + "longword " * 30 + "end."
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "x" * 200)], "doc_id long, text string")
    got = documents.plan_chunks(df, 12, count).orderBy("doc_id", "pos").collect()
    assert " ".join(r.chunk for r in got if r.doc_id == 1).split() == text.split() and all(r.tokens <= 12 for r in got if r.doc_id == 1)
    assert [r.chunk for r in got if r.doc_id == 4] == ["x" * 200] and {r.doc_id for r in got} == {1, 4}
    assert [r.pos for r in got if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in got)))
    apart = documents.plan_chunks(df, 40, count, embed=embed, least_cosine=0.5).filter("doc_id = 1").orderBy("pos").collect()
    assert apart[0].chunk == "My card is lost. The card was blue." and not any("card" in r.chunk for r in apart[1:])
    assert documents.plan_chunks(df.limit(0), 5).count() == 0
