import itertools
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

llm = pytest.importorskip("sieveline.llm.queries")

from sieveline.llm import buckets, components, leaks, near_duplicates, neighbours, overlaps, packing, personal, proportions, reading, splits, varied  # noqa: E402
from sieveline.llm.common import take_by_rank  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]


def words_of(t):
    return set(re.findall(r"[^\W_]+", t.lower()))


def like(a, b):
    return len(a) >= 8 and len(b) >= 8 and len(a & b) >= 0.7 * len(a | b)


def texts(n, seed):
    """Texts of 20 to 40 words, some with edits, copies, nulls, empty and very short ones."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.3 and rng.choice(out):
            w = (rng.choice([t for t in out if t]) or "x").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            out.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w))
        elif kind < 0.35:
            out.append(rng.choice([None, "", "too short", "!!!"]))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 40))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts(300, 1)
    rows = [(f"d{i:04d}", x, f"key{i}", 7) for i, x in enumerate(t)]
    rows += rows[:20]  # delivered twice
    rows.append(("d9999", "long " + " ".join(random.Random(2).choice(WORDS) for _ in range(50_000)), "x", 1))
    return rows, spark.createDataFrame(rows, "id string, text string, key string, n int")


def test_near_duplicates_equal_brute_force(docs):
    rows, df = docs
    w = {i: words_of(t) for i, t, *_ in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(w), 2) if like(w[a], w[b])}
    got = [tuple(r) for r in near_duplicates.pairs_of_members(*near_duplicates.near_duplicates(df)).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 50
    assert len(set(got)) >= 0.97 * len(want)
    groups = near_duplicates.near_duplicate_groups(df).collect()
    assert {r.id for r in groups} == {x for p in got for x in p}
    by = {r.id: r.group_id for r in groups}
    assert all(by[a] == by[b] for a, b in got)


def test_near_duplicates_of_nothing(docs):
    _, df = docs
    for few in (df.limit(0), df.filter("text is null or length(text) < 12")):
        assert near_duplicates.pairs_of_members(*near_duplicates.near_duplicates(few)).count() == 0
        assert near_duplicates.near_duplicate_groups(few).count() == 0


@pytest.mark.parametrize("sided", [False, True])
def test_runs_are_streamed_in_chunks(spark, monkeypatch, sided):
    """One chunk, small chunks and hot runs in blocks give the pairs of brute force."""
    rng = np.random.default_rng(3)
    rows = {(int(k), int(c)): (int(k), int(c) * 5, int(c) * 3 - 200, int(n), int(c) % 2) for k, c, n in zip(np.minimum(rng.zipf(1.3, 3000), 500), rng.integers(1, 400, 3000), rng.integers(8, 20, 3000))}
    packed = [(int(buckets.with_size(np.array([r[0] << buckets.SIZE_BITS]), np.array([r[3]]))[0]), r[1], r[2], r[4]) for r in [*rows.values(), *list(rows.values())[:50]]]
    df = spark.createDataFrame(packed, "key long, s1 long, s2 long, side int")
    alike, want, by = buckets.AlikeSigns(7), set(), {}
    for r in rows.values():
        by.setdefault(r[0], []).append(r[1:])
    bits = lambda x, y: sum(((x[i] ^ y[i]) & (2**64 - 1)).bit_count() for i in (0, 1))
    for run in by.values():
        for x, y in itertools.combinations(run, 2):
            if bits(x, y) <= 7 and (not sided or x[3] != y[3]):
                a, b = (x, y) if ((x[3], x[:3]) < (y[3], y[:3]) if sided else x[:3] < y[:3]) else (y, x)
                want.add((*a[:3], *b[:3]))
    get = lambda: {tuple(r) for r in buckets.candidates(df, "t", alike, sided=sided).collect()}
    assert get() == want and len(want) > 100
    monkeypatch.setattr(buckets, "CHUNK", 50)
    assert get() == want
    monkeypatch.setattr(buckets, "HOT", 16)
    assert get() == want


def test_sketches_lose_no_pair():
    rng, alike = np.random.default_rng(8), buckets.AlikeSets(0.7)
    for n in (8, 30, 60, 120, 400):
        sets = []
        for _ in range(100):
            edits = rng.integers(0, int(0.35 * n))
            w = rng.integers(0, 1 << 60, n)
            sets += [w, np.r_[w[: n - edits // 2], rng.integers(0, 1 << 60, edits // 2), w[:3]]]
        off = np.r_[0, np.cumsum([len(x) for x in sets])]
        s, size = buckets.sketches(np.concatenate(sets), off)
        assert size.tolist() == [len(set(x.tolist())) for x in sets]
        x, y = (i.ravel() for i in np.meshgrid(np.arange(0, 200, 2), np.arange(1, 200, 2)))
        ok = alike({"s1": s[:, 0], "s2": s[:, 1], "n": size}, x, y)
        near = np.array([len(set(sets[i]) & set(sets[j])) >= 0.7 * len(set(sets[i]) | set(sets[j])) for i, j in zip(x, y)])
        assert ok[near].all() and ok[~near].mean() < (0.5 if n == 8 else 0.05)


def test_hot_buckets_are_banded_more_finely(docs, monkeypatch):
    rows, df = docs
    w = {i: words_of(t) for i, t, *_ in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(w), 2) if like(w[a], w[b])}
    monkeypatch.setattr(buckets, "HOT", 2)
    got = {tuple(r) for r in near_duplicates.pairs_of_members(*near_duplicates.near_duplicates(df)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert buckets.recall(0.7, near_duplicates.FINE_BANDS, near_duplicates.FINE_ROWS) > 0.998


def test_large_classes_are_joined_in_blocks(docs, monkeypatch):
    _, df = docs
    pairs = near_duplicates.near_duplicates(df)
    whole = {tuple(r) for r in near_duplicates.pairs_of_members(*pairs).collect()}
    monkeypatch.setattr(near_duplicates, "CLASS_BLOCK", 2)
    rows = [tuple(r) for r in near_duplicates.pairs_of_members(*pairs).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == whole


def test_band_recall_is_as_planned():
    assert buckets.recall(0.8, near_duplicates.BANDS, near_duplicates.ROWS) > 0.995
    rng, hit = np.random.default_rng(1), 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 60, k) for k in (80, 10, 10))
        flat, off = np.r_[np.sort(np.r_[common, a]), np.sort(np.r_[common, b])], np.array([0, 90, 180])
        k = buckets.band_keys(buckets.minhash(flat, off, 120, 0), 20, 6)
        hit += bool((k[0] == k[1]).any())
    assert hit / 300 > 0.97


def test_split_overlaps_equal_brute_force(spark, docs):
    rows, _ = docs
    rng = np.random.default_rng(3)
    roles = ["train", "calibration", "test", "background"]
    rec = [(i, t, roles[k % 4], "sampled", "x") for k, (i, t, *_) in enumerate(rows[:300])]
    vec = []
    for k, (i, *_) in enumerate(rec):
        v = rng.normal(size=64) if k < 150 or k % 3 else np.array(vec[k - 150][1] if vec[k - 150][1] else rng.normal(size=64)) * 3 + rng.normal(size=64) * 0.2
        vec.append((i, v.tolist()))
    for k, bad in ((5, None), (9, [0.0] * 64), (13, [1.0] * 63), (17, [float("nan")] * 64)):
        vec[k] = (vec[k][0], bad)
    vec += vec[:5]
    r, e = spark.createDataFrame(rec + rec[:9], "id string, text string, role string, kind string, a string"), spark.createDataFrame(vec, "id string, embedding array<float>")
    pairs, per = overlaps.split_overlaps(r, e, {"train": 0, "calibration": 1, "test": 1})
    got = {(p.id_a, p.id_b) for p in pairs.collect()}
    ok = {i: np.float32(v) / np.linalg.norm(np.float32(v)) for i, v in vec if v and len(v) == 64 and np.isfinite(v).all() and any(v)}
    w = {i: words_of(t) for i, t, *_ in rec if t}
    want = set()
    for (a, _, ra, *_), (b, _, rb, *_) in itertools.product(rec, rec):
        if ra == "train" and rb in ("calibration", "test"):
            if a in w and b in w and like(w[a], w[b]) or a in ok and b in ok and ok[a] @ ok[b] >= 0.95:
                want.add((min(a, b), max(a, b)))
    assert len(want) > 20 and got <= want and len(got) >= 0.97 * len(want)
    assert pairs.count() == len(got) and per.agg(F.sum("partners")).first()[0] == len(got)
    assert overlaps.split_overlaps(r.limit(0), e.limit(0), {"train": 0, "test": 1})[0].count() == 0


def test_winnowing_finds_every_long_shared_run():
    rng = np.random.default_rng(5)
    for _ in range(50):
        k, w = 3, 6
        shared = rng.integers(0, 1 << 60, k + w - 1)
        a, b = (np.r_[rng.integers(0, 1 << 60, rng.integers(0, 9)), shared, rng.integers(0, 1 << 60, rng.integers(0, 9))] for _ in range(2))
        keys = []
        for x in (a, b):
            h, inside = overlaps.grams(x, np.array([0, len(x)]), k)
            keys.append(set(h[overlaps.winnow(h, inside, np.zeros(len(h), int), None, w)].tolist()))
        assert keys[0] & keys[1]


def test_align_covers_edits():
    a = np.arange(30)
    b = a.copy()
    b[10] = 99
    assert overlaps.align(a, b, 3) == (29, 29, 19)
    assert overlaps.align(a, np.arange(100, 130), 3) == (0, 0, 0)
    assert overlaps.align(a[:2], a[:2], 3) == (0, 0, 0)


def test_forest_finds_the_nearest(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 64)) * 1.5
    x = np.concatenate([c + rng.normal(size=(20, 64)) * 0.5 for c in centers])
    rows = [(f"v{i:04d}", v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(f"c{i:04d}", x[0].tolist(), 1.0) for i in range(300)] + rows[:10]  # a crowd of copies, rows delivered twice
    rows += [("n1", None, 0.0), ("n2", [0.0] * 64, 0.0), ("n3", [1.0] * 3, 0.0), ("n4", [float("inf")] * 64, 0.0)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, cosine double")
    q = df.filter("id in ('v0000', 'v0100', 'v0777', 'n2')")
    got = {}
    for r in neighbours.nearest(df, q, 10, 64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.cosine))
    ok = {i: np.float64(np.float32(v)) / np.linalg.norm(np.float32(v)) for i, v, _ in rows if v and len(v) == 64 and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for i in ("v0100", "v0777"):
        want = sorted(((-(ok[i] @ v), j) for j, v in ok.items() if j != i))[:10]
        hits += len({j for _, j, _ in got[i]} & {j for _, j in want})
        total += 10
    assert hits / total >= 0.9 and "n2" not in got
    assert [j for _, j, _ in sorted(got["v0000"])] == [f"c{i:04d}" for i in range(10)]  # ties go to the least ids
    exact = neighbours.nearest(df, q, 3, 64, complete=True).filter("query_id = 'v0777'").orderBy("rank").collect()
    want = sorted(((-(ok["v0777"] @ v), j) for j, v in ok.items() if j != "v0777"))[:3]
    assert [r.id for r in exact] == [j for _, j in want]
    assert neighbours.nearest(df.limit(0), q, 3, 64).count() == 0 and neighbours.nearest(df, q.limit(0), 3, 64).count() == 0


def test_forest_search_in_crowds_and_far_is_exact():
    """A block of 50,000 unit vectors: unstructured ones (far neighbours) and crowds at cosine 0.99 and 0.999 to their centers."""
    rng = np.random.default_rng(16)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = [unit(rng.normal(size=(42000, 64)))]
    for c in (0.99, 0.999):
        center, noise = unit(rng.normal(size=64)), unit(rng.normal(size=(4000, 64)))
        x.append(unit(c * center + (1 - c * c) ** 0.5 * noise))
    x = np.concatenate(x).astype(np.float32)
    ids = np.array([f"v{i:05d}" for i in range(len(x))], dtype=object)
    asked = np.r_[0:40, 42000:42030, 46000:46030]
    block = neighbours.Block(x, ids, neighbours.TREES, neighbours.DEPTH)
    t = block.answer(x[asked], ids[asked], 10, neighbours.CANDIDATES, True)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    alone = block.answer(x[asked], ids[asked], 10, neighbours.CANDIDATES, False)
    got, some = (set(zip(b.column("query_id").to_pylist(), b.column("id").to_pylist())) for b in (t, alone))
    want = set()
    for i in asked:
        c = y @ y[i]
        c[i] = -2
        want |= {(ids[i], ids[j]) for j in np.lexsort((np.arange(len(c)), -c))[:10]}
    assert len(got & want) >= len(want) - 1  # double sums in another order may swap a tie
    assert len(some & want) >= 0.4 * len(want)  # candidates of the hash strings alone


def test_forest_streams_many_queries(spark, monkeypatch):
    """More queries than are broadcast go past several blocks; the result is the same."""
    rng = np.random.default_rng(17)
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(rng.normal(size=(600, 64)))] + [("n1", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    few = {(r.query_id, r.id, r.rank) for r in neighbours.nearest(df, df, 5, 64).collect()}
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 10)
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    many = {(r.query_id, r.id, r.rank) for r in neighbours.nearest(df, df, 5, 64).collect()}
    assert few == many and len(few) == 3000


def test_pairs_of_neighbours_put_the_smaller_id_first(spark, data):
    assert llm.p2_found(spark, data).filter("id_a >= id_b").count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300, i) for i in range(301, 380)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    df = spark.createDataFrame(edges, "a long, b long")
    labels, forest = components.spanning_forest(df)
    got = {r.node: r.root for r in labels.collect()}
    assert set(got) == set(parent)
    assert len({(got[x], find(x)) for x in parent}) == len(set(got.values())) == len({find(x) for x in parent})
    assert forest.count() == len(got) - len(set(got.values()))
    assert components.components(df.limit(0)).count() == 0


def test_splits_keep_groups_together(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", rng.choice([f" G-{k:04d}", f"g-{k}"]) if (k := int(rng.paretovariate(0.7))) % 7 else None, rng.choice(["train", "test"]), f"acc{i}", "x") for i in range(1500)]
    rows += [(f"h{i}", "g-77777", "train", None, "x") for i in range(700)] + rows[:50]
    df = spark.createDataFrame(rows, "id string, group_id string, role string, author string, root string")
    key = splits.normal_group(F.col("group_id"))
    out = splits.assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1}, {"g": key})
    got = {r.id: r.split for r in out.collect()}
    assert out.count() == len(got) == 2200
    by = {}
    for i, g, *_ in rows:
        if g:
            by.setdefault("g-" + g.strip().lower()[2:].lstrip("0"), set()).add(got[i])
    assert all(len(s) == 1 for s in by.values())
    assert abs(sum(s == "train" for s in got.values()) / len(got) - 0.8) < 0.05
    roles = {}
    for i, g, role, *_ in rows:
        if g:
            roles.setdefault("g-" + g.strip().lower()[2:].lstrip("0"), set()).add(role)
    assert {r.group_key for r in splits.divided(df, "g", key).collect()} == {g for g, s in roles.items() if len(s) > 1}
    two = splits.assign_splits(df.limit(60), {"a": 1.0, "b": 1.0}, {"g": key, "author": F.col("author")})
    assert two.count() == two.select("id").distinct().count()
    assert splits.assign_splits(df.limit(0), {"a": 1.0}, {"g": key}).count() == 0


def test_personal_spans_and_placeholders(spark):
    t = [
        "Hi, My name is Tilda Ironmonk. You can reach me at tilda.ironmonk@inkpost.test any time.",
        "Mr Corvin Ferncastle told me to write again. Call (08) 5550 4629 after six.",
        "Tracking ZX 1770 6443 5861 says it is late. The ref 291 275 726 is on the slip. Meet @ 5 pm near level 3.",
        "NI number: QQ771646D. Please send it to Flat 27B, 71 Saltpan Avenue, Eastholm. 😀 My SSN is 666-71-5167.",
        "My mail is odalys AT postbarn DOT example, not the old one. We live at 12 Quarrymoor Road.",
        None, "", "Try the Main Street plan with 40 days free.",
    ]
    rows = [(f"m{k}-{i}", x, "phone") for k in range(6) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows + rows[:8], "id string, text string, pii_type string")
    spans = personal.find_personal(df)
    got = {(r.id, r.pii_type, t[int(r.id[3:])][r.start_at - 1 : r.end_at]) for r in spans.collect()}
    want = {
        (0, "name", "Tilda Ironmonk"), (0, "email", "tilda.ironmonk@inkpost.test"), (1, "name", "Corvin Ferncastle"), (1, "phone", "(08) 5550 4629"), (3, "id_number", "QQ771646D"),
        (3, "address", "Flat 27B, 71 Saltpan Avenue"), (3, "id_number", "666-71-5167"), (4, "email", "odalys AT postbarn DOT example"), (4, "address", "12 Quarrymoor Road"),
    }
    assert got == {(f"m{k}-{i}", p, s) for k in range(6) for i, p, s in want}
    red = {r.id: r.redacted for r in personal.redact(df, spans).collect()}
    assert red["m0-1"] == "Mr [NAME] told me to write again. Call [PHONE] after six." and red["m0-5"] is None and red["m0-2"] == t[2]
    assert personal.find_personal(df.limit(0)).count() == 0


def test_label_reliabilities_are_recovered():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < 0.5, 0, np.where(rng.random(4000) < a, 1, -1) * np.where(y, 1, -1)) for a in (0.95, 0.8, 0.6)], 1)
    post, table, share = personal.reliabilities(votes, np.ones(4000))
    good = table[1, :, 2] / (table[1, :, 2] + table[1, :, 0])
    assert good[0] > good[1] > good[2] and abs(share - 0.3) < 0.1


def test_crowding_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    spot = rng.normal(size=64)
    x = np.concatenate([rng.normal(size=(400, 64)), spot + rng.normal(size=(60, 64)) * 0.15])
    rows = [(f"p{i}", v.tolist(), 0) for i, v in enumerate(x)]
    rows += rows[:7] + [("bad", [0.0] * 64, 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, near int")
    u = np.float32(x) / np.linalg.norm(np.float32(x), axis=1, keepdims=True)
    n = (u @ u.T >= 0.9).sum(1) - 1
    want = {f"p{i}": int(k) for i, k in enumerate(n) if k}
    assert {r.id: r.near for r in varied.crowding(df, 64).collect()} == want and len(want) >= 50
    monkeypatch.setattr(varied, "BLOCK", 16)
    assert {r.id: r.near for r in varied.crowding(df, 64).collect()} == want
    assert varied.crowding(df.limit(0), 64).count() == 0


def test_varied_subset_avoids_crowds(spark):
    rng = np.random.default_rng(4)
    groups = [rng.normal(size=64) * 2 for _ in range(20)]
    rows = [(f"v{i}-{g}", (c + rng.normal(size=64) * 0.3).tolist()) for g, c in enumerate(groups) for i in range(400 if g == 0 else 20)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    opts = spark.createDataFrame([(1, 20, 0.5), (2, None, None), (3, 5000, 0.7)], "option_no long, k int, mmr_lambda double")
    got = varied.varied_subset(df, opts, 64).collect()
    one = [r.id for r in got if r.option_no == 1]
    assert len(one) == len(set(one)) == 20 and len({i.split("-")[1] for i in one}) >= 12
    assert sum(r.option_no == 2 for r in got) == 20 and sum(r.option_no == 3 for r in got) == 780
    assert varied.varied_subset(df.limit(0), opts, 64).count() == 0
    assert varied.quotas([(0, 10_000), (1, 100), (2, 3)], 60) == {0: 52, 1: 5, 2: 3} or sum(varied.quotas([(0, 10_000), (1, 100), (2, 3)], 60).values()) == 60


def test_proportional_sample(spark, data, duck):
    items = spark.read.parquet(f"{data}/frame_items.parquet")
    strata = spark.read.parquet(f"{data}/design_strata.parquet")
    sample, report = proportions.proportional_sample(items, strata)
    rep = report.collect()
    assert len(rep) == strata.count() and all(r.drawn <= r.frame_groups and r.floor_met for r in rep)
    assert sum(r.deviation == 0 for r in rep) >= 0.5 * len(rep) and all(r.deviation <= 0 or r.reachable for r in rep)
    per = {(r.design_id, r.stratum): r.n for r in sample.groupBy("design_id", "stratum").agg(F.countDistinct("group_key").alias("n")).collect()}
    assert per == {(r.design_id, r.stratum): r.drawn for r in rep if r.drawn}
    assert proportions.proportional_sample(items.limit(0), strata)[1].filter("frame_groups = 0").count() == strata.count()
    assert proportions.proportional_sample(items, strata.limit(0))[0].count() == 0


def test_swap_repair_reaches_reachable_targets():
    member = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]])
    have, target = np.array([50, 50, 4, 10]), np.array([20, 30, 4])
    take = proportions.repair(member, have, target, np.array([5, 5, 4]), 1)
    assert (take <= have).all() and (member.T @ take == target).all()
    take = proportions.repair(member, have, np.array([20, 30, 10]), np.array([0, 0, 9]), 1)
    assert (member.T @ take).tolist() == [20, 30, 4]  # all there is of the last, and none of its lack elsewhere
    assert proportions.repair(member[:0], have[:0], target, target, 1).sum() == 0


def test_swap_repair_against_every_sample():
    """Small designs: the deviation is that of the best of all samples, or nearly."""
    rng, equal = np.random.default_rng(2), 0
    for _ in range(40):
        member = (rng.random((4, 3)) < 0.5).astype(np.int64)
        have, target = rng.integers(0, 6, 4), rng.integers(0, 8, 3)
        floor = np.minimum(target, 1)
        most = member.T @ have
        every = np.array(list(itertools.product(*(range(h + 1) for h in have)))) @ member
        costs = (np.maximum(np.minimum(floor, most) - every, 0).sum(1)) * 1e12 + ((every - np.minimum(target, most)) ** 2).sum(1)
        got = member.T @ proportions.repair(member, have, target, floor, 5)
        own = np.maximum(np.minimum(floor, most) - got, 0).sum() * 1e12 + ((got - np.minimum(target, most)) ** 2).sum()
        assert own <= costs.min() + 4
        equal += own == costs.min()
    assert equal >= 34


def test_take_by_rank_takes_the_first(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(3000)], "k int, v int")
    quota = spark.createDataFrame([(0, 10), (1, 5000), (2, 0)], "k int, _take long")
    h = F.xxhash64("v")
    got = take_by_rank(df, ["k"], quota, h)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {0: 10, 1: 1000}


def test_packing_never_overfills_and_keeps_everything(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(s)) for i, s in enumerate(rng.integers(1, 400, 600))] + [(1000, 2500), (1001, 1024), (1002, 0)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    cont = spark.createDataFrame([(1, 512), (2, 1024), (3, None)], "container_no long, capacity int")
    out = packing.pack(df, cont, block_items=256)
    bins = out.groupBy("container_no", "bin").agg(F.sum("tokens").alias("t")).join(cont, "container_no")
    assert bins.filter("t > capacity").count() == 0
    total = {r.container_no: r.s for r in out.groupBy("container_no").agg(F.sum("tokens").alias("s")).collect()}
    assert total == {1: sum(s for _, s in sizes), 2: sum(s for _, s in sizes)}
    cut = {(r.container_no, r.doc_id): r.n for r in out.filter("pieces > 1").groupBy("container_no", "doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cut == {(1, 1000): 5, (2, 1000): 3, (1, 1001): 2}
    assert all(r.fill > 0.93 for r in packing.packing_report(out, cont).collect())
    assert packing.pack(df.limit(0), cont).count() == 0 and packing.pack(df, cont.filter("capacity is null")).count() == 0


def triplets(n, seed):
    """Sizes of n full bins of three items each, capacity 1,000: best fit decreasing needs about a sixth more bins."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(380, 491))
        b = int(rng.integers(250, (1000 - a) // 2))
        out += [a, b, 1000 - a - b]
    return rng.permutation(np.array(out))


def test_genetic_packing_beats_best_fit(spark):
    for n in (20, 60):
        sizes = triplets(n, n)
        p = packing.Packer(sizes, 1000, 1)
        plain = p.bins(p.best_fit(np.full(len(sizes), -1, np.int64), np.arange(len(sizes))))
        alone = packing.Packer(sizes, 1000, 1).evolve([], 0)[0]
        best = p.evolve([], 60)[0]
        assert p.bound == n and plain >= 1.15 * n and p.bins(alone) > p.bins(best) and p.bins(best) <= 1.05 * n
        assert (p.load(best) <= 1000).all()
        df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(sizes)], "doc_id long, tokens long")
        packed = packing.pack(df, spark.createDataFrame([(1, 1000)], "container_no long, capacity int"))
        assert packed.count() == len(sizes) and packed.select("bin").distinct().count() <= 1.05 * n
        assert packed.groupBy("bin").agg(F.sum("tokens").alias("t")).filter("t > 1000").count() == 0


def test_random_sizes_come_near_the_bound():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        p = packing.Packer(rng.integers(20, 60, 200), 100, seed)
        plain = p.bins(p.best_fit(np.full(200, -1, np.int64), np.arange(200)))
        best = p.bins(p.evolve([], 30)[0])
        assert best <= plain and best <= p.bound + 2


def test_tokens_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in packing.token_counts(df).collect()} == {1: 0, 2: 0, 3: 2}


def test_leaks_by_stretch(spark):
    rng = random.Random(5)
    item = [rng.choice(WORDS) for _ in range(40)]
    noise = lambda n: [rng.choice(WORDS) + "x" for _ in range(n)]
    part = item[5:33]
    swapped = [*part]
    swapped[6], swapped[13], swapped[20] = "other1", "other2", "other3"
    broken = part[:14] + ["a1", "a2", "a3"] + part[14:]
    d = [
        (1, " ".join(noise(30) + part + noise(30))), (2, "\n- ".join(w.upper() + "," for w in swapped)), (3, " ".join(item[:20] + noise(5))), (4, " ".join(broken)),
        (5, "Customer: " + " ".join(item[:20]) + "\nAgent: " + " ".join(item[20:30])), (6, None), (7, ""), (8, " ".join(item + item)),
    ]
    docs_ = spark.createDataFrame(d + d[:2], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, "")], "item_no long, text string")
    got = {(r.doc_id, r.item_no): (r.stretch, r.matched) for r in leaks.leaks(docs_, items).collect()}
    assert {k for k in got if k[1] == 1} == {(i, 1) for i in (1, 2, 5, 8)} and {k for k in got if k[1] == 2} == {(i, 2) for i in (1, 2, 5, 8)}
    assert got[1, 1] == (28, 28) and got[2, 1] == (28, 25) and got[8, 1] == (40, 40)
    assert leaks.leaks(docs_, items.limit(0)).count() == 0 and leaks.leaks(docs_.limit(0), items).count() == 0


def test_reading_levels(spark, data):
    docs_ = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    graded = spark.read.parquet(f"{data}/graded_passages.parquet")
    m = reading.train(graded, docs_)
    out = reading.reading_levels(docs_, m)
    assert out.count() == docs_.select("doc_id").distinct().count()
    assert out.filter("level is null").count() == docs_.filter("text is null or not text rlike '[A-Za-z0-9]'").count()
    held = graded.filter("grade is not null and passage_no % 4 = 0").select(F.col("passage_no").alias("doc_id"), "text")
    fit = reading.train(graded.filter("passage_no % 4 <> 0"), docs_.limit(0))
    both = reading.reading_levels(held, fit).join(graded.select(F.col("passage_no").alias("doc_id"), F.col("grade").alias("true")), "doc_id")
    assert both.filter(F.abs(F.col("grade") - F.col("true")) <= 2.5).count() >= 0.8 * both.count()
    none = reading.train(graded.limit(0), docs_.limit(0))
    assert none is None and reading.reading_levels(docs_, None).filter("level is not null").count() == 0


def test_reading_models_use_all_documents_and_words(spark):
    """More documents than a sample of 20,000 and more words than 50,000, each with words of its own, against numpy."""
    rng, rows = random.Random(5), []
    common = "the of and to that it is we have by with for".split()
    for i in range(24_000):
        own = [f"q{i}a", f"q{i}b", f"q{i // 2}c"]
        plain = [rng.choice(common) for _ in range(12)] + own
        rng.shuffle(plain)
        rows.append((i, (". " if i % 3 else " ").join(" ".join(plain[k : k + 5]) for k in range(0, 15, 5)) + " banana" * (i % 4)))
    rows += [(24_000, None), (24_001, "!!!"), (24_002, "das ist unbekannt")]
    df = spark.createDataFrame(rows + rows[:500], "doc_id long, text string")
    graded = spark.createDataFrame([("the easy cat", 2), ("of considerable difficulty", 19)], "text string, grade int")
    got = {r.doc_id: r for r in reading.reading_levels(df, reading.train(graded, df)).collect()}
    assert sorted(got) == list(range(24_003))
    level = lambda g: int(np.searchsorted(reading.LEVELS, g))
    seeds = [(re.findall(r"\w+", t.lower()), got[i].formula, 1.0) for i, t in rows if got[i].english] + [(t.split(), g, reading.LABEL_WEIGHT) for t, g in (("the easy cat", 2), ("of considerable difficulty", 19))]
    assert len(seeds) > 20_000
    index = {w: k for k, w in enumerate(sorted({w for ws, *_ in seeds for w in ws}))}
    assert len(index) > reading.VOCABULARY
    n, texts = np.zeros((len(index), 7)), np.zeros(7)
    for ws, g, weight in seeds:
        texts[level(g)] += weight
        np.add.at(n[:, level(g)], [index[w] for w in ws], weight)
    use = np.flatnonzero(n.sum(0))
    base = (n.sum(1) + 1) / (n.sum(1) + 1).sum()
    log = np.log((n[:, use] + reading.PRIOR_WORDS * base[:, None]) / (n[:, use].sum(0) + reading.PRIOR_WORDS))
    unknown = np.log(reading.PRIOR_WORDS / (n.sum(1) + 1).sum() / (n[:, use].sum(0) + reading.PRIOR_WORDS))
    prior = np.log((texts[use] + 1) / (texts[use] + 1).sum())
    for i, t in rows:
        ws = re.findall(r"\w+", (t or "").lower())
        if not ws:
            assert got[i].level is None and got[i].posterior is None
            continue
        s = prior + sum(log[index[w]] if w in index else unknown for w in ws)
        p = np.exp(s - s.max())
        p /= p.sum()
        assert got[i].posterior == pytest.approx(p.max(), abs=1e-9)
        if np.sort(p)[-2] < p.max() - 1e-9:
            assert got[i].level == use[p.argmax()]


def test_reading_words_joined_equal_words_held(spark, data, monkeypatch):
    docs_, graded = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "graded_passages"))
    run = lambda: {r.doc_id: r for r in reading.reading_levels(docs_, reading.train(graded, docs_)).collect()}
    want = run()
    monkeypatch.setattr(reading, "VOCABULARY", 40)
    got = run()
    assert got.keys() == want.keys() and len({r.level for r in want.values()}) > 3
    for i, r in got.items():
        assert (r.level, r.formula, r.english) == (want[i].level, want[i].formula, want[i].english)
        assert (r.posterior, r.expected_grade) == pytest.approx((want[i].posterior, want[i].expected_grade), abs=1e-9)


def test_reading_counts_repeated_rows_once(spark, data):
    docs_, graded = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "graded_passages"))
    want, got = (reading.train(graded, x) for x in (docs_, docs_.unionByName(docs_.filter("doc_id % 3 = 0"))))
    assert (want.keys == got.keys).all() and np.allclose(want.log, got.log) and np.allclose(want.prior, got.prior)


@pytest.mark.parametrize("name", sorted(set(llm.SQL) - {"p5_found"}))
def test_query_equals_sql(name, spark, data, duck):
    from compare import same

    same(llm.QUERIES[name](spark, data), duck, llm.SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_query_runs(name, spark, data):
    df = llm.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def edited(seed, least, most, n=150):
    """Texts and copies with words replaced, inserted and deleted, and with one passage moved, that still reach the threshold."""
    rng, out = random.Random(seed), []
    while len(out) < 2 * n:
        w = rng.sample(WORDS, rng.randint(least, most))
        v = list(w)
        while True:
            u, at, kind = list(v), rng.randrange(len(v)), rng.random()
            u[at : at + (kind < 0.7)] = [rng.choice(WORDS)] * (kind < 0.4 or kind >= 0.7)
            if not like(set(w), set(u)):
                break
            v = u
        if rng.random() < 0.3:
            a, b = sorted(rng.sample(range(len(v)), 2))
            v = v[:a] + v[b:] + v[a:b]
        if v != w:
            out += [" ".join(w), " ".join(v)]
    return out


@pytest.mark.parametrize("least, most", [(8, 20), (20, 40), (40, 120)])
def test_split_overlaps_find_edited_texts(spark, least, most):
    t = edited(least, least, most)
    rec = [(f"r{i:04d}", x, ("train", "test")[i % 2], "sampled") for i, x in enumerate(t)]
    w = [words_of(x) for x in t]
    want = {(rec[i][0], rec[j][0]) for i in range(0, len(t), 2) for j in range(1, len(t), 2) if like(w[i], w[j])}
    e = spark.createDataFrame([], "id string, embedding array<float>")
    pairs = overlaps.split_overlaps(spark.createDataFrame(rec, "id string, text string, role string, kind string"), e, {"train": 0, "test": 1})[0].collect()
    got = {(p.id_0, p.id_1) for p in pairs}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) >= 100


def test_bands_hold_at_the_threshold_itself():
    assert buckets.recall(0.7, near_duplicates.BANDS, near_duplicates.ROWS) > 0.99
    rng, hit, n = np.random.default_rng(4), 0, 600
    for _ in range(n):
        common, a, b = (rng.integers(0, 1 << 60, k) for k in (70, 15, 15))
        flat, off = np.r_[common, a, common, b], np.array([0, 85, 170])
        k = buckets.band_keys(buckets.minhash(flat, off, near_duplicates.BANDS * near_duplicates.ROWS, 0), near_duplicates.BANDS, near_duplicates.ROWS)
        hit += bool((k[0] == k[1]).any())
    assert hit / n > 0.985


def test_repair_ends_where_no_single_move_improves():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        member = (rng.random((220, 20)) < 0.1).astype(np.int64)
        have, target = rng.integers(0, 60, 220), rng.integers(5, 60, 20)
        take = proportions.repair(member, have, target, np.zeros(20, np.int64), 7)
        target = np.minimum(target, member.T @ have)
        got = member.T @ take
        room, free = member[take > 0], member[have > take]
        room, free = np.r_[room, np.zeros((1, 20), np.int64)], np.r_[free, np.zeros((1, 20), np.int64)]
        swapped = got + free[None] - room[:, None]
        assert ((swapped - target) ** 2).sum(-1).min() >= ((got - target) ** 2).sum()
