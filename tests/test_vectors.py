from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.operators import vectors as V
from clipweave.plans.nearest import best_matches

CENTS = [("A", 0, [1.0, 0.0]), ("B", 1, [0.0, 1.0])]
A, WEAK, STRONG = [0.95, 0.31], [0.48, 0.52], [0.05, 0.9986]


def _smooth(spark, embs):
    cents = spark.createDataFrame(CENTS, "label string, ord int, centroid array<double>")
    lines = [(1, i, None if e is None else ("A" if e[0] > e[1] else "B"), e) for i, e in enumerate(embs)]
    df = spark.createDataFrame(lines, "item_id long, ord long, label string, emb array<double>")
    return "".join(r["smoothed"] or "-" for r in V.smooth_labels(df, cents).orderBy("ord").collect())


@pytest.mark.parametrize(("embs", "want"), [
    ([A, A, WEAK, A, A], "AAAAA"),
    ([A, STRONG, A], "ABA"),
    ([A, A, [0.49, 0.51], [0.49, 0.51], A, A, A], "AAAAAAA"),
    ([A, A, [0.46, 0.54], [0.46, 0.54], A, A], "AABBAA"),
    ([STRONG, A], "BA"),
])
def test_smoothing(spark, embs, want):
    assert _smooth(spark, embs) == want


def test_smoothing_over_cells(spark, tiny_cells):
    assert _smooth(spark, [A, A, WEAK, A, A, A, STRONG, A, A, A, A, WEAK, A]) == "AAAAAABAAAAAA"


def _pool(spark, n, seed=0, project=0):
    rng = np.random.default_rng(seed)
    rows = [(project, i, f"c{i}", [], [float(x) for x in rng.normal(size=4)], 1) for i in range(n)]
    return spark.createDataFrame(rows, "project_id long, ord long, char_id string, labels array<string>, emb array<double>, emb_count int")


def test_blocked_matches_equal_shipped(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(
        [(i, i % 3, f"c{i}", [float(x) for x in rng.normal(size=4)] if i % 9 else None) for i in range(50)],
        "rid long, project_id long, cur string, emb array<double>")
    pool = _pool(spark, 23).unionByName(_pool(spark, 7, 1, 1))
    get = lambda: {
        r["rid"]: (None if r["matches"] is None else [(m["char_id"], round(m["sim"], 9)) for m in r["matches"]], r["current_sim"] and round(r["current_sim"], 9))
        for r in best_matches(rows, pool, keys=["project_id"], k=3, current="cur").collect()}
    shipped = get()
    spark.conf.set("clipweave.poolValues", "1")
    spark.conf.set("clipweave.poolBlock", "5")
    spark.conf.set("clipweave.matchGroup", "4")
    try:
        blocked = get()
    finally:
        for k in ("poolValues", "poolBlock", "matchGroup"):
            spark.conf.unset(f"clipweave.{k}")
    has = {k: v for k, v in shipped.items() if v[0] is not None}
    assert len(has) > 20 and all(blocked[k] == v for k, v in has.items())


def test_silhouette_of_named_labels_on_both_paths(spark):
    from clipweave.operators.vectors import silhouette

    rows = spark.createDataFrame(
        [(1, "anna", [1.0, 0.0]), (1, "anna", [0.9, 0.1]), (1, "ben", [0.0, 1.0]), (1, "ben", [0.1, 0.9])],
        "project_id long, label string, emb array<double>")
    shipped = silhouette(rows, ["project_id"]).first()["silhouette"]
    spark.conf.set("clipweave.poolValues", "1")
    try:
        blocked = silhouette(rows, ["project_id"]).first()["silhouette"]
    finally:
        spark.conf.unset("clipweave.poolValues")
    assert shipped > 0.9 and abs(shipped - blocked) < 1e-12


def test_feedback_requests_keep_every_sample(spark):
    from clipweave.operators.segments import clean_samples

    raw = spark.createDataFrame([(i, "a", f"s{i % 7}", "c", "0", "1") for i in range(45)] + [(99, "a", "s1", "c", "x", "1")],
                                "ord long, item_id string, seg_id string, character_id string, start string, end string")
    got = [(r.batch_no, r.seg_id, r.ord) for r in clean_samples(raw).collect()]
    want = {(b, f"s{i % 7}"): i for b in (2, 1, 0) for i in reversed(range(20 * b, min(20 * b + 20, 45)))}
    assert sorted(got) == sorted((b, s, i) for (b, s), i in want.items())


@pytest.mark.parametrize("mode", ["strong", "weak", "gap"])
def test_matching_in_order_equals_brute_force(spark, mode):
    rng = np.random.default_rng(2)
    pool = _pool(spark, 30, 4)
    base = {r["char_id"]: np.array(r["emb"]) for r in pool.collect()}
    vecs = [base[f"c{i % 4}"] + rng.normal(scale=0.25, size=4) for i in range(12)]
    labels = spark.createDataFrame([(0, i, f"s{i}", f"p:s{i}", [float(x) for x in v]) for i, v in enumerate(vecs)],
                                   "project_id long, ord long, label string, label_key string, emb array<double>")
    thr = 0.82 if mode == "weak" else 0.80
    got = {r["label"]: r["char_id"] for r in V.match_in_order(labels, pool, mode=mode, threshold=thr).filter("how <> 'pool'").collect()}
    known = [[k, v.copy(), 1] for k, v in base.items()]
    want = {}
    for i, v in enumerate(vecs):
        cos = [float(v @ k[1] / (np.linalg.norm(v) * np.linalg.norm(k[1]))) for k in known]
        order = np.argsort([-c for c in cos], kind="stable")
        best, lead = cos[order[0]], cos[order[0]] - cos[order[1]]
        if best >= thr and (mode == "weak" or lead >= 0.05):
            k = known[order[0]]
            k[1], k[2] = (k[1] * k[2] + v) / (k[2] + 1), k[2] + 1
            want[f"s{i}"] = k[0]
        elif mode == "weak":
            known.append([f"char_p:s{i}", v, 1])
            want[f"s{i}"] = f"char_p:s{i}"
        else:
            want[f"s{i}"] = None
    assert got == want


@pytest.mark.parametrize("mode", ["weak", "gap"])
def test_matching_streams_through_a_fold(spark, mode):
    rng = np.random.default_rng(4)
    pool = _pool(spark, 6, 4)
    base = [np.array(r["emb"]) for r in pool.orderBy("ord").collect()]
    vecs = [base[i % 3] + rng.normal(scale=0.4, size=4) for i in range(40)]
    labels = spark.createDataFrame([(0, i, f"s{i}", f"p:s{i % 30}", [float(x) for x in v]) for i, v in enumerate(vecs)],
                                   "project_id long, ord long, label string, label_key string, emb array<double>")

    def got(**conf):
        for k, v in conf.items():
            spark.conf.set(k.replace("__", "."), v)
        try:
            out = V.match_in_order(labels, pool, mode=mode)
            plan = out._jdf.queryExecution().toString()
            return {(r.ord, r.char_id): (r.how, r.sim, r.emb, r.emb_count) for r in out.collect()}, "CoGroup" in plan
        finally:
            for k in conf:
                spark.conf.unset(k.replace("__", "."))

    want, grouped = got(clipweave__poolValues="1")
    assert grouped and sum(how == "match" for how, *_ in want.values()) > 10
    streamed, grouped = got(spark__sql__execution__arrow__maxRecordsPerBatch="3")
    assert not grouped and streamed == want
    assert got(clipweave__rowsPerCell="10")[0] == want


def test_gap_candidates_use_the_whole_vector_table(spark):
    from clipweave.catalog.voices import gap_vectors

    vectors = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("emb"))
    cands = spark.range(4000).select((F.col("id") % 7).alias("item_id"), (F.col("id") * 500).alias("start_ms"))
    got = [r.emb[0] for r in gap_vectors(cands, vectors).collect()]
    assert len(got) == 4000 and len(set(got)) > 900 and max(got) > 950


def _voices(spark, per, seed=0):
    rng = np.random.default_rng(seed)
    out, o = [], 0
    for k in range(4):
        for _ in range(per):
            v = rng.normal(scale=0.05, size=8)
            v[k] += 1
            out.append((0, o, k, [float(x) for x in v]))
            o += 1
    return spark.createDataFrame(out, "project_id long, ord long, voice int, emb array<double>")


@pytest.mark.parametrize("exact", [2000, 25])
def test_clusters_follow_voices(spark, exact):
    got = V.cluster_lines(_voices(spark, 20), ["project_id"], exact_lines=exact)
    pairs = {(r["voice"], r["cluster"]) for r in got.collect()}
    assert len(pairs) == 4 and {c for _, c in pairs} == {0, 1, 2, 3}


def test_clusters_are_the_same_in_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(11)
    rows = []
    for project, noise, sizes in ((0, 0.45, (50, 40, 4, 2)), (1, 0.9, (30, 30, 30)), (2, 0.1, (6, 5)), (3, 3.0, (70,))):
        vecs = [np.eye(8)[k] + rng.normal(scale=noise / 2, size=8) for k, n in enumerate(sizes) for _ in range(n)]
        vecs += [vecs[0]] * 15  # equal lines
        rows += [(project, i, [float(x) for x in vecs[j]]) for i, j in enumerate(rng.permutation(len(vecs)))]
    lines = spark.createDataFrame(rows, "project_id long, ord long, emb array<double>")
    get = lambda most: {(r.project_id, r.ord): r.cluster for r in V.cluster_lines(lines, ["project_id"], exact_lines=most).collect()}
    want = {}
    for p in range(4):
        own = [(o, np.array(v) / np.linalg.norm(v)) for q, o, v in sorted(rows, key=lambda r: r[:2]) if q == p]
        lab = V.choose_clusters(np.stack([v for _, v in own]), np.ones(len(own)), 15, 3, 0.60, 0.95)
        want |= {(p, o): int(c) for (o, _), c in zip(own, lab, strict=True)}
    assert get(2000) == want
    assert get(20) == want


def test_equal_distances_give_the_same_clusters_on_both_routes(spark):
    rng = np.random.default_rng(12)
    rows = []
    for project in range(8):  # few different directions, so that most distances tie
        vecs = rng.integers(0, 2, (40, 5)) * 2 - 1 if project % 2 else np.eye(8)[rng.integers(0, 8, 40)] + np.eye(8)[rng.integers(0, 8, 40)]
        rows += [(project, i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    lines = spark.createDataFrame(rows, "project_id long, ord long, emb array<double>")
    get = lambda most: {(r.project_id, r.ord): r.cluster for r in V.cluster_lines(lines, ["project_id"], exact_lines=most).collect()}
    want = get(2000)
    spark.conf.set("clipweave.poolBlock", "5")
    try:
        assert get(14) == want  # a few tiles
    finally:
        spark.conf.unset("clipweave.poolBlock")


def test_tree_of_rounds_equals_the_chain(spark):
    rng = np.random.default_rng(13)
    vecs = rng.integers(-2, 3, (90, 4)).astype(float)
    vecs = np.unique(vecs[np.abs(vecs).sum(axis=1) > 0] / np.linalg.norm(vecs[np.abs(vecs).sum(axis=1) > 0], axis=1, keepdims=True), axis=0)
    units = spark.createDataFrame([(0, i, [float(x) for x in v], 1.0) for i, v in enumerate(vecs)], "project_id long, ord long, s array<double>, n double")
    heights, joins = V.average_linkage(vecs, np.ones(len(vecs)))
    want = sorted((b, a, round(h, 9)) for h, (a, b) in zip(heights, joins, strict=True))
    for most in (8,):
        got = sorted((r.ord, r.parent, round(r.h, 9)) for r in V.linkage_tree(units, ["project_id"], most).collect())
        assert got == want


def _tree(spark, units, most, block=None):
    if block:
        spark.conf.set("clipweave.poolBlock", str(block))
    try:
        return sorted((r.ord, r.parent, round(r.h, 9)) for r in V.linkage_tree(units, ["project_id"], most).collect())
    finally:
        spark.conf.unset("clipweave.poolBlock")


def test_rounds_of_tiles_and_rounds_in_a_task_give_the_same_tree(spark, monkeypatch):
    rng = np.random.default_rng(16)
    noisy = rng.normal(size=(120, 6)) + np.eye(6)[rng.integers(0, 3, 120)]
    tied = np.unique(rng.integers(-1, 2, (90, 4)).astype(float), axis=0)
    tied = rng.permutation(tied[np.abs(tied).sum(axis=1) > 0])
    rows, want = [], []
    for p, vecs in enumerate((noisy, tied, noisy[:9])):
        vecs = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        n = rng.integers(1, 4, len(vecs)).astype(float)
        sums = vecs * n[:, None]
        heights, joins = V.average_linkage(sums, n, len(n))  # one merge at a time
        for most in (1, 7):
            other, pairs = V.average_linkage(sums, n, most)
            assert sorted(zip(pairs, np.round(other, 9))) == sorted(zip(joins, np.round(heights, 9)))
        want += [(1000 * p + b, 1000 * p + a, round(h, 9)) for h, (a, b) in zip(heights, joins, strict=True)]
        rows += [(p, 1000 * p + i, [float(x) for x in s], float(k)) for i, (s, k) in enumerate(zip(sums, n))]
    units = spark.createDataFrame(rows, "project_id long, ord long, s array<double>, n double")
    assert _tree(spark, units, 8, 8) == sorted(want)
    # groups that fit a tile need no rounds of joins
    monkeypatch.setattr(V, "nearest_in_tiles", lambda *_: pytest.fail("a round of joins"))
    assert _tree(spark, units, 8) == sorted(want)


def test_tiles_are_as_large_as_a_task_can_hold(spark):
    rng = np.random.default_rng(17)
    vecs = rng.normal(size=(9000, 3))
    units = spark.createDataFrame(
        [(0, i, [float(x) for x in v], 1.0) for i, v in enumerate(vecs / np.linalg.norm(vecs, axis=1, keepdims=True))],
        "project_id long, ord long, s array<double>, n double")
    wide = units.agg(V._tile_rows(spark), F.count(F.lit(1))).first()
    assert wide[0] >= wide[1]  # one block a side, so every row is shuffled once
    got = {r.ord: (r.parent, r.sim) for r in V.nearest_in_tiles(units.filter("ord % 100 = 0"), units, ["project_id"]).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for o in range(0, 9000, 100):
        sims = np.round(u @ u[o], V.DIGITS)
        sims[o] = -1
        assert got[o][0] == sims.argmax() and abs(got[o][1] - sims.max()) < 1e-11


def test_nearest_takes_the_first_of_equals_and_not_one_that_is_only_close():
    pool = np.array([[1 - 4e-13], [1 - 6e-13], [1.0], [1.0], [0.5]])
    first, sim = V._nearest(np.ones((3, 1)), pool, np.array([-1, 0, 2]))
    want = np.round(pool[:, 0], V.DIGITS)
    assert first.tolist() == [int(np.flatnonzero(want == 1)[0]), 2, int(np.flatnonzero(want == 1)[0])] and set(sim) == {1.0}


def test_equal_vectors_are_found_by_digest(spark):
    vecs = [[0.0, 1.0, 0.0], [-0.0, 1.0, 0.0], [0.0, 2.0, 0.0], [1.0, 0.0, 0.0], None, [1.0, 0.0, 1e-7], [0.0, 1.0, 0.0]]
    lines = spark.createDataFrame([(p, i, v) for p in (0, 1) for i, v in enumerate(vecs)], "project_id long, ord long, emb array<double>")
    got = V.cluster_lines(lines, ["project_id"])
    found = {(r.project_id, r.ord): r.cluster for r in got.collect()}
    assert [[found[p, i] for i in range(7)] for p in (0, 1)] == [[0, 0, 0, 1, None, 1, 0]] * 2
    # no shuffle is keyed by whole vectors
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not re.search(r"hashpartitioning\([^)]*emb#", plan)


def test_a_name_that_comes_twice_ends_as_one_cluster(spark):
    rng = np.random.default_rng(18)
    vecs = np.eye(4)[rng.integers(0, 4, 60)] + rng.normal(scale=0.05, size=(60, 4))
    lines = spark.createDataFrame([(0, i % 50, [float(x) for x in v]) for i, v in enumerate(vecs)], "project_id long, ord long, emb array<double>")
    get = lambda: {(r.ord, r.cluster) for r in V.cluster_lines(lines, ["project_id"], exact_lines=12).collect()}
    spark.conf.set("clipweave.poolBlock", "7")
    try:
        tiles = get()
    finally:
        spark.conf.unset("clipweave.poolBlock")
    assert tiles == get() and {o for o, _ in tiles} == set(range(50))


def _talks(projects):
    """Cues of one voice with three windows each; every project has voices and items of its own, item ids are shared."""
    rng = np.random.default_rng(14)
    out = []
    for p in projects:
        voices = np.eye(8)[rng.permutation(8)[: 3 + p % 3]] + rng.normal(scale=0.05, size=(3 + p % 3, 8))
        for item in range(2):
            for cue in range(12):
                who = voices[(cue // 2 + item) % len(voices)]
                out += [(p, item, cue, cue * 3000 + k * 500, cue * 3000 + k * 500 + 1400, [float(x) for x in who + rng.normal(scale=0.03, size=8)]) for k in range(3)]
    return out


def test_projects_are_identified_as_if_alone(spark):
    from clipweave.plans.identify import identify

    rows = _talks([1, 2, 5])
    schema = "project_id long, item_id long, ord long, ws long, we long, emb array<double>"

    def run(some):
        windows = spark.createDataFrame(some, schema)
        cues = windows.groupBy("project_id", "item_id", "ord").agg(F.min("ws").alias("start_ms"), F.max("we").alias("end_ms"))
        got = identify(cues, windows)
        return {tuple(r) for r in got.lines.collect()}, {tuple(r) for r in got.turns.collect()}

    lines, turns = run(rows)
    alone = [run([r for r in rows if r[0] == p]) for p in (1, 2, 5)]
    assert lines == set().union(*(a for a, _ in alone)) and turns == set().union(*(t for _, t in alone))
    speakers = {p: {r[5] for r in lines if r[0] == p} for p in (1, 2, 5)}
    assert {p: len(s) for p, s in speakers.items()} == {1: 4, 2: 5, 5: 5} and all("speaker1" in s for s in speakers.values())


def test_smoothing_equals_the_full_step(spark):
    rng = np.random.default_rng(15)
    cents = [(p, f"v{k}", k, [float(x) for x in rng.normal(size=4)]) for p, n in ((0, 2), (1, 5)) for k in range(n)]
    lines = [(p, i, o, None, [float(x) for x in rng.normal(size=4)] if o % 7 else None) for p in (0, 1) for i in (0, 1) for o in range(15)]
    got = V.smooth_labels(
        spark.createDataFrame(lines, "project_id long, item_id long, ord long, label string, emb array<double>"),
        spark.createDataFrame(cents, "project_id long, label string, ord long, centroid array<double>"),
        0.2, item=("project_id", "item_id"), project=("project_id",))
    found = {(r.project_id, r.item_id, r.ord): r.smoothed for r in got.collect()}
    for p in (0, 1):
        names, c = [x[1] for x in cents if x[0] == p], np.stack([np.array(x[3]) / np.linalg.norm(x[3]) for x in cents if x[0] == p])
        for i in (0, 1):
            rows = [(o, np.array(e)) for q, j, o, _, e in lines if (q, j) == (p, i) and e is not None]
            step = np.full((len(c), len(c)), -0.2)
            np.fill_diagonal(step, 0)
            v, back = None, []
            for _, e in rows:
                sims = c @ (e / np.linalg.norm(e))
                via = (v[:, None] + step) if v is not None else None
                back.append(via.argmax(axis=0) if v is not None else None)
                v = sims if v is None else sims + via.max(axis=0)
            at, path = int(v.argmax()), []
            for b in reversed(back):
                path.append(at)
                at = int(b[at]) if b is not None else at
            assert [found[p, i, o] for o, _ in rows] == [names[k] for k in reversed(path)]


def test_cluster_edge_sizes(spark):
    one = spark.createDataFrame([(0, 0, [1.0, 0.0])], "project_id long, ord long, emb array<double>")
    assert [r["cluster"] for r in V.cluster_lines(one, ["project_id"]).collect()] == [0]
    assert len(V.choose_clusters(np.zeros((0, 2)), np.zeros(0), 15, 3, 0.6, 0.95)) == 0


def test_cluster_count_is_capped():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert V.choose_clusters(x, np.ones(60), 15, 3, 0.6, 0.95).max() < 15


def test_absorb_replaces_an_empty_centroid(spark):
    pool = spark.createDataFrame([(0, "a", [1.0, 0.0], 1), (0, "b", None, 0), (0, "c", [1.0, 1.0], 4)],
                                 "project_id long, char_id string, emb array<double>, emb_count int")
    smp = spark.createDataFrame([(0, "a", [0.0, 1.0]), (0, "b", [2.0, 2.0]), (0, "zz", [9.0, 9.0])], "project_id long, char_id string, emb array<double>")
    got = {r["char_id"]: (list(r["emb"]), r["emb_count"]) for r in V.absorb_samples(pool, smp, ["project_id"]).collect()}
    assert got == {"a": ([0.5, 0.5], 2), "b": ([2.0, 2.0], 1), "c": ([1.0, 1.0], 4)}


def test_wire_format_round_trip(spark):
    from clipweave.functions.vectors import decode_vector, encode_vector

    df = spark.createDataFrame([([1.5, -2.0],)], "v array<float>").select(encode_vector("v").alias("w"))
    back = df.select("w", decode_vector("w").alias("v"), decode_vector(F.lit("not base64!")).alias("bad")).first()
    assert back["w"] == "AADAPwAAAMA=" and list(back["v"]) == [1.5, -2.0] and back["bad"] is None
