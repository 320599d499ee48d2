"""Nearest neighbours, near duplicates, hashes and history-dependent choice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import vectors
from cadenza.operators import duplicates, knn, matching, palette, selection, vectorops


def frame(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 6)), 2)
    x[100:180] = x[7]  # a third of the rows are copies of one vector
    return x


@pytest.mark.parametrize("few,cells,block", [(False, None, 50_000), (False, None, 20), (True, None, 50_000), (True, 9, 20)])
def test_exact_search(spark, points, few, cells, block):
    found = knn.search(frame(spark, points[:40], "query_id"), frame(spark, points), 5, few_dimensions=few, cells=cells, block_rows=block, query_rows=16)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(40):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        assert [got[q][k] for k in range(1, 6)] == list(np.lexsort((np.arange(len(points)), d))[:5])


def test_search_with_exclusions_and_other_metric(spark, points):
    own = spark.createDataFrame([(i, i) for i in range(20)], "query_id long, vec_id long")
    q, items = frame(spark, points[:20], "query_id"), frame(spark, points)
    for ways in ({"exclude": own}, {"exclude": own, "few_dimensions": True}, {"skip": lambda a, b: a["query_id"] == b["vec_id"], "block_rows": 50}):
        found = knn.search(q, items, 1, **ways).collect()
        assert len(found) == 20
        for r in found:
            d = np.sqrt(((points - points[r.query_id]) ** 2).sum(1))
            d[r.query_id] = np.inf
            assert r.vec_id == int(np.argmin(d))
    x = points[:, :4]
    emo = knn.search(frame(spark, x[:20], "query_id"), frame(spark, x), 1, few_dimensions=True, metric=palette.EMOTION_METRIC)
    for r in emo.collect():
        assert r.vec_id == int(np.argmin(palette._emotion_row(x[r.query_id], x)))


def test_approximate_search_recall(spark):
    x = np.random.default_rng(1).normal(size=(600, 8))
    q, items = frame(spark, x[:50], "query_id"), frame(spark, x)
    exact = {(r.query_id, r.vec_id) for r in knn.search(q, items, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in knn.search(q, items, 10, probes=10).collect()}
    assert len(exact & near) / len(exact) > 0.8


def test_clustered_vectors_need_few_of_the_items(spark):
    rng = np.random.default_rng(21)
    middle = rng.normal(size=(40, 32)) * 3
    x = middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.6
    items, q = frame(spark, x), frame(spark, x[rng.permutation(4000)[:300]] + 0.01, "query_id")
    truth = {(r.query_id, r.vec_id) for r in knn.search(q, items, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in knn.search(q, items, 10, recall=0.95).collect()}
    assert len(truth & found) / len(truth) >= 0.9
    placed, table = knn.build_cells(items, "vec_id", "embedding", knn.Metric(), None, True)
    asked = q.withColumn("_k", F.lit(10).cast("bigint"))
    probes = knn.probes_for(asked, placed, table, 0.95, "query_id", "vec_id", "embedding", knn.Metric(), None, ())
    visited = sum(int(table.counts[r["_cell"]]) for r in knn.route(asked, "embedding", table, knn.Metric(), probes).select("_cell").collect())
    assert table.counts.sum() == 4000 and visited / (300 * 4000) < 0.2
    exact = {(r.vec_id, r.other) for r in vectorops.similar_items(items, 5).collect()}
    near = {(r.vec_id, r.other) for r in vectorops.similar_items(items, 5, recall=0.97).collect()}
    assert len(exact & near) / len(exact) >= 0.9 and all(a != b for a, b in near)


def test_copies_of_a_hash_are_rows_of_a_class(spark):
    rng = np.random.default_rng(13)
    bits = ["".join(map(str, r)) for r in rng.integers(0, 2, (30, 64))]
    bits += ["".join("1" if c == "0" and i < 2 else c for i, c in enumerate(b)) for b in bits[:10]]
    rows = [(i, b) for i, b in enumerate(bits)] + [(1000 + i, bits[3]) for i in range(500)] + [(5000, None), (5001, "101")]
    members, pairs = duplicates.hamming_classes(spark.createDataFrame(rows, "clip_id long, bits string"), "clip_id", "bits", 4)
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    known = [(i, b) for i, b in rows if b and len(b) == 64]
    lowest = {b: min(i for i, c in known if c == b) for _, b in known}
    got = {r.clip_id: (r.class_id, r.n_copies, r.n_near) for r in members.collect()}
    assert got == {i: (lowest[b], sum(c == b for _, c in known), sum(far(b, c) <= 4 for _, c in known) - 1) for i, b in known}
    assert {(r.class_id, r.other, r.distance) for r in pairs.collect()} == {(lowest[a], lowest[b], far(a, b)) for a in lowest for b in lowest if a != b and far(a, b) <= 4}


def test_places_among_unused_ranks():
    rng = np.random.default_rng(4)
    used = set(rng.choice(5000, 700, replace=False).tolist())
    ranks = selection.Unused(5000, used)
    for _ in range(1500):
        left = [r for r in range(5000) if r not in used] if len(used) % 300 == 0 else None
        place = int(rng.integers(5000 - len(used)))
        pick = ranks.at(place)
        assert pick not in used and (left is None or pick == left[place])
        used.add(pick)
        ranks.take(pick)
    assert selection.Unused(3, {0, 2}).at(0) == 1


def test_two_levels_place_every_row(spark):
    x = np.random.default_rng(2).normal(size=(500, 3))
    x[:200] = x[0]
    centres = knn.two_levels(x, 20)
    assert centres.first[-1] == len(centres.points) <= 40 and len(centres.tops) <= 4
    cell, gap = centres.nearest(x, knn.Metric())
    assert np.allclose(gap, np.sqrt(((x - centres.points[cell]) ** 2).sum(1)), atol=1e-6)
    assert len(knn.two_levels(np.ones((9, 2)), 5).points) == 1


def test_bad_vectors_are_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.withColumnRenamed("vec_id", "query_id")
    for few in (False, True):
        got = {(r.query_id, r.vec_id) for r in knn.search(asked, df, 2, few_dimensions=few).collect()}
        assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (5, 5), (5, 1)}
    assert {r.vec_id for r in knn.rejected(df, "vec_id", "embedding", 2).collect()} == {2, 3, 4, 6}
    assert knn.search(asked, df.filter("vec_id < 0"), 2).count() == 0 and knn.search(asked.filter("query_id < 0"), df, 2, few_dimensions=True).count() == 0
    assert {r.vec_id for r in duplicates.near_duplicate_groups(df, threshold=0.9).collect()} == {0, 1}


def test_copies_with_changes_meet_in_tables(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 32))
    x[600:] = x[:300] + rng.normal(size=(300, 32)) * 0.2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    want = {(int(p), int(q)) for p, q in zip(a, b, strict=True)}
    got = {(r.component, r.vec_id) for r in duplicates.near_duplicate_groups(frame(spark, x), threshold=0.95).collect() if r.component != r.vec_id}
    assert len(want) > 200 and got == want


@pytest.mark.parametrize("n,share", [(10_000, 0.6), (1_000_000, 0.05), (1_000_000_000, 0.0001)])
def test_tables_compare_a_falling_share_of_pairs(n, share):
    bits = max(8, int(np.ceil(np.log2(n + 1))) - 6)
    assert duplicates.tables_for(0.95, 0.9999, bits) / 2**bits < share


def test_bands_follow_from_the_work():
    assert duplicates.bands_for(2_000, 64, 16) == 0
    assert duplicates.bands_for(100_000_000, 64, 10) in (3, 4)
    assert duplicates.bands_for(100_000_000, 256, 10) > 0


@pytest.mark.parametrize("recall", [None, 0.9999])
def test_near_duplicate_groups(spark, points, recall):
    got = {r.vec_id: r.component for r in duplicates.near_duplicate_groups(frame(spark, points), threshold=0.9, recall=recall).collect()}
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    label = np.arange(len(u))
    linked = u @ u.T >= 0.9
    for _ in range(len(u)):
        fresh = np.array([label[linked[i]].min() for i in range(len(u))])
        if (fresh == label).all():
            break
        label = fresh
    size = np.bincount(label, minlength=len(u))
    assert got == {i: int(label[i]) for i in range(len(u)) if size[label[i]] > 1}


def test_components_of_a_long_path(spark):
    nodes = spark.range(40)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    got = {r.id: r.component for r in duplicates.connected_components(nodes, edges).collect()}
    assert got == {i: (0 if i <= 30 else i) for i in range(40)}


def test_hamming_edges(spark):
    df = spark.createDataFrame([("0f", "0e"), ("0f", None), ("0f", "0ff"), ("ff", "00")], "a string, b string")
    a, b = duplicates.bits_of_hex(F.col("a")), duplicates.bits_of_hex(F.col("b"))
    assert [r.d for r in df.select(duplicates.hamming(a, b).alias("d")).collect()] == [1, -1, -1, 8]


@pytest.mark.parametrize("total,limit,bands", [(64, 6, 0), (64, 6, 7), (64, 6, 3), (64, 3, 2), (256, 10, 5), (256, 10, None)])
def test_hamming_join_at_the_threshold(spark, total, limit, bands):
    rng = random.Random(3)
    base = [[rng.choice("01") for _ in range(total)] for _ in range(30)]
    for flips in range(1, limit + 4):
        near = base[0][:]
        for i in rng.sample(range(total), flips):
            near[i] = "1" if near[i] == "0" else "0"
        base.append(near)
    bits = ["".join(b) for b in base] + ["".join(base[0])] * 5 + ["01"]
    df = spark.createDataFrame(list(enumerate(bits)), "clip_id long, bits string")
    out = duplicates.hamming_neighbours(df, df, "clip_id", "bits", limit, total, bands=bands, hot=2, block_rows=11)
    got = {(r.clip_id, r.other): r.distance for r in out.collect()}
    want = {}
    for i, a in enumerate(bits[:-1]):
        for j, b in enumerate(bits[:-1]):
            d = sum(x != y for x, y in zip(a, b))
            if i != j and d <= limit:
                want[(i, j)] = d
    assert got == want


def test_copies_of_a_hash_are_rows_not_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("01") for _ in range(64)) for _ in range(20)]
    base.append(base[0][:30] + ("1" if base[0][30] == "0" else "0") + base[0][31:])
    rows = [(100 * c + i, b) for i, b in enumerate(base) for c in range(30)]
    df = spark.createDataFrame(rows, "clip_id long, bits string")
    for bands in (0, 4):
        out = duplicates.hamming_links(df, "clip_id", "bits", 10, bands=bands, block_rows=7)
        got = {(r.clip_id, r.other, r.distance) for r in out.collect()}
        assert got == {(0, 20, 1), (20, 0, 1)} | {(100 * c + i, i, 0) for i in range(21) for c in range(1, 30)}


def test_banded_hashes_are_not_repeated_for_every_change(spark):
    df = spark.range(500).selectExpr("id AS clip_id", "lpad(conv(xxhash64(id), 10, 2), 64, '0') AS bits")
    plan = duplicates.hamming_neighbours(df, df, "clip_id", "bits", 10, bands=4)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan and "_salt" not in plan


def test_best_by_emotion_searches_equal_clips_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(size=(12, 4)), 1)[rng.integers(12, size=900)]
    clips, targets = frame(spark, x, "clip_id"), frame(spark, np.round(rng.uniform(size=(15, 4)), 1), "target_id")
    offered = []
    search = knn.search
    monkeypatch.setattr(knn, "search", lambda q, items, *a, **kw: (offered.append(items.count()), search(q, items, *a, **kw))[1])
    got = {(r.target_id, r["rank"]): r.clip_id for r in palette.best_by_emotion(targets, clips, 2).collect()}
    assert offered == [2 * len(np.unique(x, axis=0))]
    for t in targets.collect():
        d = palette._emotion_row(np.array(t.embedding), x)
        assert [got[t.target_id, k] for k in (1, 2)] == list(np.lexsort((np.arange(len(x)), d))[:2])


def test_vector_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, [float("nan"), 1.0])], "i long, v array<double>")
    out = {r.i: (r.ok, r.u) for r in df.select("i", vectors.valid(F.col("v"), 2).alias("ok"), vectors.unit(F.col("v")).alias("u")).collect()}
    assert out[1] == (True, [0.0, 0.0]) and out[2] == (True, [0.6, 0.8]) and not out[3][0] and not out[4][0]


def test_imputed_vectors_are_repeatable(spark):
    rows = [tuple(r.v) for r in spark.range(20).select(vectors.imputed_vector(F.col("id")).alias("v")).collect()]
    again = [tuple(r.v) for r in spark.range(20).repartition(7).orderBy("id").select(vectors.imputed_vector(F.col("id")).alias("v")).collect()]
    assert rows == again and all(len(v) == 27 and sum(v[2:7]) == 1 and 2 <= sum(v[7:21]) <= 5 and sum(v[24:]) == 1 for v in rows)


def test_mmr_against_the_loop(spark, points):
    items = frame(spark, points)
    steps = spark.createDataFrame([(i % 2, i, [float(v) for v in points[i]]) for i in range(30)], "track_id long, query_id long, embedding array<double>")
    ranked = knn.search(steps.select("query_id", "embedding"), items, 9)
    cuts = selection.with_candidates(steps.select("track_id", "query_id"), ranked, items, "query_id", "vec_id")
    got = {r.query_id: r.picked for r in selection.select_mmr(cuts, ["track_id"], ["query_id"], window=4, top_k=5).collect()}
    for track in (0, 1):
        history = []
        for q in range(track, 30, 2):
            d = np.sqrt(((points - points[q]) ** 2).sum(1))
            free = [c for c in np.lexsort((np.arange(len(points)), d)) if c not in history[-4:]][:5]

            def score(c, d=d):
                past = [np.linalg.norm(points[c] - points[h]) for h in history[-4:]]
                spread = min(1.0, float(np.mean(past)) / 5.0) if past else 1.0
                return 0.6 * (1 - min(1.0, d[c] / 5.0)) + 0.4 * spread
            pick = max(free, key=lambda c: round(score(c), 12))
            assert abs(score(got[q]) - score(pick)) < 1e-9
            history.append(got[q])


@pytest.mark.parametrize("batch", [7, 10_000])
def test_candidates_are_streamed_to_the_two_stage_choice(spark, points, batch):
    items = frame(spark, points).withColumn("emotion", F.lit(0.5))
    steps = spark.createDataFrame([(i % 2, i, [float(v) for v in points[i]]) for i in range(30)], "track_id long, query_id long, embedding array<double>")
    ranked = knn.search(steps.select("query_id", "embedding"), items, 12)
    steps = steps.unionByName(spark.createDataFrame([(1, 99, [0.0] * 6)], steps.schema))
    cuts = selection.with_candidates(steps.select("track_id", "query_id"), ranked, items, "query_id", "vec_id", extra=["emotion"])
    # a list of candidates with their vectors would have to be held for each cut of a list
    assert "collect_list" not in cuts._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.query_id: (r.picked, r.score) for r in selection.select_two_stage(cuts, ["track_id"], ["query_id"], fine_k=4, window=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 31 and got[99] == (None, 0.5)
    for track in (0, 1):
        used = []
        for q in range(track, 30, 2):
            d = np.sqrt(((points - points[q]) ** 2).sum(1))
            free = [c for c in np.lexsort((np.arange(len(points)), d))[:12] if c not in used][:4]
            top = max(0.001, max(d[c] for c in free))

            def score(c, d=d, top=top):
                gaps = [np.linalg.norm(points[c] - points[h]) for h in used[-3:]]
                diversity, continuity = (min(1.0, min(gaps) / 3), max(0.0, 1 - gaps[-1] / 5)) if gaps else (1.0, 0.5)
                return 0.35 * (1 - d[c] / top) + 0.25 * diversity + 0.25 * 0.5 + 0.15 * continuity
            best = max(score(c) for c in free)
            assert got[q][0] in free and abs(got[q][1] - best) < 1e-9 and abs(score(got[q][0]) - best) < 1e-9
            used.append(got[q][0])


def test_unit_vectors_sum_their_norm_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, None])], "i long, v array<double>")
    out = df.select("i", vectors.unit(F.col("v")).alias("u"))
    assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert {r.i: r.u for r in out.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [3.0, None]}


def test_diverse_selection_resets_and_falls_back(spark):
    rows = [(1, i, [0, 1], 4) for i in range(7)]
    df = spark.createDataFrame(rows, "track_id long, seq long, candidates array<long>, n_clips long")
    got = [r.picked for r in selection.select_diverse(df, ["track_id"], ["seq"], share=0.75).orderBy("seq").collect()]
    # 0 and 1 by rank, 2 in turn, then a reset
    assert got[:4] == [0, 1, 2, 0] and got[4] == 1 and set(got[5:6]) <= {2, 3}


def test_unfilled_picks_get_the_lowest_unused_items(spark):
    picks = spark.createDataFrame(
        [(1, 0, 2, 0.9), (1, 1, None, 0.5), (1, 2, None, 0.5), (1, 3, 4, 0.8), (2, 0, 1, 0.7), (2, 1, None, 0.5), (3, 0, 5, 0.1), *[(4, i, None, 0.5) for i in range(7)]],
        "track_id long, seq long, picked long, score double")
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "clip_id long")
    for width in (None, 2.0):
        out = selection.fill_unused(picks, items, ["track_id"], ["seq"], width=width)
        assert out.columns == picks.columns
        got = {(r["track_id"], r["seq"]): r["picked"] for r in out.collect()}
        assert len(got) == picks.count()
        assert [got[1, i] for i in range(4)] == [2, 1, 3, 4]
        assert [got[2, i] for i in range(2)] == [1, 2]
        assert got[3, 0] == 5
        # a list longer than the catalog stays empty at its end
        assert [got[4, i] for i in range(7)] == [1, 2, 3, 4, 5, None, None]


def test_vector_stage_takes_the_nearest_clip(spark):
    rng = np.random.default_rng(2)
    moods, motions = ["CALM", "DARK", "TENSE"], ["SLOW", "MEDIUM", "FAST"]
    clips = spark.createDataFrame([(i, float(rng.random()), motions[i % 3], float(rng.random()), [moods[i % 2]], 0.1) for i in range(40)],
                                  "clip_id long, motion_score double, motion_type string, energy double, moods array<string>, camera_magnitude double")
    asked = spark.createDataFrame([(100 + i, 1, i, float(rng.random()), float(rng.random()), motions[i % 3], moods[i % 3]) for i in range(12)],
                                  "target_id long, track_id long, seg_idx long, energy double, level double, motion string, mood string")
    items = vectorops.clip_vectors(clips)
    found = matching.nearest_by_vector(asked, items)
    late = asked.select("track_id", "seg_idx", F.lit(0).cast("long").alias("clip_id"), F.lit(1.0).alias("distance"))
    got = {r.seg_idx: r for r in selection.cascade(found.join(asked, "target_id"), late, keys=("track_id", "seg_idx")).collect()}
    x = {r.clip_id: np.array(r.embedding) for r in items.collect()}
    wanted = asked.select("target_id", "energy", F.col("level").alias("motion_score"), F.col("motion").alias("motion_type"), F.array("mood").alias("moods"))
    for r in vectorops.query_vectors(wanted, "target_id").collect():
        d = {c: float(np.linalg.norm(e - np.array(r.embedding))) for c, e in x.items()}
        best = got[r.target_id - 100]
        assert best.strategy == 0 and abs(best.distance - min(d.values())) < 1e-9 and abs(d[best.clip_id] - min(d.values())) < 1e-9 and best.distance > 0


def test_recall_is_reached_in_many_dimensions(spark):
    x = np.random.default_rng(4).normal(size=(1500, 64))
    q, items = frame(spark, x[:600], "query_id"), frame(spark, x)
    exact = {(r.query_id, r.vec_id) for r in knn.search(q, items, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in knn.search(q, items, 10, recall=0.95).collect()}
    assert len(near) == len(exact) and len(exact & near) / len(exact) >= 0.9


def test_groups_are_cut_into_lists(spark):
    df = spark.createDataFrame([(i % 2, i * 3) for i in range(50)], "label long, query_id long")
    for width in (None, 20.0):
        rows = selection.in_lists(df, ["label"], ["query_id"], rows=10, width=width).collect()
        for label in (0, 1):
            own = sorted((r.query_id, r.list_no) for r in rows if r.label == label)
            assert [n for _, n in own] == [i // 10 for i in range(25)]
    big = spark.range(10_050).select(F.lit(1).alias("label"), F.col("id").alias("query_id"))
    cuts = selection.in_lists(big, ["label"], ["query_id"], width=1_000.0)
    assert {r.list_no: r["count"] for r in cuts.groupBy("list_no").count().collect()} == {0: 10_000, 1: 50}


def test_near_ties_of_many_copies_go_to_the_lowest_id(spark):
    # 0.4 and 0.2 are equally far from 0.3 up to rounding noise, which favours the copies at 0.2
    clips = spark.createDataFrame([(i, 0.4 if i == 1 else 0.2, 0.5, "SLOW", ["CALM"]) for i in range(1, 60)], "clip_id long, motion_score double, energy double, motion_type string, moods array<string>")
    asked = spark.createDataFrame([(i, 0.5, 0.3, "SLOW", "CALM") for i in range(5)], "target_id long, energy double, level double, motion string, mood string")
    found = matching.nearest_by_vector(asked, vectorops.clip_vectors(clips), k=2).collect()
    assert sorted((r.target_id, r.rank, r.clip_id) for r in found) == [(t, k, k) for t in range(5) for k in (1, 2)]


def test_equal_queries_are_compared_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(q, x):
        rows.add(len(q))
        return knn.l2(q, x)

    items = frame(spark, np.eye(4))
    asked = frame(spark, np.tile(np.eye(4)[:2], (300, 1)), "query_id")
    got = knn.search(asked, items, 1, metric=knn.Metric(counted, knn.l2_row)).collect()
    assert sorted((r.query_id, r.vec_id, r.distance) for r in got) == [(i, i % 2, 0.0) for i in range(600)]
    assert rows.value == 2


def test_copies_of_queries_leave_in_small_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x, centres = rng.normal(size=(300, 8)), rng.normal(size=(50, 8))
    counts = np.arange(50) % 5
    filled = np.flatnonzero(counts)
    batch = pa.record_batch({"query_id": pa.array(np.arange(300)), "embedding": pa.array(x.tolist()), "_k": pa.array(np.full(300, 3))})
    monkeypatch.setattr(knn, "VISITS", 100)
    monkeypatch.setattr(knn, "SLICE", 40 * 70)
    for probes in (7, None):
        out = list(knn._visits(iter([batch]), "embedding", knn.Cells(centres, counts, np.full(50, 9.0)), knn.Metric(), probes))
        got = sorted((q, c) for b in out for q, c in zip(b["query_id"].to_pylist(), b["_cell"].to_pylist(), strict=True))
        d = np.linalg.norm(x[:, None] - centres[filled][None], axis=2)
        near = [(i, int(c)) for i in range(300) for c in (filled[np.argsort(d[i])[:probes]] if probes else filled)]
        assert got == sorted(near) and max(b.num_rows for b in out) < 100 + len(filled)
