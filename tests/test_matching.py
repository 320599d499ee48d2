"""Top clips under the stepped strategies, and the cascade that falls through, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import matching, selection


@pytest.mark.parametrize(("gap", "near"), [(0.1, True), (0.5, False), (0.03, True), (2.0, False)])
def test_steps_equal_a_full_comparison(spark, gap, near):
    rng = np.random.default_rng(12)
    items = [(i, ("a", "b")[int(rng.integers(2))], float(rng.integers(0, 4)) / 10, float(round(rng.uniform(0, 1), int(rng.integers(1, 4))))) for i in rng.permutation(260).tolist()]
    asked = [(t, ("a", "b", "none")[t % 3], float(round(rng.uniform(-0.2, 1.2), 2))) for t in range(40)] + [(90, "a", 0.5), (91, "a", 0.5), (92, "b", None)]
    levels = spark.createDataFrame([(i, m, p, x) for i, m, p, x in items], "clip_id long, mood string, points double, axis double")
    targets = spark.createDataFrame(asked, "target_id long, mood string, axis double")
    for k in (1, 7):
        got = sorted((r.target_id, r["rank"], r.clip_id, round(r.score, 9)) for r in matching.top_by_step(targets, levels, ["mood"], k, gap, near, width=0.3).collect())
        want = []
        for t, mood, x in asked:
            if x is None:
                continue
            scored = []
            for i, m, p, y in items:
                d = round(abs(y - x), 9)
                s = min(1.0, p + (0.3 if (d < gap if near else d > gap) else 0.0))
                scored += [(-round(s, 9), i)] if m == mood and s > 0 else []
            want += [(t, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
        assert got == sorted(want)


@pytest.mark.parametrize(("gap", "near"), [(0.1, True), (0.5, False)])
def test_tree_of_many_levels_is_filled_in_strides(spark, monkeypatch, gap, near):
    written = []
    write = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: (written.append((name, out := write(df, name))), out)[1])
    rng = np.random.default_rng(5)
    items = [(int(i), ("a", "b", "unasked")[n % 3], 0.3, n / 1800) for n, i in enumerate(rng.permutation(1800))]
    asked = [(t, ("a", "b")[t % 2], float(round(rng.uniform(0, 1), 2))) for t in range(12)]
    levels = spark.createDataFrame(items, "clip_id long, mood string, points double, axis double")
    targets = spark.createDataFrame(asked, "target_id long, mood string, axis double")
    got = sorted((r.target_id, r["rank"], r.clip_id) for r in matching.top_by_step(targets, levels, ["mood"], 5, gap, near, width=0.3).collect())
    want = []
    for t, mood, x in asked:
        scored = [(-(0.3 + (0.3 if (d < gap if near else d > gap) else 0.0)), i) for i, m, _, y in items if m == mood for d in [round(abs(y - x), 9)]]
        want += [(t, n, i) for n, (_, i) in enumerate(sorted(scored)[:5], 1)]
    assert got == sorted(want)
    # 600 places of a key make ten levels and a root; upper ones come from the ids that level 7 keeps, and nobody asks for the third key
    reach = [out.agg(F.min("_level"), F.max("_level")).first() for name, out in written if name == "nodes"]
    assert [tuple(r) for r in reach] == [(0, 7), (8, 10)]
    assert [out.count() for name, out in written if name == "levels"] == [1200]


def test_targets_of_equal_ranges_are_answered_once(spark, monkeypatch):
    written = []
    write = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: (written.append((name, out := write(df, name))), out)[1])
    clips = [(i, [("CALM", "DARK", "WARM")[i % 3]], (i * 7 % 5) / 10) for i in range(40)]
    asked = [(t, "CALM", t / 300) for t in range(300)] + [(300, "CALM", None)]
    moods = spark.createDataFrame(clips, "clip_id long, moods array<string>, energy double")
    targets = spark.createDataFrame(asked, "target_id long, mood string, energy double")
    got = sorted((r.target_id, r["rank"], r.clip_id) for r in matching.best_by_mood(targets, moods, 2, strategy="contrast").collect())
    points = {(r.clip_id): r.p for r in moods.select("clip_id", F.round(matching.mood_points(F.lit("CALM"), F.col("moods")), 2).alias("p")).collect()}
    want = []
    for t, _, x in asked[:-1]:
        scored = [(-round(min(1.0, points[i] + (0.3 if round(abs(e - x), 9) > 0.5 else 0.0)), 9), i) for i, _, e in clips]
        want += [(t, n, i) for n, (_, i) in enumerate(sorted(p for p in scored if p[0] < 0)[:2], 1)]
    assert got == sorted(want)
    # five energies have five edges on either side, whatever the number of targets
    ranges = next(out for name, out in written if name == "ranges")
    assert ranges.count() == 300 and ranges.select("mood", "_low", "_high").distinct().count() <= 11


def test_contrast_motion_asks_once_per_class(spark, monkeypatch):
    written = []
    write = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: (written.append((name, out := write(df, name))), out)[1])
    clips = spark.createDataFrame([(i, ("STATIC", "FAST", "EXTREME")[i % 3], i / 30) for i in range(30)], "clip_id long, motion_type string, motion_score double")
    asked = [(t, ("STATIC", "EXTREME")[t % 2], t / 80) for t in range(80)] + [(80, "STATIC", None)]
    targets = spark.createDataFrame(asked, "target_id long, motion string, level double")
    got = sorted((r.target_id, r["rank"], r.clip_id, r.score) for r in matching.best_by_motion(targets, clips.withColumn("camera_motion", F.lit(None).cast("string")), 2, strategy="contrast").collect())
    best = {"STATIC": [1, 2], "EXTREME": [0, 3]}
    assert got == sorted((t, n, i, 0.4) for t, m, x in asked if x is not None for n, i in enumerate(best[m], 1))
    assert next(out for name, out in written if name == "asked").count() == 2


def test_cascade_falls_through(spark):
    clips = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(4)]) for i in range(4)], "clip_id long, embedding array<double>")
    keyed = [(1, 0), (1, 1), (1, 2)]
    vector = spark.createDataFrame([(1, 0, 3, 0.2)], "track_id long, seq long, clip_id long, distance double")
    smart = spark.createDataFrame([(1, 0, 1, 0.1), (1, 1, 2, 0.4), (1, 1, 0, 0.4)], "track_id long, seq long, clip_id long, distance double")
    turn = spark.createDataFrame([(*k, 9, 1.0) for k in keyed], "track_id long, seq long, clip_id long, distance double")
    got = {(r.seq, r.strategy, r.clip_id) for r in selection.cascade(vector, smart, turn).collect()}
    assert got == {(0, 0, 3), (1, 1, 0), (2, 2, 9)} and clips.count() == 4


def test_vector_stage_keeps_its_limit_and_ties(spark):
    rows = spark.createDataFrame([(i, 0.5, "MEDIUM", 0.5 + (0.3 if i % 2 else 0.0), ["CALM"]) for i in range(30, 0, -1)], "clip_id long, motion_score double, motion_type string, energy double, moods array<string>")
    from cadenza.operators import vectorops

    items = vectorops.clip_vectors(rows)
    targets = spark.createDataFrame([(1, 0.5, 0.5, "MEDIUM", "CALM"), (2, 0.5, 0.5, "EXTREME", "DARK")], "target_id long, energy double, level double, motion string, mood string")
    got = {r.target_id: (r.clip_id, round(r.distance, 6)) for r in matching.nearest_by_vector(targets, items, max_distance=0.2).collect()}
    assert got == {1: (2, 0.0)}
    assert matching.nearest_by_vector(targets, items).filter(F.col("target_id") == 2).count() == 1


def test_colour_difference_equals_published_pairs(spark):
    from cadenza.operators import palette

    pairs = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
             (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082), (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065)]
    df = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, e double")
    colour = lambda i: F.struct(*[F.col(f"{c}{i}").alias(c) for c in "lab"])
    for r in df.select(palette.color_difference(colour(1), colour(2)).alias("d"), "e").collect():
        assert r.d == pytest.approx(r.e, abs=5e-5)
    rgb = lambda *c: F.array(*[F.lit(float(x)) for x in c])
    same = spark.range(1).select(palette.lab_similarity(rgb(10, 200, 30), F.array(rgb(0, 0, 0), rgb(10, 200, 30))).alias("s"), palette.lab(rgb(255, 255, 255)).alias("w")).first()
    assert same.s == 1.0 and same.w.l == pytest.approx(100.0, abs=1e-3) and abs(same.w.a) < 0.01


def test_equal_clips_and_equal_targets_are_looked_at_once(spark, monkeypatch):
    seen, asked = [], []
    levels, by_motion = matching.mood_levels, matching.best_by_motion
    monkeypatch.setattr(matching, "mood_levels", lambda rows: (seen.append(rows.count()), levels(rows))[1])
    monkeypatch.setattr(matching, "best_by_motion", lambda rows, *a, **kw: (asked.append(rows.count()), by_motion(rows, *a, **kw))[1])
    moods = spark.createDataFrame([(i, 0.5 if i % 2 else 0.9, ["CALM"]) for i in range(200)], "clip_id long, energy double, moods array<string>")
    motion = spark.createDataFrame([(i, 0.5, "SLOW", "PAN") for i in range(200)], "clip_id long, motion_score double, motion_type string, camera_motion string")
    targets = spark.createDataFrame([(i, 0.5, 0.5, "SLOW", "CALM") for i in range(30)], "target_id long, energy double, level double, motion string, mood string")
    got = matching.best_combined(targets, motion, moods, 3, 2).collect()
    assert seen == [6] and asked == [1]
    assert sorted((r.target_id, r.rank, r.clip_id) for r in got) == [(t, k, c) for t in range(30) for k, c in ((1, 1), (2, 0))]


def test_equal_colours_are_compared_once(spark, monkeypatch):
    from cadenza.operators import palette

    written = []
    keep = palette.materialize
    monkeypatch.setattr(palette, "materialize", lambda df, name: (written.append(keep(df, name)), written[-1])[1])
    rows = spark.range(400).selectExpr("id", "IF(id = 7, NULL, array(double(id % 2), 10D, 20D)) AS p", "array(array(double(id % 5), 0D, 0D), array(9D, 9D, 9D)) AS c")
    got = palette.with_similarities(rows, "p", "c").select("id", "lab_similarity", palette.lab_similarity(F.col("p"), F.col("c")).alias("own")).collect()
    assert len(got) == 400 and all(r.lab_similarity == r.own for r in got)
    assert written[0].count() == 11
