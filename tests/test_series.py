"""Ordered primitives, time joins, curves and peaks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import curves, intervals, peaks, rules, sync, timejoin
from cadenza.operators.ordered import Running, exact_percentile, framed, row_index, running


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    rows = [(k, round(i + rng.random(), 3), round(rng.random(), 2)) for k in range(4) for i in range(rng.choice([1, 9, 40]))]
    return rows, spark.createDataFrame(rows, "k long, t double, x double")


def by_key(rows):
    return {k: sorted(r[1:] for r in rows if r[0] == k) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("width", [None, 2.5, 7.0])
def test_running_values(series, width):
    rows, df = series
    out = running(df, ["k"], ["t"], [Running("s", "sum", F.col("x")), Running("m", "max", F.col("x")), Running("c", "count", F.lit(1)),
                                     Running("p", "last", F.col("x")), Running("n", "next", F.col("x"))], width)
    got = {(r.k, r.t): (r.s, r.m, r.c, r.p, r.n) for r in out.collect()}
    for k, points in by_key(rows).items():
        for i, (t, _) in enumerate(points):
            before = [x for _, x in points[:i]]
            s, m, c, p, n = got[(k, t)]
            assert c == i and p == (before[-1] if before else None) and n == (points[i + 1][1] if i + 1 < len(points) else None)
            assert (s is None and not before) or abs(s - sum(before)) < 1e-9
            assert m == (max(before) if before else None)


def test_framed_equals_one_window(series):
    rows, df = series
    numbered = row_index(df, ["k"], ["t"], "idx", 3.0)
    out = framed(numbered, ["k"], "idx", 2, {"m": lambda w: F.avg("x").over(w.rowsBetween(-2, 2))}, block=5)
    got = {(r.k, r.t): r.m for r in out.collect()}
    assert len(got) == len(rows)
    for k, points in by_key(rows).items():
        for i, (t, _) in enumerate(points):
            assert abs(got[(k, t)] - np.mean([x for _, x in points[max(0, i - 2):i + 3]])) < 1e-9


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_percentile(series, q):
    rows, df = series
    got = {r.k: r.p for r in exact_percentile(df, ["k"], "x", q, "p", 0.2).collect()}
    for k, points in by_key(rows).items():
        assert abs(got[k] - np.percentile([x for _, x in points], q * 100)) < 1e-9


@pytest.mark.parametrize("width", [None, 1.0])
def test_curve_lookup_edges(spark, width):
    curve = spark.createDataFrame([(1, 1.0, 0.0), (1, 3.0, 1.0), (2, 5.0, 0.4)], "k long, ct double, e double")
    asked = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.5), (1, 3.0), (1, 9.0), (2, 5.0), (3, 1.0)], "k long, t double")
    out = {(r.k, r.t): r.e for r in timejoin.curve_value(asked, curve, ["k"], "t", "ct", ["e"], False, width).collect()}
    assert out == {(1, 0.0): None, (1, 1.0): 0.0, (1, 2.5): 0.75, (1, 3.0): 1.0, (1, 9.0): None, (2, 5.0): 0.4, (3, 1.0): None}
    held = {(r.k, r.t): r.e for r in timejoin.curve_value(asked, curve, ["k"], "t", "ct", ["e"], True, width).collect()}
    assert held[(1, 0.0)] == 0.0 and held[(1, 9.0)] == 1.0


def test_nearest_prefers_the_earlier_point(spark):
    points = spark.createDataFrame([(1, 1.0), (1, 3.0)], "k long, p double")
    asked = spark.createDataFrame([(1, 2.0), (1, 2.1), (2, 0.0)], "k long, t double")
    out = {(r.k, r.t): (r.near.t if r.near else None) for r in timejoin.nearest(asked, points, ["k"], "t", "p", width=1.0).collect()}
    assert out == {(1, 2.0): 1.0, (1, 2.1): 3.0, (2, 0.0): None}


def test_containing_touching_overlapping_and_gaps(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 2.0, "a"), (1, 1, 2.0, 4.0, "b"), (1, 2, 3.0, 5.0, "c")], "k long, i long, s double, e double, v string")
    asked = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 3.5), (1, 4.5), (1, 5.0)], "k long, t double")
    out = {r.t: r.v for r in timejoin.containing(asked, segs, ["k"], "t", "s", "e", ["i"], ["v"], 1.5).collect()}
    assert out == {0.0: "a", 2.0: "b", 3.5: "b", 4.5: "c", 5.0: None}
    last = {r.t: r.v for r in timejoin.containing(asked, segs, ["k"], "t", "s", "e", ["i"], ["v"], 1.5, closed_end=True, last=True).collect()}
    assert last[3.5] == "c" and last[5.0] == "c"


def test_merge_ranges_against_sorting(spark):
    rng = random.Random(4)
    rows = [(k, round(rng.random() * 40, 1)) for k in range(3) for _ in range(30)]
    rows = [(k, s, round(s + rng.random() * 2, 1)) for k, s in rows]
    got = {(r.k, r.s): r.e for r in intervals.merge_ranges(spark.createDataFrame(rows, "k long, s double, e double"), ["k"], "s", "e", 0.5, 3.0).collect()}
    want = {}
    for k in range(3):
        merged = []
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if merged and s <= merged[-1][1] + 0.5:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want.update({(k, s): e for s, e in merged})
    assert got == want


def test_cut_list_validation(spark):
    cuts = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 1.999, 3.0), (2, 0, 0.0, 1.0), (2, 1, 1.0, 2.02)], "k long, seq long, start_t double, end_t double")
    assert [(r.k, r.seq) for r in intervals.violations(cuts, ["k"]).collect()] == [(1, 1)]
    totals = spark.createDataFrame([(1, 3.01), (2, 2.0), (3, 0.0)], "k long, total double")
    assert {r.k: r.span_ok for r in intervals.summary_checks(cuts, totals, ["k"]).collect()} == {1: True, 2: False, 3: True}


def brute_peaks(x, distance, prominence):
    tops, i = [], 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j + 1 < len(x) and x[i - 1] < x[i] and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    keep = set(tops)
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < distance}
    out = set()
    for p in keep:
        bases = []
        for step in (-1, 1):
            q, low = p + step, x[p]
            while 0 <= q < len(x) and x[q] <= x[p]:
                low, q = min(low, x[q]), q + step
            bases.append(low)
        if x[p] - max(bases) >= prominence:
            out.add(p)
    return out


@pytest.mark.parametrize("distance,prominence", [(1, 0.0), (4, 0.1), (7, 0.35)])
def test_peaks_against_brute_force(spark, distance, prominence):
    rng = random.Random(distance)
    data = {k: [round(rng.random(), 1) for _ in range(rng.choice([3, 50, 120]))] for k in range(5)}
    df = spark.createDataFrame([(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)], "k long, i long, x double")
    found = peaks.find_peaks(df, ["k"], "i", "x", distance, prominence or None, block=16, margin=4)
    got = {(r.k, r.i) for r in found.collect()}
    assert got == {(k, p) for k, xs in data.items() for p in brute_peaks(xs, distance, prominence)}


def test_beat_matching_against_the_greedy_loop(spark):
    rng = random.Random(9)
    beats = [(k, i, round(rng.random() * 30, 3), round(rng.random(), 2)) for k in range(3) for i in range(60)]
    motion = [(k, i, round(rng.random() * 30, 3), round(rng.random(), 2)) for k in range(3) for i in range(60)]
    want = set()
    for k in range(3):
        bs = sorted((r for r in beats if r[0] == k), key=lambda r: (r[2], r[1]))
        ms = sorted((r for r in motion if r[0] == k), key=lambda r: (r[2], r[1]))
        used = set()
        for b in sorted(bs, key=lambda r: -r[3]):
            best, pick = -1.0, None
            for m in ms:
                off = (m[2] - b[2]) * 1000
                if m[1] in used or abs(off) > 400:
                    continue
                score = 0.7 * (1 - abs(off) / 400) + 0.3 * min(b[3], m[3])
                if score > best:
                    best, pick = score, m[1]
            if pick is not None:
                used.add(pick)
                want.add((k, b[1], pick))
    schema = "track_id long, seq long, t double, strength double"
    out = sync.match_beats(spark.createDataFrame(beats, schema), spark.createDataFrame(motion, schema), 400.0, block=4.0)
    assert {(r.track_id, r.beat_seq, r.peak_seq) for r in out.collect()} == want


def test_savgol_keeps_a_cubic(spark):
    rows = [(1, i, 0.001 * i ** 3 - 0.02 * i ** 2 + i) for i in range(70)]
    out = curves.savgol(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], "i", "x", block=30)
    assert max(abs(r.x - rows[r.i][2]) for r in out.collect()) < 1e-6


def test_gaussian_keeps_a_constant_and_short_series(spark):
    rows = [(1, i, 2.5) for i in range(40)] + [(2, 0, 7.0), (3, 0, 1.0), (3, 1, 1.0)]
    out = curves.gaussian(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], "i", "x", block=30)
    assert all(abs(r.x - {1: 2.5, 2: 7.0, 3: 1.0}[r.k]) < 1e-9 for r in out.collect())


def test_time_grid_takes_its_points_from_the_pieces_of_the_curve(spark):
    tracks = spark.createDataFrame([(1, 120.0, 1.0), (2, 90.0, 0.35), (3, 60.0, 0.0), (None, 60.0, 0.3)], "track_id long, bpm double, duration double")
    samples = [(1, 0.15, 0.2), (1, 0.3, 0.8), (1, 0.7, 0.4), (2, 5.0, 0.9), (3, 0.0, 0.5), (1, None, 0.9), (9, 0.1, 0.1)]
    energy = spark.createDataFrame(samples, "track_id long, t double, energy double")
    for width in (None, 0.25):
        grid = rules.time_grid(tracks, 0.1, energy, width)
        assert grid.columns == ["track_id", "i", "t", "bpm", "offset", "duration", "energy"]
        # the grid itself is neither put in order nor joined by time
        assert "_side" not in grid._jdf.queryExecution().toString()
        got = {(r.track_id, r.i): (r.t, r.energy) for r in grid.collect()}
        assert sorted(got, key=str) == sorted([(1, i) for i in range(10)] + [(2, i) for i in range(4)] + [(None, i) for i in range(3)], key=str)
        for (track, i), (t, value) in got.items():
            assert t == i * 0.1
            curve = [(x, e) for k, x, e in samples if k == track and x is not None]
            want = float(np.interp(t, *zip(*curve, strict=True))) if curve and track else None
            assert value == want if want is None else abs(value - want) < 1e-12, (track, i, value, want)
