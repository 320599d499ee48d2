"""Intervals that hold a time, against plain loops; long intervals cost few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import intervals, sync, timejoin

EVENTS, PIECES = "k long, t double, id long", "k long, s double, e double, i long, v string, q double"


def made(seed=4):
    rng = np.random.default_rng(seed)
    events = [(int(k), float(round(t, 2)), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 300), rng.uniform(-40, 140, 300), strict=True))]
    events += [(1, None, 900), (7, 3.0, 901), (0, 10.0, 902), (0, 20.0, 903), (0, 100.0, 904)]
    pieces = []
    for i in range(120):
        s = float(round(rng.uniform(-50, 130), 2))
        pieces.append((int(rng.integers(0, 3)), s, s + float(round(rng.exponential(rng.choice([1, 8, 60])), 2)), i % 50, f"v{i}", (i % 7) / 10))
    pieces += [(0, 10.0, 20.0, 3, "edge", 0.5), (0, 20.0, 20.0, 0, "point", 0.5), (0, -1000.0, 1000.0, 60, "all", 0.25), (2, 5.0, 1.0, 0, "backwards", 1.0), (1, None, 9.0, 0, "none", 1.0), (0, 10.0, 20.0, 3, "edge", 0.5)]
    return events, pieces


def holds(p, k, t, closed):
    return p[0] == k and t is not None and p[1] is not None and p[1] <= t and (t <= p[2] if closed else t < p[2]) and p[1] <= p[2]


@pytest.mark.parametrize("width", [1.0, 7.5, 64.0, 5000.0])
@pytest.mark.parametrize(("closed", "last"), [(False, False), (True, False), (True, True)])
def test_first_and_last_interval(spark, width, closed, last):
    events, pieces = made()
    out = timejoin.containing(spark.createDataFrame(events, EVENTS), spark.createDataFrame(pieces, PIECES), ["k"], "t", "s", "e", ["i"], ["v", "q"], width, closed, last)
    got = sorted((r.id, r.v, r.q) for r in out.collect())
    want = []
    for k, t, i in events:
        hit = sorted((p[3], p[1], p[2], p[4], p[5]) for p in pieces if holds(p, k, t, closed))
        want.append((i, *(hit[-1 if last else 0][3:] if hit else (None, None))))
    assert got == sorted(want, key=lambda r: r[0])


@pytest.mark.parametrize("width", [2.0, 33.0])
def test_product_over_all_intervals(spark, width):
    events, pieces = made(5)
    out = timejoin.with_factor(spark.createDataFrame(events, EVENTS), spark.createDataFrame(pieces, PIECES), ["k"], "t", "s", "e", 1.0 + F.col("q"), width, closed_end=True)
    for r in out.collect():
        hit = [p[5] for p in pieces if holds(p, r.k, r.t, True)]
        assert r.covered == len(hit) and r.factor == pytest.approx(np.prod([1.0 + q for q in hit]))


def test_a_long_interval_leaves_few_rows(spark):
    long = spark.createDataFrame([(0, 0.5, 1_000_000.5)], "k long, s double, e double")
    nodes = long.select(F.explode(timejoin.cover(F.floor("s") + 1, F.floor("e") - 1)).alias("n")).select("n.*").collect()
    assert len(nodes) < 40
    covered = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in nodes)
    assert covered[0][0] == 1 and covered[-1][1] == 1_000_000 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    for lo in range(-9, 6):
        for hi in range(lo, 9):
            nodes = spark.range(1).select(F.explode(timejoin.cover(F.lit(lo), F.lit(hi))).alias("n")).select("n.*").collect() if (lo + hi) % 5 == 0 else None
            assert nodes is None or sorted(c for n in nodes for c in range(n["node"] << n["level"], (n["node"] + 1) << n["level"])) == list(range(lo, hi + 1))


def test_first_point_within(spark):
    events, _ = made(6)
    points = [(k, t + 0.25, i) for k, t, i in events if t is not None and i % 3] + [(0, 9.0, 5), (0, 9.0, 4), (0, 11.0, 2)]
    out = timejoin.first_within(spark.createDataFrame(events, EVENTS), spark.createDataFrame(points, "k long, p double, n long"), ["k"], "t", "p", 1.0, ["n"], 20.0)
    got = sorted((r.id, r.n) for r in out.collect())
    want = []
    for k, t, i in events:
        near = [(p, n) for kk, p, n in points if t is not None and kk == k and t - 1.0 <= p <= t + 1.0]
        want += [(i, min(near)[1])] if near else []
    assert got == sorted(want)


def test_conflicts_are_counted(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), i, float(s), float(s + rng.integers(1, 9))) for i, s in enumerate(rng.integers(0, 80, 150))]
    new, old = rows[:60], rows[60:]
    schema = "k long, seq long, start_t double, end_t double"
    for width in (None, 10.0):
        got = {r.seq: r.n_conflicts for r in intervals.conflict_counts(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), ["k"], width).collect()}
        assert got == {i: sum(k == kk and s < ee and e > ss for kk, _, ss, ee in old) for k, i, s, e in new}


def test_suggestions_without_zones(spark):
    cuts = spark.createDataFrame([(1, 0, 5.0, 0.5, "beat"), (1, 1, 50.0, 0.5, "beat")], "track_id long, seq long, t double, intensity double, trigger_type string")
    points = spark.createDataFrame([(1, 6.0)], "track_id long, t double")
    zones = spark.createDataFrame([], "track_id long, start_t double, end_t double, quality double")
    out = sync.snap_to_suggestions(cuts, points, zones).orderBy("seq").collect()
    assert [(r.t, round(r.intensity, 9), r.trigger_type) for r in out] == [(6.0, 0.6, "ai_enhanced"), (50.0, 0.5, "beat")]
