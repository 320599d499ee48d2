"""Walks along continuous time against the plain loop, for several chunk widths."""

import math

import numpy as np
import pytest

from cadenza.operators import cutlist, rules
from cadenza.operators.timewalk import walk_time

TRACKS = [(1, 120.0, 400.0, 0.0), (2, 97.3, 151.7, 0.21), (3, None, 60.0, None), (4, 60.0, 0.0, 0.0), (5, 150.0, 33.3, 1.5), (6, 133.0, 90.0, 0.0)]
RULES = [
    rules.Rule("calm", rules.EnergyIs(high=0.4), rules.CutLength(2.3, 4.1, snap=False), 3),
    rules.Rule("high", rules.EnergyIs(zone="high"), rules.CutLength(0.7, 2.9, by_energy=True, snap=False), 8),
    rules.Rule("third", rules.Combined("and", (rules.BeatIs(beat_in_bar=2), rules.TimeIn(5.0, 300.0))), rules.CutLength(1.0, 2.2), 10),
    rules.Rule("late", rules.Combined("and", (rules.TimeIn(120.0), rules.Combined("not", (rules.BeatIs(downbeat=True, tolerance=0.1),)))), rules.CutLength(37.0, 41.0), 1),
]


def curve():
    rng = np.random.default_rng(3)
    return {k: sorted((float(round(t, 3)), float(round(e, 4))) for t, e in zip(rng.uniform(0, 420, n), rng.uniform(0, 1, n), strict=True)) for k, n in ((1, 300), (2, 40), (3, 25), (5, 1), (4, 3))}


def energy_at(samples, t):
    if not samples:
        return math.nan
    ts = [x for x, _ in samples]
    i = int(np.searchsorted(ts, t, "right")) - 1
    if i < 0:
        return samples[0][1]
    if i + 1 == len(ts) or ts[i] == t:
        return samples[i][1]
    return samples[i][1] + (t - ts[i]) / (ts[i + 1] - ts[i]) * (samples[i + 1][1] - samples[i][1])


def rule_loop(samples, bpm, duration, offset, step):
    """The engine's loop for the rules above, one moment at a time."""
    beat, o, t, out = 60.0 / bpm if bpm else 0.5, offset or 0.0, 0.0, []
    while t < duration:
        e = energy_at(samples, t)
        in_bar = math.trunc(((t - o) % (beat * 4)) / beat)
        on = bool(bpm) and in_bar == 0 and abs((t - o) % beat) < 0.1
        if bpm and in_bar == 2 and 5 <= t < 300:
            name, length, snap = "third", 1.6, True
        elif e >= 0.66:
            name, length, snap = "high", 2.9 - e * (2.9 - 0.7), False
        elif e <= 0.4:
            name, length, snap = "calm", (2.3 + 4.1) / 2, False
        elif t >= 120 and not on:
            name, length, snap = "late", 39.0, True
        else:
            t += step
            continue
        start = t
        if snap:
            n = int(t / beat)
            start = (n + 1) * beat + o if n * beat + o < t else n * beat + o
        end = min(start + length, duration)
        out.append((t, name, start, end))
        t = max(end, math.nextafter(t, math.inf))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    tracks = spark.createDataFrame(TRACKS, "track_id long, bpm double, duration double, offset double")
    energy = spark.createDataFrame([(k, t, e) for k, rows in curve().items() for t, e in rows], "track_id long, t double, energy double")
    return tracks, energy


@pytest.mark.parametrize("width", [None, 200.0, 45.0])
def test_rules_equal_the_loop(tables, width):
    got = sorted((r.track_id, r.t, r.rule, r.start_t, r.end_t) for r in rules.walk_rules(*tables, RULES, 0.37, width).collect())
    want = [(k, *cut) for k, bpm, duration, offset in TRACKS for cut in rule_loop(curve().get(k), bpm, duration, offset, 0.37)]
    assert got == sorted(want) and len({r for _, _, r, _, _ in want}) == 4


@pytest.mark.parametrize("snap", [True, False])
def test_energy_cuts_equal_the_loop(tables, snap):
    want = []
    for k, bpm, duration, offset in TRACKS:
        beat, o, t, n = 60.0 / bpm if bpm else 0.5, offset or 0.0, 0.0, 0
        on = (lambda x: max(0.0, round((x - o) / beat) * beat + o)) if snap else (lambda x: x)  # noqa: B023
        while t < duration:
            e = energy_at(curve().get(k), t)
            length = 0.77 if e >= 0.66 else (0.77 + 5.3) / 2 if e >= 0.33 else 5.3
            t = on(t)
            end = min(on(t + length), duration)
            if end <= t:
                end = t + 0.77
                if end > duration:
                    break
            if end - t >= 0.1:
                want.append((k, n, t, end))
                n += 1
            t = end
    for width in (None, 60.0):
        got = sorted((r.track_id, r.cut_index, r.start_t, r.end_t) for r in cutlist.energy_driven(*tables, 0.77, 5.3, snap, width=width).collect())
        assert got == sorted(want)


def test_walks_that_meet_need_few_rounds(spark):
    tracks = spark.createDataFrame([(1, 120.0, 3000.0)], "track_id long, bpm double, duration double")
    energy = spark.createDataFrame([(1, float(t), (t % 97) / 97) for t in range(3000)], "track_id long, t double, energy double")
    snapped = [rules.Rule("all", rules.TimeIn(), rules.CutLength(0.9, 1.1), 1)]
    walk = rules.RuleWalk(tuple(snapped), 0.5)
    assert walk_time(tracks, energy, walk, width=100.0, most_rounds=3).count() == rules.walk_rules(tracks, energy, snapped, 0.5).count()


def test_empty_tables(spark, tables):
    tracks, energy = tables
    assert rules.walk_rules(tracks.limit(0), energy, RULES, 0.5, 10.0).collect() == []
    assert {r.rule for r in rules.walk_rules(tracks, energy.limit(0), RULES, 0.5, 10.0).collect()} == {"third", "late"}
