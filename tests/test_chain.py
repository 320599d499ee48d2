"""Greedy walks against the plain sequential loop."""

import random

import pytest

from cadenza.operators import triggers
from cadenza.operators.chain import WalkRule, walk


def sequential(rows, rule, hold):
    out, last = [], None
    for t, s, i in rows:
        if last is None or rule.far(t - last[0], hold):
            out.append(i)
        elif rule.mode == "stronger" and s > last[1]:
            out[-1] = i
        elif rule.mode == "differs" and abs(s - last[1]) > rule.threshold:
            out.append(i)
        else:
            continue
        last = (t, s)
    return set(out)


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(25):
        for _ in range(rng.choice([1, 2, 7, 80])):
            rows.append((k, round(rng.random() * rng.choice([4, 30]) * 4) / 4, round(rng.random(), 1), len(rows)))
    return rows


@pytest.mark.parametrize("rule,hold", [
    (WalkRule("stronger", 1.0), 1.0), (WalkRule("first", 1.0), 1.0), (WalkRule("first", 1.0, strict=True), 1.0),
    (WalkRule("differs", 1.5, threshold=0.3), 1.5)])
def test_walk_equals_loop_for_every_chunk_width(spark, rule, hold):
    rows = sample(3)
    want = set()
    for k in {r[0] for r in rows}:
        want |= sequential(sorted([r[1:] for r in rows if r[0] == k], key=lambda r: (r[0], r[2])), rule, hold)
    df = spark.createDataFrame(rows, "k long, t double, s double, i long")
    for width in (None, 0.7, 5.0):
        got = {r.i for r in walk(df, ["k"], ["t", "i"], "s", hold, rule, width).filter("kept").select("i").collect()}
        assert got == want, width


def test_walk_does_not_depend_on_the_number_of_partitions(spark):
    df = spark.createDataFrame(sample(5), "k long, t double, s double, i long")
    rule = WalkRule("stronger", 2.0)
    results = []
    for n in (1, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append({r.i for r in walk(df, ["k"], ["t", "i"], "s", 2.0, rule, 3.0).filter("kept").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def cut_frame(spark, rows):
    return spark.createDataFrame(rows, "track_id long, seq long, t double, trigger_type string, strength double")


def test_suppression_edges(spark):
    assert triggers.suppress_close(cut_frame(spark, []), 1.0, 10.0).count() == 0
    one = [(1, 0, 5.0, "beat", 0.4)]
    assert [r.seq for r in triggers.suppress_close(cut_frame(spark, one), 1.0).collect()] == [0]
    # a gap equal to the interval keeps both; at equal times the stronger one stays
    rows = [(1, 0, 0.0, "beat", 0.4), (1, 1, 2.0, "beat", 0.1), (1, 2, 2.0, "kick", 0.9)]
    assert {r.seq for r in triggers.suppress_close(cut_frame(spark, rows), 2.0, 1.5).collect()} == {0, 2}


def test_hit_merging_keeps_the_first_time_and_the_greatest_strength(spark):
    rows = [(1, 0, 0.0, "beat", 0.1), (1, 1, 0.04, "beat", 0.8), (1, 2, 0.06, "beat", 0.3)]
    got = {(round(r.t, 2), r.strength) for r in triggers.merge_hits(cut_frame(spark, rows), 0.05, 0.02).collect()}
    assert got == {(0.0, 0.8), (0.06, 0.3)}


def test_gate_handles_nan_unknown_types_and_disabled_ones(spark):
    rows = [(1, 0, 0.0, "beat", float("nan")), (1, 1, 0.0, "riser", 0.5), (1, 2, 0.0, "kick", 0.2), (1, 3, 0.0, "snare", 9.0)]
    df = cut_frame(spark, rows).withColumnRenamed("strength", "base_strength")
    got = {r.seq: round(r.strength, 6) for r in triggers.gate(df).collect()}
    assert got == {0: round(0.5 ** 1.2, 6), 1: round(0.5 ** 1.2, 6), 3: 1.0}
    off = {**triggers.GATES, "beat": triggers.Gate(enabled=False)}
    assert 0 not in {r.seq for r in triggers.gate(df, gates=off).collect()}
