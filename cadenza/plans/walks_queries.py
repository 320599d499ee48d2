"""Queries over triggers: gates, spacing, suppression, decimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import chain, triggers
from cadenza.operators.chain import WalkRule
from cadenza.operators.ordered import borders, exact_percentile, row_index
from cadenza.plans.registry import query
from cadenza.session import materialize

CHUNK = 432_000.0
#: rows of a key beyond which it is cut into chunks of about that many
ROWS = 10_000
GAP = 21_600.0

GATED = """gated AS (
  SELECT g.*, pow(least(1e0, greatest(0e0, base_strength)), 2e0 - intensity / 100e0) * weight AS strength
  FROM (SELECT t.*, s.intensity, s.weight, s.rank FROM v_trigger t JOIN (VALUES
    ('beat', 80, 30, 1e0, 0), ('onset', 60, 40, 0.5e0, 1), ('kick', 85, 35, 1.2e0, 2), ('snare', 85, 35, 1e0, 3),
    ('hihat', 50, 45, 0.3e0, 4), ('energy', 100, 50, 1.5e0, 5)) s(kind, intensity, threshold, weight, rank)
    ON s.kind = t.trigger_type WHERE least(1e0, greatest(0e0, base_strength)) >= s.threshold / 100e0) g)"""
SUPPRESSED = GATED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, rank, seq) AS rn FROM gated),
walk AS (
  SELECT track_id, rn, 1 AS slot, seq AS cur, t AS cur_t, strength AS cur_s FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.track_id, r.rn, CASE WHEN r.t - w.cur_t >= {GAP} THEN w.slot + 1 ELSE w.slot END,
    CASE WHEN r.t - w.cur_t >= {GAP} OR r.strength > w.cur_s THEN r.seq ELSE w.cur END,
    CASE WHEN r.t - w.cur_t >= {GAP} OR r.strength > w.cur_s THEN r.t ELSE w.cur_t END,
    CASE WHEN r.t - w.cur_t >= {GAP} OR r.strength > w.cur_s THEN r.strength ELSE w.cur_s END
  FROM walk w JOIN ranked r ON r.track_id = w.track_id AND r.rn = w.rn + 1),
cuts AS (
  SELECT r.track_id, r.seq, r.t, r.trigger_type, r.base_strength, r.strength
  FROM (SELECT track_id, slot, arg_max(cur, rn) AS seq FROM walk GROUP BY track_id, slot) k
  JOIN ranked r ON r.track_id = k.track_id AND r.seq = k.seq)"""


def axis(v):
    """Chunk borders of the tracks with many triggers, None where no track has many; found once per run."""
    if "track_axis" not in v.__dict__:
        v.track_axis = borders(v.trigger, ["track_id"], "t", ROWS)
    return v.track_axis


def gated(v):
    return triggers.gate(v.trigger)


def cuts(v):
    """Gated, suppressed cuts of every track."""
    return triggers.suppress_close(gated(v), GAP, axis(v))


@query("f06_trigger_time_window",
       "SELECT track_id, seq, t, trigger_type FROM v_trigger WHERE t >= 86400e0 AND t < 1296000e0")
def _(v):
    return triggers.in_window(v.trigger, 86_400.0, 1_296_000.0).select("track_id", "seq", "t", "trigger_type")


@query("f07_downbeat_triggers", """
WITH o AS (SELECT track_id, min(t) AS off FROM v_beat GROUP BY track_id),
x AS (SELECT b.track_id, b.seq, b.t, 60e0 / k.bpm AS beat, o.off FROM v_beat b JOIN v_track k ON k.track_id = b.track_id
      JOIN o ON o.track_id = b.track_id),
d AS (SELECT *, (t - off) % (beat * 4) AS dist FROM x)
SELECT track_id, seq, round(t, 6) AS t FROM d WHERE dist < beat * 0.15e0 OR dist > beat * 4 - beat * 0.15e0""")
def _(v):
    beats = v.beat
    first = beats.groupBy("track_id").agg(F.min("t").alias("offset"))
    grid = v.track.select("track_id", "bpm").join(first, "track_id")
    hits = triggers.on_downbeat(beats.join(grid, "track_id"))
    return hits.select("track_id", "seq", F.round("t", 6).alias("t"))


@query("f08_trigger_gate", f"""
WITH {GATED} SELECT track_id, seq, trigger_type, base_strength AS raw_strength, round(strength, 6) AS strength FROM gated""")
def _(v):
    return gated(v).select("track_id", "seq", "trigger_type", "raw_strength", F.round("strength", 6).alias("strength"))


@query("f08_base_strength_by_type", """
SELECT trigger_type, count(*) AS n, CASE trigger_type WHEN 'beat' THEN 0.8e0 WHEN 'onset' THEN 0.6e0 WHEN 'kick' THEN 0.7e0
  WHEN 'snare' THEN 0.7e0 WHEN 'hihat' THEN 0.5e0 ELSE 0.6e0 END AS base FROM v_trigger GROUP BY trigger_type""")
def _(v):
    counts = v.trigger.groupBy("trigger_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("base", triggers.base_strength(F.col("trigger_type")))


@query("a05_trigger_counts", """
WITH c AS (SELECT trigger_type, count(*) AS n FROM v_trigger GROUP BY trigger_type)
SELECT trigger_type, n, round(n * 100e0 / sum(n) OVER (), 6) AS percent FROM c""")
def _(v):
    return triggers.counts_by_type(v.trigger).withColumn("percent", F.round("percent", 6))


@query("a05_suppressed_trigger_counts", f"""
WITH RECURSIVE {SUPPRESSED}, c AS (SELECT track_id, trigger_type, count(*) AS n FROM cuts GROUP BY track_id, trigger_type)
SELECT track_id, trigger_type, n, round(n * 100e0 / sum(n) OVER (PARTITION BY track_id), 6) AS percent FROM c""")
def _(v):
    return triggers.counts_by_type(cuts(v), ("track_id",)).withColumn("percent", F.round("percent", 6))


@query("a10_close_cut_suppression", f"""
WITH RECURSIVE {SUPPRESSED} SELECT track_id, seq, round(t, 6) AS t, trigger_type, round(strength, 6) AS strength FROM cuts""")
def _(v):
    return cuts(v).select("track_id", "seq", F.round("t", 6).alias("t"), "trigger_type", F.round("strength", 6).alias("strength"))


@query("a11_hit_merging", """
WITH RECURSIVE o AS (SELECT track_id, t, base_strength AS s, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) AS rn
                     FROM v_trigger),
w AS (SELECT track_id, rn, t AS a, s FROM o WHERE rn = 1
      UNION ALL SELECT o.track_id, o.rn, CASE WHEN o.t - w.a > 14400e0 THEN o.t ELSE w.a END, o.s
      FROM w JOIN o ON o.track_id = w.track_id AND o.rn = w.rn + 1)
SELECT track_id, round(a, 6) AS t, max(s) AS strength FROM w GROUP BY track_id, a""")
def _(v):
    hits = v.trigger.withColumnRenamed("base_strength", "strength")
    return triggers.merge_hits(hits, 14_400.0, CHUNK).withColumn("t", F.round("t", 6))


@query("a12_keep_first_spacing", """
WITH RECURSIVE o AS (SELECT track_id, seq, t, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) AS rn FROM v_trigger),
w AS (SELECT track_id, rn, seq, t AS a, TRUE AS k FROM o WHERE rn = 1
      UNION ALL SELECT o.track_id, o.rn, o.seq, CASE WHEN o.t - w.a >= 21600e0 THEN o.t ELSE w.a END, o.t - w.a >= 21600e0
      FROM w JOIN o ON o.track_id = w.track_id AND o.rn = w.rn + 1)
SELECT track_id, seq, round(a, 6) AS t FROM w WHERE k""")
def _(v):
    return triggers.keep_spaced(v.trigger, GAP, width=CHUNK).select("track_id", "seq", F.round("t", 6).alias("t"))


@query("a13_stem_trigger_merge", """
SELECT track_id, round(t, 6) AS t,
  CASE trigger_type WHEN 'kick' THEN 'kick' WHEN 'snare' THEN 'snare' WHEN 'hihat' THEN 'hihat' WHEN 'onset' THEN 'bass_drop'
    ELSE 'melody_hook' END AS trigger_type,
  round(CASE WHEN trigger_type = 'beat' THEN least(1e0, greatest(0e0, base_strength * 1.5e0)) ELSE base_strength END, 6) AS strength
FROM v_trigger""")
def _(v):
    rows = v.trigger.withColumnRenamed("base_strength", "strength")
    stems = {"kick": "kick", "snare": "snare", "hihat": "hihat", "bass_drop": "onset", "melody_hook": "beat"}
    lists = {new: rows.filter(F.col("trigger_type") == old) for new, old in stems.items()}
    merged = triggers.union_typed(lists, {"melody_hook": 1.5})
    return merged.withColumn("t", F.round("t", 6)).withColumn("strength", F.round("strength", 6))


@query("a13_distinct_times", "SELECT DISTINCT track_id, floor(t / 3600e0) * 3600e0 AS t FROM v_trigger")
def _(v):
    return triggers.distinct_times(v.trigger.withColumn("t", F.floor(F.col("t") / 3600.0) * 3600.0))


@query("u02_sorted_distinct_union", """
WITH a AS (SELECT DISTINCT track_id, floor(t / 86400e0) AS d FROM v_trigger WHERE trigger_type IN ('kick', 'snare', 'hihat'))
SELECT track_id, string_agg(CAST(CAST(d AS BIGINT) AS VARCHAR), ',' ORDER BY d) AS days FROM a GROUP BY track_id""")
def _(v):
    kinds = v.trigger.filter(F.col("trigger_type").isin("kick", "snare", "hihat"))
    days = kinds.select("track_id", F.floor(F.col("t") / 86_400.0).alias("d")).distinct()
    # at most one entry per calendar day and track
    listed = days.groupBy("track_id").agg(F.array_sort(F.collect_list("d")).alias("d"))
    return listed.select("track_id", F.array_join(F.col("d").cast("array<string>"), ",").alias("days"))


@query("a14_tempo_estimate", """
WITH d AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, seq) AS dt FROM v_beat)
SELECT track_id, count(*) AS n_beats, round(CASE WHEN avg(dt) > 0 THEN 60e0 / avg(dt) END, 9) AS bpm FROM d GROUP BY track_id""")
def _(v):
    return triggers.tempo(v.beat).withColumn("bpm", F.round("bpm", 9))


@query("w23_long_track_decimation", """
WITH n AS (SELECT track_id, seq, trigger_type, t,
             row_number() OVER (PARTITION BY track_id, trigger_type ORDER BY t, seq) - 1 AS i FROM v_trigger)
SELECT n.track_id, n.seq, n.trigger_type FROM n JOIN v_track k ON k.track_id = n.track_id
WHERE k.duration <= 1800 OR n.i % 4 = 0""")
def _(v):
    return triggers.decimate_long(v.trigger, v.track, CHUNK).select("track_id", "seq", "trigger_type")


@query("w24_beat_extrapolation", """
WITH l AS (SELECT b.track_id, max(b.t) AS last_beat, any_value(k.duration) AS duration, any_value(k.bpm) / 3600 AS bpm
           FROM v_beat b JOIN v_track k ON k.track_id = b.track_id GROUP BY b.track_id)
SELECT track_id, k, round(last_beat + k * (60e0 / bpm), 4) AS t
FROM (SELECT *, unnest(range(1, CAST(floor((duration - last_beat) / (60e0 / bpm)) + 1 AS BIGINT) + 1)) AS k FROM l)
WHERE last_beat + k * (60e0 / bpm) < duration""")
def _(v):
    slow = v.track.withColumn("bpm", F.col("bpm") / 3600)
    return triggers.extrapolate_beats(v.beat, slow).withColumn("t", F.round("t", 4))


@query("w26_repeat_clip_runs", """
WITH RECURSIVE o AS (SELECT track_id, t, energy, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM v_energy),
w AS (SELECT track_id, rn, energy AS e, 0 AS reps, TRUE AS fresh FROM o WHERE rn = 1
      UNION ALL
      SELECT o.track_id, o.rn, CASE WHEN abs(o.energy - w.e) <= 0.15e0 AND w.reps < 3 THEN w.e ELSE o.energy END,
        CASE WHEN abs(o.energy - w.e) <= 0.15e0 AND w.reps < 3 THEN w.reps + 1 ELSE 0 END,
        NOT (abs(o.energy - w.e) <= 0.15e0 AND w.reps < 3)
      FROM w JOIN o ON o.track_id = w.track_id AND o.rn = w.rn + 1)
SELECT o.track_id, o.t, w.fresh FROM w JOIN o ON o.track_id = w.track_id AND o.rn = w.rn""")
def _(v):
    return repeat_runs(v.energy).select("track_id", "t", F.col("kept").alias("fresh"))


def repeat_runs(curve, max_repeats: int = 3, similar: float = 0.15, block: float = 16.0):
    """`kept` marks rows that select anew; the others repeat the clip before."""
    numbered = row_index(curve, ["track_id"], ["t"], "idx", CHUNK)
    hold = float(max_repeats + 1)
    return chain.walk(numbered, ["track_id"], ["idx"], "energy", hold, WalkRule("differs", hold, threshold=similar), block)


@query("w27_drop_detection", """
WITH RECURSIVE d AS (
  SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx,
    coalesce(energy - lag(energy) OVER (PARTITION BY track_id ORDER BY t), 0) AS diff FROM v_energy),
p AS (SELECT track_id, quantile_cont(diff, 0.5) AS thr FROM d WHERE diff > 0 GROUP BY track_id),
h AS (SELECT d.*, row_number() OVER (PARTITION BY d.track_id ORDER BY idx) AS rn FROM d LEFT JOIN p ON p.track_id = d.track_id
      WHERE diff > coalesce(thr, 0.1e0)),
w AS (SELECT track_id, rn, idx AS a, TRUE AS k FROM h WHERE rn = 1
      UNION ALL SELECT h.track_id, h.rn, CASE WHEN h.idx - w.a >= 4 THEN h.idx ELSE w.a END, h.idx - w.a >= 4
      FROM w JOIN h ON h.track_id = w.track_id AND h.rn = w.rn + 1),
m AS (SELECT track_id, max(diff) AS top FROM d GROUP BY track_id)
SELECT w.track_id, h.idx, h.t, round(h.diff / (m.top + 1e-10), 6) AS strength
FROM w JOIN h ON h.track_id = w.track_id AND h.rn = w.rn JOIN m ON m.track_id = w.track_id WHERE w.k""")
def _(v):
    # read three times below, so it is written once
    curve = materialize(triggers.rises(v.energy, "energy", width=CHUNK), "rises")
    threshold = exact_percentile(curve.filter("diff > 0"), ["track_id"], "diff", 0.5, "threshold", 0.25)
    found = triggers.drops_of(curve, threshold, "energy", 4, width=16.0)
    return found.select("track_id", "idx", "t", F.round("strength", 6).alias("strength"))


@query("u01_typed_cut_union", """
WITH l AS (SELECT track_id, trigger_type, t, row_number() OVER (PARTITION BY track_id, trigger_type ORDER BY t, seq) - 1 AS seq
           FROM v_trigger)
SELECT track_id, trigger_type, seq, round(t, 6) AS t,
  round(pow(CASE trigger_type WHEN 'hihat' THEN 0.9e0 ELSE 1e0 END,
    2e0 - CASE trigger_type WHEN 'beat' THEN 0.8e0 WHEN 'onset' THEN 0.6e0 WHEN 'hihat' THEN 0.5e0 ELSE 0.85e0 END)
    * CASE trigger_type WHEN 'beat' THEN 1e0 WHEN 'onset' THEN 0.5e0 WHEN 'kick' THEN 1.2e0 WHEN 'snare' THEN 1e0 ELSE 0.3e0 END, 6)
    AS strength FROM l""")
def _(v):
    # the stored form of a track: one list of seconds per type and day, as a header file would hold it
    day = F.floor(F.col("t") / 86_400.0).alias("day")
    rows = v.trigger
    per_day = rows.groupBy("track_id", day).pivot("trigger_type", ["beat", "onset", "kick", "snare", "hihat"]).agg(
        F.array_sort(F.collect_list("t")))
    lists = {k: k for k in ("beat", "onset", "kick", "snare", "hihat")}
    typed = triggers.cuts_from_lists(per_day, lists, base={"hihat": 0.9}).drop("seq")
    numbered = row_index(typed, ["track_id", "trigger_type"], ["t"], "seq", CHUNK)
    return numbered.select("track_id", "trigger_type", "seq", F.round("t", 6).alias("t"), F.round("strength", 6).alias("strength"))
