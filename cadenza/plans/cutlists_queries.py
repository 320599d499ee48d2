"""Queries that assemble cut lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import moods
from cadenza.operators import cutlist, intervals, rules, selection, sync
from cadenza.operators.durations import Limits, dynamic_duration
from cadenza.operators.ordered import row_index
from cadenza.operators.timejoin import containing, curve_value
from cadenza.plans.registry import query
from cadenza.plans.walks_queries import CHUNK, SUPPRESSED, axis, cuts
from cadenza.session import materialize

KEY = ["track_id"]
ANNOTATED = f"""{SUPPRESSED}, c1 AS (SELECT c.*, lead(t) OVER (PARTITION BY track_id ORDER BY t, seq) - t AS gap FROM cuts c),
c2 AS (SELECT c1.*, k.bpm, s.segment_type, p.t AS t0, p.energy AS e0, n.t AS t1, n.energy AS e1 FROM c1 JOIN v_track k ON k.track_id = c1.track_id
  LEFT JOIN v_segment s ON s.track_id = c1.track_id AND s.start_t <= c1.t AND c1.t < s.end_t ASOF LEFT JOIN v_energy p ON c1.track_id = p.track_id AND c1.t >= p.t
  ASOF LEFT JOIN v_energy n ON c1.track_id = n.track_id AND c1.t <= n.t),
c3 AS (SELECT *, CASE WHEN t0 = t THEN e0 WHEN t0 IS NULL OR t1 IS NULL THEN strength ELSE e0 + (t - t0) / (t1 - t0) * (e1 - e0) END AS energy FROM c2),
c4 AS (SELECT *, 60e0 / greatest(30e0, least(300e0, bpm)) * CASE WHEN segment_type IN ('intro', 'outro') THEN CASE WHEN energy < 0.4e0 THEN 16 ELSE 8 END WHEN segment_type IN ('drop', 'chorus') THEN 4 WHEN segment_type = 'verse' THEN 8
  WHEN segment_type = 'bridge' THEN CASE WHEN energy < 0.5e0 THEN 8 ELSE 4 END ELSE 4 END * CASE WHEN energy > 0.8e0 THEN 0.5e0 WHEN energy > 0.6e0 THEN 0.75e0 WHEN energy < 0.3e0 THEN 1.5e0 WHEN energy < 0.5e0 THEN 1.25e0 ELSE 1e0 END AS m FROM c3),
laid AS (SELECT *, greatest(2e0, least(CASE WHEN strength >= 0.7e0 AND gap < m * 1.2e0 THEN gap ELSE m END, 16e0)) AS duration FROM c4 WHERE gap IS NOT NULL)"""


def annotated(v):
    """Cuts with energy, segment, next gap and a duration; the last cut of a list has none."""
    ahead = intervals.with_next_start(cuts(v), KEY, "t", ["seq"], None, axis(v))
    gaps = ahead.withColumn("gap", F.col("next_t") - F.col("t")).drop("next_t")
    rows = curve_value(gaps, v.energy, KEY, "t", "t", ["energy"], False, axis(v)).withColumn("energy", F.coalesce("energy", "strength"))
    rows = containing(rows, v.segment, KEY, "t", "start_t", "end_t", ["seg_idx"], ["segment_type"], axis(v))
    rows = rows.join(v.track.select("track_id", "bpm"), "track_id").filter("gap IS NOT NULL")
    length = dynamic_duration(F.col("energy"), F.col("strength"), F.col("segment_type"), F.lit(0.5), F.lit(10.0), F.col("gap"), F.col("bpm"), Limits())
    # the layout reads the cuts twice
    return materialize(rows.withColumn("duration", length).withColumn("target", F.lit(60.0)), "cuts")


@query("w15_timeline_layout", f"""
WITH RECURSIVE {ANNOTATED}, s AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY track_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_t FROM laid)
SELECT track_id, seq, segment_type, round(energy, 6) AS energy, round(start_t, 6) AS start_t, round(least(start_t + duration, 60e0), 6) AS end_t FROM s WHERE round(start_t, 9) < 60""")
def _(v):
    out = cutlist.lay_out(annotated(v), KEY, ["t", "seq"], "duration", "target", axis(v))
    return out.select("track_id", "seq", "segment_type", F.round("energy", 6).alias("energy"), F.round("start_t", 6).alias("start_t"), F.round("end_t", 6).alias("end_t"))


@query("a06_cut_list_summary", f"""
WITH RECURSIVE {ANNOTATED}, s AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY track_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_t FROM laid),
d AS (SELECT track_id, least(start_t + duration, 60e0) - start_t AS d FROM s WHERE round(start_t, 9) < 60)
SELECT track_id, count(*) AS n_cuts, round(avg(d), 6) AS avg_duration, round(min(d), 6) AS min_duration, round(max(d), 6) AS max_duration, round(sum(d) / 60 * 100, 4) AS coverage_percent FROM d GROUP BY track_id""")
def _(v):
    out = cutlist.summary(cutlist.lay_out(annotated(v), KEY, ["t", "seq"], "duration", "target", axis(v)), KEY, "target")
    return out.select("track_id", "n_cuts", *[F.round(c, 6).alias(c) for c in ("avg_duration", "min_duration", "max_duration")], F.round("coverage_percent", 4).alias("coverage_percent"))


@query("w16_round_robin_assignment", f"""
WITH RECURSIVE {SUPPRESSED}, g AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, seq) - t AS d FROM cuts), n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) - 1 AS i FROM g WHERE d >= 0.5e0),
c AS (SELECT clip_id, is_available, row_number() OVER (ORDER BY clip_id) - 1 AS rk, count(*) OVER () AS total FROM v_clip)
SELECT n.track_id, n.seq, c.clip_id FROM n JOIN c ON c.rk = n.i % c.total WHERE c.is_available""")
def _(v):
    ahead = intervals.with_next_start(cuts(v), KEY, "t", ["seq"], None, CHUNK).withColumn("duration", F.col("next_t") - F.col("t"))
    # a clip that is not available has no path
    clips = selection.rank_clips(v.clip.withColumn("file_path", F.when(F.col("is_available"), F.col("file_path"))), width=100_000.0).select("clip_rank", "clip_id", "file_path")
    return cutlist.round_robin(ahead, clips, clips.count(), width=CHUNK).select("track_id", "seq", "clip_id")


@query("w17_tail_fill", """
WITH l AS (SELECT track_id, max(t) AS p FROM v_trigger GROUP BY track_id), n AS (SELECT *, 2592000e0 - p AS rest, CAST(floor((2592000e0 - p - 0.5e0) / 4000) + 1 AS BIGINT) AS n FROM l WHERE 2592000e0 - p >= 0.5e0),
f AS (SELECT *, unnest(range(0, n)) AS fill FROM n) SELECT track_id, fill, round(p + fill * 4000e0, 6) AS start_t, round(least(p + fill * 4000e0 + 4000, 2592000e0), 6) AS end_t FROM f""")
def _(v):
    lists = v.trigger.groupBy("track_id").agg(F.max("t").alias("position")).withColumn("target", F.lit(2_592_000.0))
    return cutlist.fill_tail(lists, 4000.0).withColumn("start_t", F.round("start_t", 6)).withColumn("end_t", F.round("end_t", 6))


@query("w18_beat_aligned_sequence", """
WITH RECURSIVE b AS (SELECT track_id, seq, t, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) AS rn, coalesce(greatest(least(lead(t) OVER (PARTITION BY track_id ORDER BY t, seq) - t, 100000e0), 20000e0), 100000e0) AS d FROM v_beat),
w AS (SELECT track_id, rn, seq, t, d, t + d AS until, 0 AS i, TRUE AS k FROM b WHERE rn = 1
  UNION ALL SELECT b.track_id, b.rn, b.seq, b.t, CASE WHEN b.t - (w.until - w.d) >= w.d THEN b.d ELSE w.d END, CASE WHEN b.t - (w.until - w.d) >= w.d THEN b.t + b.d ELSE w.until END,
    CASE WHEN b.t - (w.until - w.d) >= w.d THEN w.i + 1 ELSE w.i END, b.t - (w.until - w.d) >= w.d FROM w JOIN b ON b.track_id = w.track_id AND b.rn = w.rn + 1)
SELECT track_id, seq, i AS clip_index, round(t, 6) AS start_t, round(d, 6) AS duration FROM w WHERE k""")
def _(v):
    out = cutlist.align_to_beats(v.beat, KEY, None, 20_000.0, 100_000.0, CHUNK)
    return out.select("track_id", "seq", F.col("clip_index").cast("int").alias("clip_index"), F.round("start_t", 6).alias("start_t"), F.round("duration", 6).alias("duration"))


@query("w18_best_clip_start", """
WITH s AS (SELECT f.clip_id, f.frame_idx % 1000 / 10e0 AS t, 0.6e0 * f.magnitude / 15 + 0.4e0 * greatest(0e0, 1 - abs(2 * (f.frame_idx % 1000 / 10e0) / 100 - 0.3e0)) AS score FROM v_frame f),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(score, 9) DESC, t) AS k FROM s) SELECT clip_id, t AS start_offset, round(score, 6) AS alignment_score FROM r WHERE k = 1""")
def _(v):
    motion = v.frame.select("clip_id", (F.col("frame_idx") % 1000 / 10.0).alias("t"), (F.col("magnitude") / 15).alias("strength"), F.lit(100.0).alias("length"))
    out = sync.best_clip_start(motion, "length")
    return out.withColumn("alignment_score", F.round("alignment_score", 6))


#: the curve as pieces of time: its value at x in [a, b) is e, or on the line from (t, e) to (nt, ne)
PIECES = """p AS (SELECT track_id, t, energy AS e, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS nt, lead(energy) OVER (PARTITION BY track_id ORDER BY t) AS ne, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM v_energy),
pieces AS MATERIALIZED (SELECT track_id, t AS a, coalesce(nt, 1e18) AS b, t AS pt, e, nt, ne FROM p UNION ALL SELECT track_id, -1e18, t, t, e, NULL, NULL FROM p WHERE rn = 1)"""
ON_PIECE = "JOIN pieces p ON p.track_id = w.track_id AND w.t >= p.a AND w.t < p.b"
VALUE = "CASE WHEN p.ne IS NULL OR w.t = p.pt THEN p.e ELSE p.e + (w.t - p.pt) / (p.nt - p.pt) * (p.ne - p.e) END"


def energy_cuts_sql(snap: bool, shortest: float, longest: float) -> str:
    """The loop that follows the energy, cut by cut."""
    on_beat = (lambda x: f"greatest(0e0, round_even(({x}) / unit, 0) * unit)") if snap else (lambda x: x)
    wanted = f"CASE WHEN v >= 0.66e0 THEN {shortest}e0 WHEN v >= 0.33e0 THEN {(shortest + longest) / 2}e0 ELSE {longest}e0 END"
    moves = f"""SELECT track_id, duration, unit, t, s, CASE WHEN e > s THEN e ELSE s + {shortest}e0 END AS e, e <= s AND s + {shortest}e0 > duration AS ends
      FROM (SELECT *, least({on_beat("s + " + wanted)}, duration) AS e FROM (SELECT w.*, {on_beat("w.t")} AS s, {VALUE} AS v FROM w {ON_PIECE}))"""
    return f"""
WITH RECURSIVE {PIECES}, w AS (SELECT track_id, duration, 60e0 / (bpm / 3600) AS unit, 0e0 AS t FROM v_track
  UNION ALL SELECT track_id, duration, unit, e AS t FROM ({moves}) WHERE NOT ends AND e < duration),
c AS (SELECT * FROM ({moves}) WHERE NOT ends AND e - s >= 0.1e0)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS cut_index, round(s, 2) AS start_t, round(e, 2) AS end_t FROM c"""


@query("w19_energy_driven_cuts", energy_cuts_sql(True, 3010.7, 23_800.3))
def _(v):
    slow = v.track.withColumn("bpm", F.col("bpm") / 3600)
    out = cutlist.energy_driven(slow, v.energy, 3010.7, 23_800.3, width=CHUNK)
    return out.select("track_id", "cut_index", F.round("start_t", 2).alias("start_t"), F.round("end_t", 2).alias("end_t"))


@query("w19_energy_driven_cuts_unsnapped", energy_cuts_sql(False, 3010.7, 23_800.3))
def _(v):
    out = cutlist.energy_driven(v.track, v.energy, 3010.7, 23_800.3, snap=False, width=CHUNK)
    return out.select("track_id", "cut_index", F.round("start_t", 2).alias("start_t"), F.round("end_t", 2).alias("end_t"))


STEP = 7200.0
RULES = [
    rules.Rule("drop", rules.EnergyIs(zone="high"), rules.CutLength(3710.0, 21_710.0, by_energy=True, snap=False), 8),
    rules.Rule("downbeat", rules.Combined("and", (rules.BeatIs(beat_in_bar=0), rules.TimeIn(86_400.0, 2_000_000.0))), rules.CutLength(7150.5, 21_790.0, snap=False), 10),
    rules.Rule("calm", rules.Combined("and", (rules.EnergyIs(high=0.5), rules.Combined("not", (rules.TimeIn(0.0, 600_000.0),)))), rules.CutLength(14_450.0, 28_901.0, snap=False), 3),
]
RULE_GRID = """k AS (SELECT track_id, 60e0 / (bpm / 3600) AS beat, unnest(range(0, 360)) AS i FROM v_track), g AS (SELECT *, i * 7200e0 AS t FROM k),
lk AS (SELECT g.*, p.t AS t0, p.energy AS e0, n.t AS t1, n.energy AS e1 FROM g ASOF LEFT JOIN v_energy p ON g.track_id = p.track_id AND g.t >= p.t ASOF LEFT JOIN v_energy n ON g.track_id = n.track_id AND g.t <= n.t),
en AS (SELECT track_id, i, t, beat, CASE WHEN t0 = t THEN e0 WHEN t0 IS NULL OR t1 IS NULL THEN coalesce(e0, e1) ELSE e0 + (t - t0) / (t1 - t0) * (e1 - e0) END AS energy FROM lk),
ev AS (SELECT *, CASE WHEN trunc((t % (beat * 4)) / beat) = 0 AND t >= 86400 AND t < 2000000 THEN 'downbeat' WHEN energy >= 0.66e0 THEN 'drop' WHEN energy <= 0.5e0 AND NOT (t >= 0 AND t < 600000) THEN 'calm' END AS rule FROM en)"""


RULE_LENGTH = "CASE rule WHEN 'downbeat' THEN 14470.25e0 WHEN 'drop' THEN 21710e0 - energy * 18000e0 WHEN 'calm' THEN 21675.5e0 END"


def rule_grid(v):
    slow = v.track.withColumn("bpm", F.col("bpm") / 3600)
    return rules.evaluate_rules(rules.time_grid(slow, STEP, v.energy, CHUNK), RULES)


@query("f11_rule_predicates", f"""
WITH {RULE_GRID} SELECT track_id, i, energy >= 0.66e0 AS is_high, trunc((t % (beat * 4)) / beat) = 2 AS third_beat, energy >= 0.3e0 AND energy <= 0.6e0 OR t >= 1000000 AS mixed FROM en""")
def _(v):
    grid = rule_grid(v)
    mixed = rules.Combined("or", (rules.EnergyIs(low=0.3, high=0.6), rules.TimeIn(1_000_000.0)))
    return grid.select("track_id", "i", rules.EnergyIs(zone="high").column().alias("is_high"), rules.BeatIs(beat_in_bar=2).column().alias("third_beat"), mixed.column().alias("mixed"))


@query("w20_first_matching_rule", f"""
WITH {RULE_GRID} SELECT track_id, i, rule, round({RULE_LENGTH}, 4) AS length FROM ev""")
def _(v):
    return rule_grid(v).select("track_id", "i", "rule", F.round("length", 4).alias("length"))


def rule_walk_sql(step: float, rule: str, start: str, length: str) -> str:
    """(track_id, t, rule, start_t, end_t) of the loop: a match goes on at the end of its cut, else one step later."""
    moves = f"""SELECT track_id, beat, t, rule, start_t, CASE WHEN rule IS NULL THEN t + {step}e0 ELSE least(start_t + {length}, 2592000e0) END AS nxt
      FROM (SELECT *, {start} AS start_t FROM (SELECT *, {rule} AS rule FROM (SELECT w.*, {VALUE} AS energy FROM w {ON_PIECE})))"""
    return f"""
WITH RECURSIVE {PIECES}, w AS (SELECT track_id, 60e0 / (bpm / 3600) AS beat, 0e0 AS t FROM v_track UNION ALL SELECT track_id, beat, nxt AS t FROM ({moves}) WHERE nxt < 2592000e0),
cuts AS (SELECT track_id, t, rule, start_t, nxt AS end_t FROM ({moves}) WHERE rule IS NOT NULL)"""


WALKED = rule_walk_sql(STEP, "CASE WHEN trunc((t % (beat * 4)) / beat) = 0 AND t >= 86400 AND t < 2000000 THEN 'downbeat' WHEN energy >= 0.66e0 THEN 'drop' WHEN energy <= 0.5e0 AND NOT (t >= 0 AND t < 600000) THEN 'calm' END", "t", RULE_LENGTH)


@query("w20_rule_walk", f"{WALKED} SELECT track_id, round(t, 2) AS t, rule, round(start_t, 2) AS start_t, round(end_t, 2) AS end_t FROM cuts")
def _(v):
    slow = v.track.withColumn("bpm", F.col("bpm") / 3600)
    out = rules.walk_rules(slow, v.energy, RULES, STEP, CHUNK)
    return out.select("track_id", F.round("t", 2).alias("t"), "rule", F.round("start_t", 2).alias("start_t"), F.round("end_t", 2).alias("end_t"))


PRESET_CUTS = rule_walk_sql(
    1800.0, "CASE WHEN trunc((t % (beat * 4)) / beat) = 0 AND t % beat < 180e0 THEN 'Beat Synchronization' WHEN energy >= 0.66e0 THEN 'Energy Following' ELSE 'Variety Enforcement' END",
    "CASE WHEN trunc(t / beat) * beat < t THEN trunc(t / beat) + 1 ELSE trunc(t / beat) END * beat",
    "CASE rule WHEN 'Beat Synchronization' THEN 7200e0 WHEN 'Energy Following' THEN 7200e0 - energy * 5400e0 ELSE 6300e0 END")


def preset_cuts(v):
    """The preset rules with lengths and tolerance on the axis of the beats (an hour for a second), at the usual step of half a second."""
    slow = v.track.withColumn("bpm", F.col("bpm") / 3600)
    return rules.walk_rules(slow, v.energy, [rules.scaled(r, 3600.0) for r in rules.PRESETS.values()], 1800.0, CHUNK)


@query("x14_rule_presets", f"{PRESET_CUTS} SELECT track_id, rule, count(*) AS n FROM cuts GROUP BY track_id, rule")
def _(v):
    return preset_cuts(v).groupBy("track_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("x14_rule_presets_scaled", f"{PRESET_CUTS} SELECT track_id, rule, round(start_t, 2) AS start_t, round(end_t, 2) AS end_t FROM cuts")
def _(v):
    return preset_cuts(v).select("track_id", "rule", F.round("start_t", 2).alias("start_t"), F.round("end_t", 2).alias("end_t"))


@query("x13_custom_condition", "SELECT count(*) AS n FROM v_energy WHERE energy > 0.4e0 AND (t / 43200) % 2 = 0")
def _(v):
    class EvenHalfDay:
        """A user's own condition: any object that returns a boolean Column."""

        def column(self):
            return F.pmod(F.col("t") / 43_200.0, F.lit(2.0)) == 0

    grid = v.energy.withColumn("bpm", F.lit(120.0)).withColumn("offset", F.lit(0.0))
    rule = rules.Rule("own", rules.Combined("and", (rules.EnergyIs(low=0.4000001), EvenHalfDay())), priority=1)
    return rules.evaluate_rules(grid, [rule]).filter("rule = 'own'").agg(F.count(F.lit(1)).alias("n"))


@query("w21_step_sequencer", """
WITH s AS (SELECT DISTINCT track_id, CAST(floor(t / 7200e0) AS BIGINT) AS step_index FROM v_trigger), p AS (SELECT s.track_id, s.step_index, 60e0 / k.bpm / 4 AS step, s.step_index * (60e0 / k.bpm / 4) + 0.5e0 AS start_t FROM s JOIN v_track k ON k.track_id = s.track_id)
SELECT track_id, step_index, round(start_t, 6) AS start_t, round(coalesce(lead(start_t) OVER (PARTITION BY track_id ORDER BY step_index), start_t + step), 6) AS end_t FROM p""")
def _(v):
    steps = v.trigger.select("track_id", F.floor(F.col("t") / 7200.0).alias("step_index")).distinct().join(v.track.select("track_id", "bpm"), "track_id")
    out = cutlist.step_cuts(steps, KEY, F.lit(60.0) / F.col("bpm") / 4, F.lit(0.5), width=30.0)
    return out.select("track_id", "step_index", F.round("start_t", 6).alias("start_t"), F.round("end_t", 6).alias("end_t"))


@query("w25_level_variation", """
WITH n AS (SELECT track_id, t, energy, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS i FROM v_energy)
SELECT track_id, i, round(least(1e0, greatest(0e0, energy + sin(i / 20e0 * 2 * pi()) * 0.12e0 - 0.3e0)), 6) AS motion_level, round(least(1e0, greatest(0e0, energy + sin(i / 20e0 * 2 * pi()) * 0.12e0 + 0.2e0)), 6) AS energy_level FROM n""")
def _(v):
    rows = row_index(v.energy, KEY, ["t"], "i", CHUNK)
    motion, energy = cutlist.varied_levels(F.col("i"), F.col("energy"))
    return rows.select("track_id", "i", F.round(motion, 6).alias("motion_level"), F.round(energy, 6).alias("energy_level"))


SEG_LISTS = ", ".join(f"('{s}', {ms!r}, {moods.SEGMENT_MOODS[s]!r})" for s, ms in moods.SEGMENT_MOTIONS.items())


@query("w25_target_properties", f"""
WITH n AS (SELECT track_id, t, energy, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS i FROM v_energy), l AS (SELECT * FROM (VALUES {SEG_LISTS}) x(seg, motions, moods)),
j AS (SELECT n.*, l.motions AS ms, l.moods AS mo, (i % 10) * 0.05e0 AS saw FROM n JOIN v_segment s ON s.track_id = n.track_id AND s.start_t <= n.t AND n.t < s.end_t JOIN l ON l.seg = s.segment_type)
SELECT track_id, i, round(least(1e0, greatest(0e0, energy + saw - 0.025e0)), 6) AS varied_energy, round(least(1e0, greatest(0e0, energy - saw + 0.025e0)), 6) AS varied_motion,
  CASE WHEN energy > 0.7e0 AND list_contains(ms, 'FAST') THEN 'FAST' WHEN energy > 0.7e0 AND list_contains(ms, 'EXTREME') THEN 'EXTREME' WHEN energy > 0.5e0 AND list_contains(ms, 'MEDIUM') THEN 'MEDIUM'
  WHEN energy < 0.3e0 AND list_contains(ms, 'STATIC') THEN 'STATIC' ELSE ms[i % len(ms) + 1] END AS target_motion, mo[i % len(mo) + 1] AS target_mood FROM j""")
def _(v):
    rows = row_index(v.energy, KEY, ["t"], "i", CHUNK)
    rows = containing(rows, v.segment, KEY, "t", "start_t", "end_t", ["seg_idx"], ["segment_type"], CHUNK)
    props = cutlist.target_properties(F.col("i"), F.col("energy"), F.col("segment_type"))
    return rows.select("track_id", "i", F.round(props["varied_energy"], 6).alias("varied_energy"), F.round(props["varied_motion"], 6).alias("varied_motion"),
                       props["target_motion"].alias("target_motion"), props["target_mood"].alias("target_mood"))


@query("t05_best_n_cuts", """
WITH r AS (SELECT track_id, seq, t, base_strength AS intensity, row_number() OVER (PARTITION BY track_id ORDER BY base_strength DESC, t DESC, seq DESC) AS k FROM v_trigger)
SELECT track_id, seq, intensity FROM r WHERE k <= CASE WHEN track_id % 11 > 0 THEN CAST(trunc(50 * (track_id % 11 / 10e0)) AS INT) ELSE 25 END""")
def _(v):
    rows = v.trigger.select("track_id", "seq", "t", F.col("base_strength").alias("intensity"), (F.col("track_id") % 11 / 10.0).alias("quality"))
    return cutlist.keep_best(rows, KEY, "quality").select("track_id", "seq", "intensity")


@query("a22_diversity_statistics", """
SELECT track_id, count(*) AS total_selections, count(DISTINCT clip_id) AS unique_clips, round(count(DISTINCT clip_id) / CAST(count(*) AS DOUBLE), 6) AS diversity_ratio FROM v_usage GROUP BY track_id""")
def _(v):
    return cutlist.diversity(v.usage, KEY).withColumn("diversity_ratio", F.round("diversity_ratio", 6))


@query("x18_structure_summary", """
SELECT track_id, string_agg(printf('%s (%.1fs-%.1fs, %.1fs)', upper(segment_type), start_t, end_t, end_t - start_t), ' → ' ORDER BY start_t) AS summary FROM v_segment GROUP BY track_id""")
def _(v):
    return cutlist.structure_summary(v.segment)
