"""Queries over time joins, intervals and beat grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import beats as grid
from cadenza.operators import intervals, sync, timejoin
from cadenza.operators.ordered import borders
from cadenza.plans.registry import query
from cadenza.plans.walks_queries import CHUNK, ROWS, SUPPRESSED, axis, cuts

HOUR = 3600.0
GRID = """g AS (SELECT t.track_id, t.seq, t.t, 60e0 / k.bpm AS beat, CAST(t.track_id % 5 AS DOUBLE) / 10e0 AS o
  FROM v_trigger t JOIN v_track k ON k.track_id = t.track_id)"""
LERP = """lerp AS (
  SELECT e.*, p.t AS t0, p.energy AS e0, n.t AS t1, n.energy AS e1
  FROM ev e ASOF LEFT JOIN v_energy p ON e.track_id = p.track_id AND e.et >= p.t
  ASOF LEFT JOIN v_energy n ON e.track_id = n.track_id AND e.et <= n.t),
looked AS (
  SELECT *, CASE WHEN t0 = et THEN e0 WHEN t0 IS NULL OR t1 IS NULL THEN NULL WHEN t1 - t0 < 1e-9 THEN e0
    ELSE e0 + (et - t0) / (t1 - t0) * (e1 - e0) END AS value,
    CASE WHEN t0 = et THEN e0 WHEN t0 IS NULL OR t1 IS NULL THEN coalesce(e0, e1) WHEN t1 - t0 < 1e-9 THEN e0
    ELSE e0 + (et - t0) / (t1 - t0) * (e1 - e0) END AS clamped FROM lerp)"""


def on_grid(v):
    bpm = v.track.select("track_id", (F.lit(60.0) / F.col("bpm")).alias("beat"))
    return v.trigger.join(bpm, "track_id").withColumn("o", (F.col("track_id") % 5).cast("double") / 10.0)


@query("x01_snap_to_beat", f"""
WITH {GRID} SELECT track_id, seq, CAST(floor(greatest(0e0, round_even((t - o) / beat, 0) * beat + o) * 1000 + 0.5e0) AS BIGINT) AS beat_ms,
  CAST(floor(greatest(0e0, round_even((t - o) / (beat * 4), 0) * (beat * 4) + o) * 1000 + 0.5e0) AS BIGINT) AS bar_ms,
  CAST(floor(greatest(0e0, round_even((t - o) / (beat / 8), 0) * (beat / 8) + o) * 1000 + 0.5e0) AS BIGINT) AS eighth_ms FROM g""")
def _(v):
    t, b, o = F.col("t"), F.col("beat"), F.col("o")

    def ms(x):
        return F.floor(x * 1000 + 0.5)

    return on_grid(v).select("track_id", "seq", ms(grid.snap(t, b, o)).alias("beat_ms"), ms(grid.snap(t, b, o, "downbeat")).alias("bar_ms"),
                             ms(grid.snap(t, b, o, "subdivision", "1/8")).alias("eighth_ms"))


@query("x02_beat_and_bar_position", f"""
WITH {GRID} SELECT track_id, seq, CAST(trunc((t - o) / beat) AS BIGINT) AS beat_number, round((t - o) % beat, 4) AS beat_offset,
  CAST(trunc((t - o) / (beat * 4)) AS BIGINT) AS bar_number,
  CAST(trunc(((t - o) % (beat * 4)) / beat) AS BIGINT) AS beat_in_bar FROM g WHERE t > o""")
def _(v):
    t, b, o = F.col("t"), F.col("beat"), F.col("o")
    number, into = grid.beat_position(t, b, o)
    bar, in_bar, _ = grid.bar_position(t, b, o)
    return on_grid(v).filter(t > o).select("track_id", "seq", number.alias("beat_number"), F.round(into, 4).alias("beat_offset"),
                                           bar.alias("bar_number"), in_bar.alias("beat_in_bar"))


@query("f09_beats_in_range", """
SELECT b.track_id, b.seq FROM v_beat b JOIN v_segment s ON s.track_id = b.track_id AND s.segment_type = 'chorus'
WHERE b.t BETWEEN s.start_t AND s.end_t""")
def _(v):
    chorus = v.segment.filter("segment_type = 'chorus'")
    inside = timejoin.containing(v.beat, chorus, ["track_id"], "t", "start_t", "end_t", ["seg_idx"], ["segment_type"], CHUNK, closed_end=True)
    return inside.filter("segment_type IS NOT NULL").select("track_id", "seq")


@query("f09_first_beat_at_time", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) - 1 AS idx FROM v_beat)
SELECT m.track_id, m.seq, min(i.idx) AS beat_index FROM v_motion_peak m JOIN i ON i.track_id = m.track_id AND i.t >= m.t - 1800e0 AND i.t <= m.t + 1800e0
GROUP BY m.track_id, m.seq""")
def _(v):
    from cadenza.operators.ordered import row_index

    numbered = row_index(v.beat, ["track_id"], ["t", "seq"], "idx", axis(v)).select("track_id", F.col("t").alias("bt"), "idx")
    hits = timejoin.first_within(v.motion_peak, numbered, ["track_id"], "t", "bt", 1800.0, ["idx"], axis(v))
    return hits.select("track_id", "seq", F.col("idx").alias("beat_index"))


@query("j08_curve_value_at_event", f"""
WITH ev AS (SELECT track_id, seq, t AS et FROM v_trigger), {LERP}
SELECT track_id, seq, round(value, 6) AS energy, round(clamped, 6) AS clamped FROM looked""")
def _(v):
    found = timejoin.asof(v.trigger, v.energy, ["track_id"], "t", "t", ["energy"], axis(v))
    return found.select("track_id", "seq", F.round(timejoin.lerp("t", "energy"), 6).alias("energy"),
                        F.round(timejoin.lerp("t", "energy", clamp=True), 6).alias("clamped"))


@query("w04_energy_zones", f"""
WITH ev AS (SELECT track_id, seq, t AS et FROM v_trigger), {LERP}
SELECT track_id, seq, CASE WHEN clamped < 0.33e0 THEN 'low' WHEN clamped < 0.66e0 THEN 'medium' ELSE 'high' END AS zone FROM looked""")
def _(v):
    from cadenza.operators.curves import zone

    found = timejoin.curve_value(v.trigger, v.energy, ["track_id"], "t", "t", ["energy"], True, CHUNK)
    return found.select("track_id", "seq", zone(F.col("energy")).alias("zone"))


@query("j09_segment_at_time", """
SELECT t.track_id, t.seq, s.segment_type FROM v_trigger t JOIN v_segment s
ON s.track_id = t.track_id AND s.start_t <= t.t AND t.t < s.end_t""")
def _(v):
    found = timejoin.containing(v.trigger, v.segment, ["track_id"], "t", "start_t", "end_t", ["seg_idx"], ["segment_type"], axis(v))
    return found.filter("segment_type IS NOT NULL").select("track_id", "seq", "segment_type")


@query("j10_structure_annotated_cuts", f"""
WITH RECURSIVE {SUPPRESSED} SELECT c.track_id, c.seq, c.trigger_type, s.segment_type FROM cuts c
LEFT JOIN v_segment s ON s.track_id = c.track_id AND s.seg_idx < 5 AND s.start_t <= c.t AND c.t < s.end_t""")
def _(v):
    known = v.segment.filter("seg_idx < 5")
    found = timejoin.containing(cuts(v), known, ["track_id"], "t", "start_t", "end_t", ["seg_idx"], ["segment_type"], axis(v))
    return found.select("track_id", "seq", "trigger_type", "segment_type")


NEAR = """near AS (
  SELECT e.*, p.t AS pt, n.t AS nt,
    CASE WHEN n.t IS NULL OR (p.t IS NOT NULL AND e.et - p.t <= n.t - e.et) THEN p.t ELSE n.t END AS near_t
  FROM ev e ASOF LEFT JOIN pts p ON e.track_id = p.track_id AND e.et >= p.t
  ASOF LEFT JOIN pts n ON e.track_id = n.track_id AND e.et <= n.t)"""


@query("j11_sync_score", f"""
WITH ev AS (SELECT track_id, seq, t AS et FROM v_motion_peak), pts AS (SELECT track_id, t FROM v_beat), {NEAR},
a AS (SELECT track_id, count(*) AS total_cuts, count(*) FILTER (abs(et - near_t) <= 3600e0) AS matched_cuts,
  avg(abs(et - near_t) * 1000e0) AS avg_ms, max(abs(et - near_t) * 1000e0) AS max_ms FROM near GROUP BY track_id),
s AS (SELECT *, coalesce(0.6e0 * matched_cuts / total_cuts + 0.4e0 * greatest(0e0, 1e0 - avg_ms / 7200000e0), 0e0) AS score FROM a)
SELECT track_id, total_cuts, matched_cuts, round(avg_ms, 3) AS average_offset_ms, round(max_ms, 3) AS max_offset_ms,
  round(score, 6) AS score, CASE WHEN score >= 0.9e0 THEN 'EXCELLENT' WHEN score >= 0.7e0 THEN 'GOOD' ELSE 'ACCEPTABLE' END AS quality FROM s""")
def _(v):
    s = sync.sync_score(v.motion_peak, v.beat, tolerance_ms=3_600_000.0, width=axis(v))
    return s.select("track_id", "total_cuts", "matched_cuts", F.round("average_offset_ms", 3).alias("average_offset_ms"),
                    F.round("max_offset_ms", 3).alias("max_offset_ms"), F.round("score", 6).alias("score"), "quality")


@query("j13_hook_boost", f"""
WITH ev AS (SELECT track_id, seq, t AS et, base_strength AS s FROM v_trigger), pts AS (SELECT track_id, t FROM v_trigger WHERE trigger_type = 'snare'), {NEAR}
SELECT track_id, seq, round(CASE WHEN abs(et - near_t) < 7200e0
  THEN least(1e0, greatest(0e0, s * (1e0 + 0.5e0 * (1e0 - abs(et - near_t) / 7200e0)))) ELSE s END, 6) AS strength FROM near""")
def _(v):
    rows = v.trigger.select("track_id", "seq", "t", F.col("base_strength").alias("strength"))
    hooks = v.trigger.filter("trigger_type = 'snare'").select("track_id", "t")
    return sync.boost_at_hooks(rows, hooks, 7200.0, width=CHUNK).select("track_id", "seq", F.round("strength", 6).alias("strength"))


@query("j14_secondary_list_dedup", """
WITH RECURSIVE p AS (SELECT track_id, seq, t FROM v_trigger WHERE trigger_type = 'beat'),
k0 AS (SELECT k.track_id, k.seq, k.t, row_number() OVER (PARTITION BY k.track_id ORDER BY k.t, k.seq) AS rn FROM v_trigger k
  WHERE trigger_type = 'kick' AND NOT EXISTS (SELECT 1 FROM p WHERE p.track_id = k.track_id AND abs(p.t - k.t) < 3600e0)),
kw AS (SELECT track_id, rn, seq, t AS a, TRUE AS keep FROM k0 WHERE rn = 1
  UNION ALL SELECT k0.track_id, k0.rn, k0.seq, CASE WHEN k0.t - kw.a >= 3600e0 THEN k0.t ELSE kw.a END, k0.t - kw.a >= 3600e0
  FROM kw JOIN k0 ON k0.track_id = kw.track_id AND k0.rn = kw.rn + 1),
p2 AS (SELECT track_id, seq, t, 'beat' AS kind FROM p UNION ALL SELECT track_id, seq, a, 'kick' FROM kw WHERE keep),
e0 AS (SELECT k.track_id, k.seq, k.t, row_number() OVER (PARTITION BY k.track_id ORDER BY k.t, k.seq) AS rn FROM v_trigger k
  WHERE trigger_type = 'hihat' AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.track_id = k.track_id AND abs(p2.t - k.t) < 7200e0)),
ew AS (SELECT track_id, rn, seq, t AS a, TRUE AS keep FROM e0 WHERE rn = 1
  UNION ALL SELECT e0.track_id, e0.rn, e0.seq, CASE WHEN e0.t - ew.a >= 7200e0 THEN e0.t ELSE ew.a END, e0.t - ew.a >= 7200e0
  FROM ew JOIN e0 ON e0.track_id = ew.track_id AND e0.rn = ew.rn + 1),
u AS (SELECT * FROM p2 UNION ALL SELECT track_id, seq, a, 'energy_peak' FROM ew WHERE keep),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) - 1 AS i FROM u)
SELECT track_id, seq, kind FROM n WHERE i % 2 = 0""")
def _(v):
    from cadenza.operators.ordered import row_index

    def kind(old, new):
        return v.trigger.filter(F.col("trigger_type") == old).select("track_id", "seq", "t", F.lit(new).alias("kind"))

    merged = sync.merge_without_close(kind("beat", "beat"), (kind("kick", "kick"), 3600.0), (kind("hihat", "energy_peak"), 7200.0),
                                      width=CHUNK)
    numbered = row_index(merged, ["track_id"], ["t", "seq"], "i", CHUNK)
    return numbered.filter("i % 2 = 0").select("track_id", "seq", "kind")


@query("j15_suggestion_snap", f"""
WITH ev AS (SELECT track_id, seq, t AS et, base_strength AS s, trigger_type AS kind FROM v_trigger),
pts AS (SELECT track_id, t FROM v_trigger WHERE trigger_type = 'snare'), {NEAR}
SELECT n.track_id, n.seq, round(CASE WHEN abs(et - near_t) < 7200e0 THEN near_t ELSE et END, 6) AS t,
  round(s * CASE WHEN abs(et - near_t) < 7200e0 THEN 1.2e0 ELSE 1e0 END * CASE WHEN z.energy IS NULL THEN 1e0 ELSE 1e0 + z.energy * 0.5e0 END, 6) AS intensity,
  CASE WHEN z.energy IS NOT NULL THEN 'quality_zone' WHEN abs(et - near_t) < 7200e0 THEN 'ai_enhanced' ELSE kind END AS trigger_type
FROM near n LEFT JOIN v_segment z ON z.track_id = n.track_id AND z.seg_idx IN (1, 3) AND z.start_t <= n.et AND n.et <= z.end_t""")
def _(v):
    rows = v.trigger.select("track_id", "seq", "t", F.col("base_strength").alias("intensity"), "trigger_type")
    points = v.trigger.filter("trigger_type = 'snare'").select("track_id", "t")
    zones = v.segment.filter("seg_idx IN (1, 3)").withColumn("quality", F.col("energy").cast("double"))
    out = sync.snap_to_suggestions(rows, points, zones, within=7200.0, width=axis(v), chunk=axis(v))
    return out.select("track_id", "seq", F.round("t", 6).alias("t"), F.round("intensity", 6).alias("intensity"), "trigger_type")


#: beats by strength, each takes the best peak that is still free
MATCHED = f"""b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY strength DESC, t, seq) AS k FROM v_beat), z AS (SELECT track_id, count(*) AS n FROM v_beat GROUP BY track_id),
o AS (SELECT b.track_id, b.k, b.seq AS beat_seq, b.strength AS s, m.seq AS peak_seq, m.t AS mt, m.strength AS ms, (m.t - b.t) * 1000e0 AS off FROM b JOIN v_motion_peak m ON m.track_id = b.track_id AND abs((m.t - b.t) * 1000e0) <= 3600000e0),
c AS MATERIALIZED (SELECT *, {sync.TIMING_WEIGHT}e0 * (1e0 - abs(off) / 3600000e0) + {sync.STRENGTH_WEIGHT}e0 * least(s, ms) AS score FROM o),
w AS (SELECT track_id, CAST(0 AS BIGINT) AS k, n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM z UNION ALL
  SELECT track_id, k, n, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p FROM (SELECT w.track_id, w.k + 1 AS k, w.n, w.used, CAST(arg_min(c.peak_seq, ROW(-c.score, c.mt, c.peak_seq)) AS BIGINT) AS p
    FROM w LEFT JOIN c ON c.track_id = w.track_id AND c.k = w.k + 1 AND NOT list_contains(w.used, CAST(c.peak_seq AS BIGINT)) WHERE w.k < w.n GROUP BY w.track_id, w.k, w.n, w.used)),
x AS (SELECT c.track_id, c.beat_seq, c.peak_seq, c.off, c.score FROM w JOIN c ON c.track_id = w.track_id AND c.k = w.k AND c.peak_seq = w.pick)"""


@query("j12_beat_motion_matching", f"""
WITH RECURSIVE {MATCHED} SELECT track_id, beat_seq, peak_seq, round(off, 3) AS offset_ms, round(score, 6) AS confidence FROM x""")
def _(v):
    pairs = sync.match_beats(v.beat, v.motion_peak, 3_600_000.0, block=CHUNK)
    return pairs.select("track_id", "beat_seq", "peak_seq", F.round("offset_ms", 3).alias("offset_ms"),
                        F.round("confidence", 6).alias("confidence"))


@query("a16_sync_summary", f"""
WITH RECURSIVE {MATCHED}, d AS (SELECT track_id, abs(off) / 6000e0 AS off FROM x),
q AS (SELECT track_id, count(*) AS n_sync, round(avg(off), 6) AS average_offset_ms, round(max(off), 6) AS max_offset_ms, count(*) FILTER (off < 50) AS n_perfect, count(*) FILTER (off >= 50 AND off < 100) AS n_excellent,
  count(*) FILTER (off >= 100 AND off < 200) AS n_good, count(*) FILTER (off >= 200 AND off < 500) AS n_acceptable, count(*) FILTER (off >= 500) AS n_poor FROM d GROUP BY track_id)
SELECT z.track_id, z.n AS n_beats, coalesce(n_sync, 0) AS n_sync, average_offset_ms, max_offset_ms, coalesce(n_perfect, 0) AS n_perfect, coalesce(n_excellent, 0) AS n_excellent, coalesce(n_good, 0) AS n_good,
  coalesce(n_acceptable, 0) AS n_acceptable, coalesce(n_poor, 0) AS n_poor, (coalesce(n_perfect, 0) + coalesce(n_excellent, 0) + coalesce(n_good, 0)) / z.n AS sync_score, coalesce(n_sync, 0) / z.n AS beat_coverage
FROM z LEFT JOIN q ON q.track_id = z.track_id""")
def _(v):
    pairs = sync.match_beats(v.beat, v.motion_peak, 3_600_000.0, block=CHUNK)
    # offsets are in hours here; scale them so that the quality classes spread
    scaled = pairs.withColumn("offset_ms", F.col("offset_ms") / 6000.0)
    out = sync.sync_summary(scaled, v.beat)
    return out.withColumn("average_offset_ms", F.round("average_offset_ms", 6)).withColumn("max_offset_ms", F.round("max_offset_ms", 6))


@query("a16_sync_quality_classes", """
WITH d AS (SELECT b.track_id, min(abs(m.t - b.t)) / 6e0 AS off FROM v_beat b JOIN v_motion_peak m ON m.track_id = b.track_id
  AND abs(m.t - b.t) <= 3600e0 GROUP BY b.track_id, b.seq)
SELECT CASE WHEN off < 50 THEN 'PERFECT' WHEN off < 100 THEN 'EXCELLENT' WHEN off < 200 THEN 'GOOD' WHEN off < 500 THEN 'ACCEPTABLE'
  ELSE 'POOR' END AS quality, count(*) AS n FROM d GROUP BY 1""")
def _(v):
    close = timejoin.nearest(v.beat, v.motion_peak.select("track_id", "t"), ["track_id"], "t", "t", width=CHUNK).filter(F.col("distance") <= HOUR)
    off = close.select((F.col("distance") / 6.0).alias("off"))
    return off.groupBy(sync.sync_quality(F.col("off")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("a17_global_offset", """
WITH a AS (SELECT DISTINCT track_id, CAST(trunc(t / 900e0) AS BIGINT) AS b FROM v_beat),
m AS (SELECT DISTINCT track_id, CAST(trunc(t / 900e0) AS BIGINT) AS b FROM v_motion_peak),
c AS (SELECT a.track_id, m.b - a.b AS lag, count(*) AS n FROM a JOIN m ON m.track_id = a.track_id AND abs(m.b - a.b) <= 20 GROUP BY 1, 2),
r AS (SELECT track_id, lag, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, lag) AS k FROM c),
s AS (SELECT b.track_id, count(*) AS nb FROM v_beat b GROUP BY b.track_id), q AS (SELECT track_id, count(*) AS np FROM v_motion_peak GROUP BY track_id)
SELECT s.track_id, CASE WHEN s.nb >= 2 AND q.np >= 2 THEN coalesce(r.lag, 0) ELSE 0 END * 900e0 AS "offset"
FROM s LEFT JOIN q ON q.track_id = s.track_id LEFT JOIN r ON r.track_id = s.track_id AND r.k = 1""")
def _(v):
    return sync.global_offset(v.beat, v.motion_peak, 900.0, 18_000.0)


@query("a09_usage_range_merge", """
WITH o AS (SELECT clip_id, start_t, end_t, max(end_t) OVER (PARTITION BY clip_id ORDER BY start_t, end_t
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_usage),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_t > reach + 0.5e0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_t, end_t
  ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT clip_id, min(start_t) AS start_t, max(end_t) AS end_t, count(*) AS n_ranges FROM i GROUP BY clip_id, island""")
def _(v):
    used = v.usage.select("clip_id", "start_t", "end_t")
    return intervals.merge_ranges(used, ["clip_id"], width=borders(used, ["clip_id"], "start_t", ROWS))


@query("w14_duration_to_next_cut", f"""
WITH RECURSIVE {SUPPRESSED} SELECT track_id, seq, round(lead(t, 1, 2592000e0) OVER (PARTITION BY track_id ORDER BY t, seq) - t, 6) AS duration FROM cuts""")
def _(v):
    out = intervals.with_next_start(cuts(v), ["track_id"], "t", ["seq"], 2_592_000.0, axis(v))
    return out.select("track_id", "seq", F.round(F.col("next_t") - F.col("t"), 6).alias("duration"))


@query("w22_overlap_violations", """
WITH o AS (SELECT clip_id, track_id, start_t, end_t, lag(end_t) OVER w AS pe, lag(start_t) OVER w AS ps FROM v_usage
  WINDOW w AS (PARTITION BY clip_id ORDER BY track_id, start_t, end_t))
SELECT clip_id, track_id, start_t, end_t, pe > start_t AS overlaps, ps > start_t AS out_of_order FROM o WHERE pe > start_t OR ps > start_t""")
def _(v):
    return intervals.violations(v.usage, ["clip_id"], order=("track_id", "start_t", "end_t"), width=20_000.0)


@query("w22_list_totals", """
WITH s AS (SELECT clip_id, max(end_t) AS span, count(*) AS n_cuts FROM v_usage GROUP BY clip_id)
SELECT p.clip_id, s.span, coalesce(s.n_cuts, 0) AS n_cuts, CASE WHEN s.n_cuts IS NULL THEN FALSE ELSE abs(s.span - 2560e0) <= 0.01e0 END AS span_ok,
  coalesce(s.n_cuts, 0) <= 10000 AS count_ok, TRUE AS duration_ok FROM v_clip p LEFT JOIN s ON s.clip_id = p.clip_id""")
def _(v):
    totals = v.clip.select("clip_id", F.lit(2560.0).alias("total"))
    return intervals.summary_checks(v.usage, totals, ["clip_id"]).drop("total")


@query("w22_conflicts_with_existing", """
WITH n AS (SELECT clip_id, track_id, start_t, end_t FROM v_usage WHERE track_id % 8 = 0),
e AS (SELECT clip_id, track_id, start_t, end_t FROM v_usage WHERE track_id % 8 <> 0)
SELECT n.clip_id, n.track_id AS new_seq, e.track_id AS old_seq, n.start_t AS new_start_t, n.end_t AS new_end_t, e.start_t AS old_start_t, e.end_t AS old_end_t
FROM n JOIN e ON e.clip_id = n.clip_id AND n.start_t < e.end_t AND n.end_t > e.start_t""")
def _(v):
    rows = v.usage.withColumnRenamed("track_id", "seq")
    return intervals.conflicts(rows.filter("seq % 8 = 0"), rows.filter("seq % 8 <> 0"), ["clip_id"], 50.0)




@query("w22_conflict_counts", """
WITH n AS (SELECT clip_id, track_id, start_t, end_t FROM v_usage WHERE track_id % 8 = 0),
e AS (SELECT clip_id, start_t, end_t FROM v_usage WHERE track_id % 8 <> 0)
SELECT clip_id, track_id AS seq, start_t, end_t, (SELECT count(*) FROM e WHERE e.clip_id = n.clip_id AND n.start_t < e.end_t AND n.end_t > e.start_t) AS n_conflicts FROM n""")
def _(v):
    rows = v.usage.withColumnRenamed("track_id", "seq")
    return intervals.conflict_counts(rows.filter("seq % 8 = 0"), rows.filter("seq % 8 <> 0"), ["clip_id"], 365.0).select("clip_id", "seq", "start_t", "end_t", "n_conflicts")
