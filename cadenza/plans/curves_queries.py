"""Queries over sampled curves, emotion curves, peaks and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import curves, peaks, structure
from cadenza.operators.ordered import exact_percentile, row_index
from cadenza.plans.registry import query
from cadenza.plans.walks_queries import CHUNK
from cadenza.session import materialize

KEY = ["track_id"]
NUM = "n AS (SELECT track_id, t, energy, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY track_id) AS sz FROM v_energy)"
LOOK = """p0 AS (SELECT e.*, p.t AS t0, p.v AS v0, p.a AS a0, n.t AS t1, n.v AS v1, n.a AS a1 FROM ask e
  ASOF LEFT JOIN cur p ON e.track_id = p.track_id AND e.et >= p.t ASOF LEFT JOIN cur n ON e.track_id = n.track_id AND e.et <= n.t),
lk AS (SELECT *, CASE WHEN t0 = et THEN v0 WHEN t0 IS NULL OR t1 IS NULL THEN coalesce(v0, v1) ELSE v0 + (et - t0) / (t1 - t0) * (v1 - v0) END AS v,
  CASE WHEN t0 = et THEN a0 WHEN t0 IS NULL OR t1 IS NULL THEN coalesce(a0, a1) ELSE a0 + (et - t0) / (t1 - t0) * (a1 - a0) END AS a FROM p0)"""
EMO = "cur AS (SELECT track_id, t, energy * 2e0 - 1e0 AS v, energy AS a FROM v_energy)"


def numbered(v):
    return row_index(v.energy, KEY, ["t"], "idx", CHUNK)


def emotion(v):
    """Stand-in emotion curve: valence and arousal from the energy curve."""
    return v.energy.select("track_id", "t", (F.col("energy") * 2 - 1).alias("valence"), F.col("energy").alias("arousal"))


@query("w01_moving_average", f"""
WITH {NUM} SELECT track_id, t, round(CASE WHEN sz < 3 THEN energy ELSE avg(energy) OVER (PARTITION BY track_id ORDER BY idx
  ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END, 9) AS energy FROM n""")
def _(v):
    out = curves.moving_average(numbered(v), KEY, "idx", ["energy"], 6)
    return out.select("track_id", "t", F.round("energy", 9).alias("energy"))


@query("w02_gaussian_smoothing", f"""
WITH {NUM}, w AS (SELECT k, exp(-0.5e0 * (k / 3e0) * (k / 3e0)) AS g FROM (SELECT unnest(range(-12, 13)) AS k)),
s AS (SELECT sum(g) AS tot FROM w), x AS (SELECT n.track_id, n.t, n.idx, n.sz, g / tot AS wt,
  ((n.idx + k) % (2 * n.sz) + 2 * n.sz) % (2 * n.sz) AS m FROM n, w, s),
y AS (SELECT track_id, t, idx, wt, CASE WHEN m < sz THEN m ELSE 2 * sz - 1 - m END AS src FROM x)
SELECT y.track_id, y.t, round(sum(wt * n.energy), 6) AS energy FROM y JOIN n ON n.track_id = y.track_id AND n.idx = y.src GROUP BY y.track_id, y.t""")
def _(v):
    out = curves.gaussian(numbered(v), KEY, "idx", "energy")
    return out.select("track_id", "t", F.round("energy", 6).alias("energy"))


@query("w02_savgol_smoothing", f"""
WITH {NUM}, b AS (SELECT *, least(51, CASE WHEN sz % 2 = 1 THEN sz ELSE sz - 1 END) AS wl FROM n),
c AS (SELECT *, (wl - 1) / 2 AS m, least(greatest(idx - (wl - 1) / 2, 0), sz - wl) AS st FROM (SELECT * REPLACE (CAST(wl AS BIGINT) AS wl) FROM b)),
d AS (SELECT c.track_id, c.t, c.energy AS own, c.wl, CAST(c.idx - c.st AS DOUBLE) - CAST(c.wl // 2 AS DOUBLE) AS x,
  CAST(s.idx - c.st AS DOUBLE) - CAST(c.wl // 2 AS DOUBLE) AS u, s.energy AS y
  FROM (SELECT track_id, t, energy, idx, sz, wl, CAST(least(greatest(idx - wl // 2, 0), sz - wl) AS BIGINT) AS st FROM b) c
  JOIN n s ON s.track_id = c.track_id AND s.idx >= c.st AND s.idx < c.st + c.wl),
f AS (SELECT track_id, t, any_value(own) AS own, any_value(wl) AS wl, any_value(x) AS x, sum(y) / count(*) AS f0, sum(u * y) / sum(u * u) AS f1,
  sum((u*u - (wl*wl-1)/12e0) * y) / sum((u*u - (wl*wl-1)/12e0) * (u*u - (wl*wl-1)/12e0)) AS f2,
  sum((u*u*u - u*(3*wl*wl-7)/20e0) * y) / sum((u*u*u - u*(3*wl*wl-7)/20e0) * (u*u*u - u*(3*wl*wl-7)/20e0)) AS f3 FROM d WHERE wl >= 5 GROUP BY track_id, t)
SELECT track_id, t, round(f0 + f1 * x + f2 * (x*x - (wl*wl-1)/12e0) + f3 * (x*x*x - x*(3*wl*wl-7)/20e0), 6) AS energy FROM f""")
def _(v):
    out = curves.savgol(numbered(v), KEY, "idx", "energy")
    sizes = v.energy.groupBy("track_id").count().filter("count >= 5").select("track_id")
    return out.join(sizes, "track_id", "left_semi").select("track_id", "t", F.round("energy", 6).alias("energy"))


@query("w02_median_smoothing", f"""
WITH {NUM}, b AS (SELECT *, least(11, CASE WHEN sz % 2 = 1 THEN sz ELSE sz - 1 END) AS wl FROM n),
c AS (SELECT b.track_id, b.t, b.wl, list(s.energy) AS l FROM b JOIN n s ON s.track_id = b.track_id AND abs(s.idx - b.idx) <= b.wl // 2 GROUP BY b.track_id, b.t, b.wl)
SELECT track_id, t, list_sort(list_concat(l, list_resize([]::DOUBLE[], wl - len(l), 0e0)))[wl // 2 + 1] AS energy FROM c""")
def _(v):
    return curves.median(numbered(v), KEY, "idx", "energy").select("track_id", "t", "energy")


@query("w03_framed_rms", """
WITH n AS (SELECT track_id, base_strength AS x, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) - 1 AS i,
  count(*) OVER (PARTITION BY track_id) AS sz FROM v_trigger),
f AS (SELECT track_id, unnest(range(0, sz // 4 + 1)) AS frame FROM (SELECT DISTINCT track_id, sz FROM n)),
r AS (SELECT f.track_id, f.frame, sqrt(sum(x * x) / 16) AS rms FROM f JOIN n ON n.track_id = f.track_id AND n.i >= f.frame * 4 - 8 AND n.i < f.frame * 4 + 8
  GROUP BY f.track_id, f.frame)
SELECT track_id, frame, round(rms / max(rms) OVER (PARTITION BY track_id), 6) AS energy FROM r""")
def _(v):
    samples = row_index(v.trigger, KEY, ["t", "seq"], "i", CHUNK)
    rms = curves.normalised(curves.frame_rms(samples, KEY, "i", "base_strength", 16, 4), KEY, "rms")
    return rms.select("track_id", "frame", F.round("rms", 6).alias("energy"))


@query("s14_waveform_rms", """
WITH n AS (SELECT track_id, base_strength AS x, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS sz FROM v_trigger),
b AS (SELECT *, greatest(1, sz // 20) AS spp FROM n), c AS (SELECT *, least(i // spp, sz // spp - 1) AS pixel FROM b)
SELECT track_id, pixel, round(-sqrt(avg(x * x)), 6) AS low, round(sqrt(avg(x * x)), 6) AS high FROM c GROUP BY track_id, pixel""")
def _(v):
    samples = row_index(v.trigger, KEY, ["t", "seq"], "i", CHUNK)
    out = curves.waveform(samples, KEY, "i", "base_strength", 20)
    return out.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("s14_waveform_peaks", """
WITH n AS (SELECT track_id, base_strength AS x, row_number() OVER (PARTITION BY track_id ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS sz FROM v_trigger),
b AS (SELECT *, greatest(1, sz // 20) AS spp FROM n), c AS (SELECT *, least(i // spp, sz // spp - 1) AS pixel FROM b)
SELECT track_id, pixel, min(x) AS low, max(x) AS high FROM c GROUP BY track_id, pixel""")
def _(v):
    samples = row_index(v.trigger, KEY, ["t", "seq"], "i", CHUNK)
    return curves.waveform(samples, KEY, "i", "base_strength", 20, rms=False)


@query("w05_local_maxima_above_percentile", """
WITH n AS (SELECT track_id, t, energy AS x, lag(energy) OVER w AS p FROM v_energy WINDOW w AS (PARTITION BY track_id ORDER BY t)),
r AS (SELECT * FROM n WHERE p IS NULL OR p <> x), m AS (SELECT track_id, t, x, lag(x) OVER w AS lo, lead(x) OVER w AS hi FROM r WINDOW w AS (PARTITION BY track_id ORDER BY t)),
q AS (SELECT track_id, quantile_cont(energy, 0.75) AS h FROM v_energy GROUP BY track_id)
SELECT m.track_id, m.t, m.x AS energy FROM m JOIN q ON q.track_id = m.track_id WHERE lo < x AND hi < x AND x >= h""")
def _(v):
    tops = peaks.local_maxima(v.energy, KEY, "t", "energy", CHUNK)
    height = exact_percentile(v.energy, KEY, "energy", 0.75, "h", 0.25)
    return tops.join(height, "track_id").filter("energy >= h").select("track_id", "t", "energy")


def peaks_sql(source: str, distance: int, prominence: str) -> str:
    """CTEs `fin` (track_id, idx, x): local maxima of `source`, thinned from the highest down, then by prominence."""
    return f"""fl AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY track_id ORDER BY idx) = x THEN 0 ELSE 1 END AS fresh FROM {source}),
pl AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY idx) AS g FROM fl), pp AS (SELECT track_id, g, min(idx) AS i, max(idx) AS j, min(x) AS x FROM pl GROUP BY track_id, g),
tp AS (SELECT track_id, (i + j) // 2 AS p, x FROM (SELECT *, lag(x) OVER v AS a, lead(x) OVER v AS b FROM pp WINDOW v AS (PARTITION BY track_id ORDER BY g)) WHERE a < x AND b < x),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, p DESC) AS k FROM tp),
w AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM o UNION ALL
  SELECT o.track_id, o.k, CASE WHEN len(list_filter(w.kept, lambda y: abs(y - o.p) < {distance})) = 0 THEN list_append(w.kept, o.p) ELSE w.kept END FROM w JOIN o ON o.track_id = w.track_id AND o.k = w.k + 1),
kp AS (SELECT o.track_id, o.p, o.x FROM o JOIN (SELECT track_id, arg_max(kept, k) AS kept FROM w GROUP BY track_id) f ON f.track_id = o.track_id WHERE list_contains(f.kept, o.p)),
sd AS (SELECT kp.track_id, kp.p, kp.x, max(s.idx) FILTER (s.idx < kp.p AND s.x <= kp.x - {prominence}) AS low_l, max(s.idx) FILTER (s.idx < kp.p AND s.x > kp.x) AS high_l,
  min(s.idx) FILTER (s.idx > kp.p AND s.x <= kp.x - {prominence}) AS low_r, min(s.idx) FILTER (s.idx > kp.p AND s.x > kp.x) AS high_r FROM kp JOIN {source} s ON s.track_id = kp.track_id GROUP BY kp.track_id, kp.p, kp.x),
fin AS (SELECT track_id, p AS idx, x FROM sd WHERE low_l > coalesce(high_l, -1) AND low_r < coalesce(high_r, 9223372036854775807))"""


@query("w05_peaks_by_distance_and_prominence", f"""
WITH RECURSIVE src AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx, energy AS x FROM v_energy), {peaks_sql('src', 4, '0.1e0')}
SELECT track_id, idx, x AS energy FROM fin""")
def _(v):
    return peaks.find_peaks(numbered(v), KEY, "idx", "energy", 4, 0.1)


@query("w06_emotion_peaks", """
WITH n AS (SELECT track_id, t, energy AS x, lag(energy) OVER w AS p, lead(energy) OVER w AS q FROM v_energy WINDOW w AS (PARTITION BY track_id ORDER BY t))
SELECT track_id, t FROM n WHERE x >= 0.7e0 AND NOT coalesce(p > x, FALSE) AND NOT coalesce(q > x, FALSE)""")
def _(v):
    return peaks.threshold_peaks(emotion(v), KEY, "t", "arousal", 0.7, CHUNK).select("track_id", "t")


@query("w07_emotion_gradient", f"""
WITH {EMO}, ask AS (SELECT track_id, seq, t, s, t + s * 21600e0 AS et FROM v_beat, (VALUES (-1e0), (1e0)) k(s)), {LOOK}
SELECT track_id, seq, round(sum(s * v) / 43200e0 * 1e6, 4) AS valence_gradient, round(sum(s * a) / 43200e0 * 1e6, 4) AS arousal_gradient FROM lk GROUP BY track_id, seq""")
def _(v):
    out = curves.gradient(v.beat, emotion(v), KEY, ["valence", "arousal"], 43_200.0, CHUNK)
    return out.select("track_id", "seq", F.round(F.col("valence_gradient") * 1e6, 4).alias("valence_gradient"),
                      F.round(F.col("arousal_gradient") * 1e6, 4).alias("arousal_gradient"))


@query("w08_interval_average_emotion", f"""
WITH {EMO}, ask AS (SELECT track_id, seg_idx, start_t + k * (end_t - start_t) / 29e0 AS et FROM v_segment, (SELECT unnest(range(0, 30)) AS k)), {LOOK}
SELECT track_id, seg_idx, round(avg(v), 9) AS valence, round(avg(a), 9) AS arousal FROM lk GROUP BY track_id, seg_idx""")
def _(v):
    out = curves.interval_average(v.segment, emotion(v), KEY, ["valence", "arousal"], ["seg_idx"], 30 / 432_000.0, CHUNK)
    return out.select("track_id", "seg_idx", F.round("valence", 9).alias("valence"), F.round("arousal", 9).alias("arousal"))


@query("w09_curve_from_segments", """
WITH e AS (SELECT * FROM (VALUES ('intro', 0e0, -0.3e0), ('verse', 0.2e0, 0e0), ('chorus', 0.6e0, 0.5e0), ('drop', 0.5e0, 0.9e0), ('bridge', -0.1e0, -0.2e0),
  ('outro', 0.1e0, -0.4e0)) x(k, v, a)),
p AS (SELECT s.track_id, s.segment_type, s.seg_idx * 3 + part AS o, CASE part WHEN 0 THEN start_t WHEN 1 THEN (start_t + end_t) / 2 ELSE end_t END AS t,
  greatest(-1e0, least(1e0, e.v + (s.energy - 0.5e0) * 0.3e0)) AS v, greatest(-1e0, least(1e0, e.a + (s.energy - 0.5e0) * 0.5e0)) AS a
  FROM v_segment s JOIN e ON e.k = s.segment_type, (VALUES (0), (1), (2)) q(part)),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, o) - 1 AS idx FROM p WHERE t BETWEEN 0 AND 2592000e0)
SELECT track_id, idx, segment_type, round(avg(v) OVER w, 9) AS valence, round(avg(a) OVER w, 9) AS arousal FROM n
WINDOW w AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(v):
    rows = v.segment.withColumn("duration", F.lit(2_592_000.0)).withColumn("energy", F.col("energy").cast("double"))
    out = curves.emotion_from_segments(rows, "duration", KEY, 3, CHUNK)
    return out.select("track_id", "idx", "segment_type", F.round("valence", 9).alias("valence"), F.round("arousal", 9).alias("arousal"))


@query("w10_curve_from_features", """
WITH k AS (SELECT track_id, unnest(range(0, 61)) AS idx FROM v_track), ask AS (SELECT track_id, idx, idx * (2592000e0 / 60) AS et FROM k),
p0 AS (SELECT e.*, p.t AS t0, p.energy AS e0, n.t AS t1, n.energy AS e1 FROM ask e ASOF LEFT JOIN v_energy p ON e.track_id = p.track_id AND e.et >= p.t
  ASOF LEFT JOIN v_energy n ON e.track_id = n.track_id AND e.et <= n.t),
l AS (SELECT track_id, idx, et, CASE WHEN t0 = et THEN e0 WHEN t0 IS NULL OR t1 IS NULL THEN coalesce(e0, e1) ELSE e0 + (et - t0) / (t1 - t0) * (e1 - e0) END AS en FROM p0),
m AS (SELECT l.*, greatest(-1e0, least(1e0, (en * 0.4e0 + 0.5e0 * 0.3e0 - 0.35e0) * 2)) AS v, greatest(-1e0, least(1e0, (en * 0.5e0 + en * 0.8e0 * 0.5e0 - 0.25e0) * 2)) AS a FROM l),
s AS (SELECT m.track_id, m.idx, arg_max(s.segment_type, s.seg_idx) AS segment_type FROM m JOIN v_segment s ON s.track_id = m.track_id
  AND trunc(s.start_t * 2) <= trunc(m.et * 2) AND trunc(m.et * 2) <= trunc(s.end_t * 2) GROUP BY m.track_id, m.idx)
SELECT m.track_id, m.idx, s.segment_type, round(avg(v) OVER w, 9) AS valence, round(avg(a) OVER w, 9) AS arousal FROM m LEFT JOIN s ON s.track_id = m.track_id AND s.idx = m.idx
WINDOW w AS (PARTITION BY m.track_id ORDER BY m.idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(v):
    curve = v.energy.withColumnRenamed("energy", "value")
    out = curves.emotion_from_features(v.track, {"energy": curve, "brightness": curve}, KEY, 60 / 2_592_000.0, v.segment, 3, CHUNK, CHUNK)
    return out.select("track_id", "idx", "segment_type", F.round("valence", 9).alias("valence"), F.round("arousal", 9).alias("arousal"))


FRAMES = """fr AS (SELECT track_id, idx, energy, abs(sin(idx / 5e0)) * energy AS f2 FROM n)"""


def frames(v):
    return numbered(v).withColumn("f2", F.abs(F.sin(F.col("idx") / 5.0)) * F.col("energy"))


NOVELTY = f"""{NUM}, {FRAMES}, d AS (SELECT track_id, idx, coalesce(abs(energy - lag(energy) OVER w) + abs(f2 - lag(f2) OVER w), 0) AS x FROM fr WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
s AS (SELECT track_id, idx, sum(x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS x FROM d),
l AS (SELECT track_id, idx, sum(x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS x FROM s)"""


@query("w11_novelty_curve", f"WITH {NOVELTY} SELECT track_id, idx, round(x / max(x) OVER (PARTITION BY track_id), 6) AS novelty FROM l")
def _(v):
    out = structure.novelty(frames(v), KEY, ["energy", "f2"], 3, 6)
    return out.select("track_id", "idx", F.round("novelty", 6).alias("novelty"))


@query("w11_segment_boundaries", f"""
WITH RECURSIVE {NOVELTY}, c AS (SELECT track_id, idx, x / max(x) OVER (PARTITION BY track_id) AS x FROM l),
a AS (SELECT *, max(x) OVER v AS top, avg(x) OVER v AS mean FROM c WINDOW v AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)), h AS MATERIALIZED (SELECT track_id, idx FROM a WHERE x = top AND x >= mean + 0.1e0),
w AS (SELECT track_id, min(idx) AS idx FROM h GROUP BY track_id UNION ALL SELECT h.track_id, min(h.idx) FROM w JOIN h ON h.track_id = w.track_id AND h.idx > w.idx + 4 GROUP BY h.track_id),
e AS (SELECT track_id, max(idx) AS last, arg_min(idx, ROW(-x, idx)) AS top FROM c GROUP BY track_id)
SELECT track_id, idx FROM w UNION SELECT track_id, 0 FROM e UNION SELECT track_id, last FROM e UNION SELECT track_id, top FROM e WHERE top > 0 AND top < last AND track_id NOT IN (SELECT track_id FROM h)""")
def _(v):
    # read several times below, so it is written once
    curve = materialize(structure.novelty(frames(v), KEY, ["energy", "f2"], 3, 6), "novelty")
    return structure.boundaries(curve, KEY, 4, 0.1, width=100_000.0)


LABEL = """CASE WHEN i = 0 THEN 'intro' WHEN st / dur < 0.15e0 AND en < 0.9e0 THEN 'intro' WHEN i = tot - 2 THEN 'outro' WHEN st / dur > 0.85e0 AND en < 0.9e0 THEN 'outro'
  WHEN st / dur > 0.4e0 AND st / dur < 0.6e0 AND en > 0.85e0 AND en < 1.15e0 THEN 'bridge' WHEN en > 1.4e0 THEN 'drop' WHEN en > 1.15e0 THEN 'chorus' ELSE 'verse' END"""


def medians(v):
    return exact_percentile(v.energy, KEY, "energy", 0.5, "median", 0.25)


@query("a23_segment_energy_vs_median", """
WITH m AS (SELECT track_id, median(energy) AS med FROM v_energy GROUP BY track_id),
s AS (SELECT track_id, CAST(floor(t / 432000e0) AS BIGINT) AS seg_idx, avg(energy) AS e FROM v_energy GROUP BY 1, 2)
SELECT s.track_id, s.seg_idx, round(s.e / greatest(m.med, 1e-8), 6) AS relative FROM s JOIN m ON m.track_id = s.track_id""")
def _(v):
    out = curves.segment_energy(v.energy, medians(v), F.floor(F.col("t") / 432_000.0), "energy", KEY)
    return out.select("track_id", "seg_idx", F.round("relative", 6).alias("relative"))


@query("w12_segment_labels", f"""
WITH m AS (SELECT track_id, median(energy) AS med FROM v_energy GROUP BY track_id),
s AS (SELECT v.track_id, v.seg_idx AS i, v.start_t AS st, 2592000e0 AS dur, 6 AS tot, (SELECT avg(e.energy) FROM v_energy e WHERE e.track_id = v.track_id AND e.t >= v.start_t AND e.t < v.end_t)
  / greatest(m.med, 1e-8) AS en FROM v_segment v JOIN m ON m.track_id = v.track_id)
SELECT track_id, i AS seg_idx, {LABEL} AS segment_type FROM s WHERE en IS NOT NULL""")
def _(v):
    level = curves.segment_energy(v.energy, medians(v), F.floor(F.col("t") / 432_000.0), "energy", KEY)
    rows = level.join(v.segment.select("track_id", "seg_idx", "start_t"), ["track_id", "seg_idx"])
    label = curves.segment_label(F.col("seg_idx"), F.lit(6), F.col("relative"), F.col("start_t"), F.lit(2_592_000.0))
    return rows.select("track_id", "seg_idx", label.alias("segment_type"))


@query("w13_fixed_segments", f"""
WITH m AS (SELECT track_id, median(energy) AS med FROM v_energy GROUP BY track_id),
g AS (SELECT track_id, unnest(range(0, 13)) AS i FROM v_track), e AS (SELECT track_id, CAST(floor(t / 200000e0) AS BIGINT) AS i, avg(energy) AS e FROM v_energy GROUP BY 1, 2),
s AS (SELECT g.track_id, g.i, g.i * 200000e0 AS st, 2592000e0 AS dur, 13 AS tot, coalesce(e.e / greatest(m.med, 1e-8), 1e0) AS en FROM g LEFT JOIN e ON e.track_id = g.track_id AND e.i = g.i
  JOIN m ON m.track_id = g.track_id)
SELECT track_id, i AS seg_idx, st AS start_t, least(st + 200000e0, dur) AS end_t, {LABEL} AS segment_type, round(least(1e0, en), 6) AS energy FROM s""")
def _(v):
    out = curves.fixed_segments(v.energy, medians(v), v.track, "energy", KEY, 200_000.0)
    return out.withColumn("energy", F.round("energy", 6))


@query("w28_melody_stabs", """
WITH m AS (SELECT track_id, max(strength) AS top FROM v_motion_peak GROUP BY track_id)
SELECT p.track_id, p.seq, round(p.strength / (m.top + 1e-10), 6) AS strength FROM v_motion_peak p JOIN m ON m.track_id = p.track_id WHERE p.strength / (m.top + 1e-10) > 0.6e0""")
def _(v):
    return structure.stabs(v.motion_peak, KEY).select("track_id", "seq", F.round("strength", 6).alias("strength"))


@query("w28_melody_presence", """
WITH m AS (SELECT track_id, max(energy) AS top FROM v_energy GROUP BY track_id)
SELECT e.track_id, round(avg(CASE WHEN e.energy / (m.top + 1e-10) > 0.15e0 THEN 1e0 ELSE 0e0 END), 6) AS presence FROM v_energy e JOIN m ON m.track_id = e.track_id GROUP BY e.track_id""")
def _(v):
    return structure.presence_ratio(v.energy, KEY, "energy").withColumn("presence", F.round("presence", 6))


@query("w28_melody_hooks", f"""
WITH RECURSIVE lv AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx, energy / (max(energy) OVER (PARTITION BY track_id) + 1e-10) AS x, count(*) OVER (PARTITION BY track_id) AS n FROM v_energy),
src AS (SELECT track_id, idx, CASE WHEN n > 3 THEN sum(x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 ELSE x END AS x FROM lv), {peaks_sql('src', 6, '0.15e0')}
SELECT track_id, idx, round(x, 6) AS strength FROM fin""")
def _(v):
    return structure.hooks(numbered(v), KEY, "idx", "energy", 3, 6, 0.15).withColumn("strength", F.round("strength", 6))


@query("a21_spectral_summary", """
SELECT clip_id, round(avg(brightness), 6) AS bright_mean, round(var_pop(brightness), 4) AS bright_variance, round(stddev_pop(brightness), 6) AS bright_std,
  round(avg(magnitude), 6) AS flow_mean, round(var_pop(magnitude), 6) AS flow_variance, round(stddev_pop(magnitude), 6) AS flow_std,
  round(avg(brightness) / 127.5e0, 6) AS brightness FROM v_frame GROUP BY clip_id""")
def _(v):
    long = v.frame.select("clip_id", F.inline(F.array(
        F.struct(F.lit("bright").alias("feature"), F.col("brightness").alias("value")),
        F.struct(F.lit("flow").alias("feature"), F.col("magnitude").alias("value")))))
    out = curves.spectral_summary(long, ["clip_id"], "feature", "value", ["bright", "flow"])
    places = {"bright_variance": 4}
    return out.select("clip_id", *[F.round(c, places.get(c, 6)).alias(c) for c in out.columns if c != "clip_id"],
                      F.round(F.col("bright_mean") / 127.5, 6).alias("brightness"))
