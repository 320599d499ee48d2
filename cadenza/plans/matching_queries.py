"""Queries that score clips against targets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cadenza.functions import moods
from cadenza.operators import durations, knn, matching, palette, selection, vectorops
from cadenza.plans.registry import query

# one target per segment of every track: mood by segment and track, energy of the segment
TARGETS = """SELECT track_id * 10 + seg_idx AS target_id, track_id, seg_idx, CAST(energy AS DOUBLE) AS energy, CAST(energy AS DOUBLE) AS level, segment_type,
  CASE (track_id + seg_idx) % 5 WHEN 0 THEN 'CALM' WHEN 1 THEN 'ENERGETIC' WHEN 2 THEN 'DARK' WHEN 3 THEN 'CHEERFUL' ELSE 'TENSE' END AS mood,
  CASE WHEN energy < 0.2e0 THEN 'STATIC' WHEN energy < 0.4e0 THEN 'SLOW' WHEN energy < 0.6e0 THEN 'MEDIUM' WHEN energy < 0.8e0 THEN 'FAST' ELSE 'EXTREME' END AS motion FROM v_segment"""
COMPAT = "compat AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in moods.COMPATIBLE.items() for b in bs) + ") c(target, mood))"
MOODS = """cm AS (SELECT clip_id, energy, json_extract_string(moods, '$[0]') AS m1, json_extract_string(moods, '$[1]') AS m2 FROM v_clip_mood)"""
MOOD_SCORE = f"""{COMPAT}, {MOODS}, tm AS (SELECT DISTINCT mood, energy FROM t),
md AS (SELECT DISTINCT m1, m2 FROM cm), tg AS (SELECT DISTINCT mood FROM t),
lv AS (SELECT tg.mood, md.m1, md.m2, (SELECT count(*) FROM compat c WHERE c.target = tg.mood AND c.mood = md.m1) + (SELECT count(*) FROM compat c WHERE c.target = tg.mood AND c.mood = md.m2) AS n FROM tg, md),
ms AS (SELECT tm.mood, tm.energy, cm.clip_id, least(1e0, CASE WHEN tm.mood IN (cm.m1, cm.m2) THEN 0.5e0 WHEN lv.n > 0 THEN 0.3e0 ELSE 0e0 END + CASE WHEN lv.n > 1 THEN 0.2e0 ELSE 0e0 END
  + greatest(0e0, 0.3e0 - abs(cm.energy - tm.energy) * 0.5e0)) AS score FROM tm JOIN cm ON TRUE JOIN lv ON lv.mood = tm.mood AND lv.m1 = cm.m1 AND lv.m2 = cm.m2),
mr AS (SELECT *, row_number() OVER (PARTITION BY mood, energy ORDER BY round(score, 9) DESC, clip_id) AS rank FROM ms WHERE round(score, 9) > 0)"""
MOTION_SCORE = """tn AS (SELECT DISTINCT motion, level FROM t), o AS (SELECT * FROM (VALUES ('STATIC', 1), ('SLOW', 2), ('MEDIUM', 3), ('FAST', 4), ('EXTREME', 5)) x(k, i)),
ns AS (SELECT tn.motion, tn.level, m.clip_id, least(1e0, CASE abs(a.i - b.i) WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.2e0 ELSE 0e0 END + greatest(0e0, 0.3e0 - abs(m.motion_score - tn.level) * 0.5e0)) AS score
  FROM tn JOIN v_clip_motion m ON TRUE JOIN o a ON a.k = tn.motion JOIN o b ON b.k = m.motion_type),
nr AS (SELECT *, row_number() OVER (PARTITION BY motion, level ORDER BY round(score, 9) DESC, clip_id) AS rank FROM ns WHERE round(score, 9) > 0)"""


#: the scores of the other strategies: a step of the energy instead of its closeness; other points for motion classes
OTHER_MOOD = {k: MOOD_SCORE.replace("greatest(0e0, 0.3e0 - abs(cm.energy - tm.energy) * 0.5e0)", f"CASE WHEN round(abs(cm.energy - tm.energy), 9) {test} THEN 0.3e0 ELSE 0e0 END")
              for k, test in (("exact", "< 0.1e0"), ("contrast", "> 0.5e0"))}
OTHER_MOTION = {
    "exact": MOTION_SCORE.replace("WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.2e0 ", ""),
    "contrast": MOTION_SCORE.replace("CASE abs(a.i - b.i) WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.2e0 ELSE 0e0 END + greatest(0e0, 0.3e0 - abs(m.motion_score - tn.level) * 0.5e0)",
                                     "CASE WHEN abs(a.i - b.i) >= 2 THEN 0.4e0 ELSE 0e0 END")}


def targets(v):
    return v.sql(TARGETS)


def clip_moods(v):
    return v.clip_mood.select("clip_id", "energy", F.from_json("moods", "array<string>").alias("moods"))


def ranked(df, *cols):
    return df.select("target_id", "clip_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"), *cols)


@query("j16_top_clips_by_mood", f"WITH t AS ({TARGETS}), {MOOD_SCORE} SELECT t.target_id, mr.clip_id, round(mr.score, 9) AS score, mr.rank FROM t JOIN mr ON mr.mood = t.mood AND mr.energy = t.energy WHERE mr.rank <= 10")
def _(v):
    return ranked(matching.best_by_mood(targets(v), clip_moods(v), 10))


@query("j16_top_clips_by_motion", f"WITH t AS ({TARGETS}), {MOTION_SCORE} SELECT t.target_id, nr.clip_id, round(nr.score, 9) AS score, nr.rank FROM t JOIN nr ON nr.motion = t.motion AND nr.level = t.level WHERE nr.rank <= 10")
def _(v):
    return ranked(matching.best_by_motion(targets(v), v.clip_motion, 10))


def _by_strategy(strategy):
    """The top-k queries of a strategy beside `similar`."""
    mood, motion = OTHER_MOOD[strategy], OTHER_MOTION[strategy]
    both = lambda t, k: f"WITH t AS ({t}), " + COMBINED.replace(MOOD_SCORE, mood).replace(MOTION_SCORE, motion) % {"a": "0.6e0", "b": "0.4e0", "k": k}

    @query(f"j16_top_clips_by_mood_{strategy}", f"WITH t AS ({TARGETS}), {mood} SELECT t.target_id, mr.clip_id, round(mr.score, 9) AS score, mr.rank FROM t JOIN mr ON mr.mood = t.mood AND mr.energy = t.energy WHERE mr.rank <= 10")
    def _(v):
        return ranked(matching.best_by_mood(targets(v), clip_moods(v), 10, strategy=strategy))

    @query(f"j16_top_clips_by_motion_{strategy}", f"WITH t AS ({TARGETS}), {motion} SELECT t.target_id, nr.clip_id, round(nr.score, 9) AS score, nr.rank FROM t JOIN nr ON nr.motion = t.motion AND nr.level = t.level WHERE nr.rank <= 10")
    def _(v):
        return ranked(matching.best_by_motion(targets(v), v.clip_motion, 10, strategy=strategy))

    @query(f"m03_weighted_combination_{strategy}", both(TARGETS, 10) + " SELECT target_id, clip_id, round(score, 9) AS score, rank FROM r")
    def _(v):
        return ranked(matching.best_combined(targets(v), v.clip_motion, clip_moods(v), 10, strategy=strategy))

    @query(f"m04_curve_to_clips_{strategy}", both(CURVE, 3) + " SELECT target_id, clip_id, round(score, 9) AS score, rank FROM r WHERE rank <= 3")
    def _(v):
        return ranked(matching.match_curve(v.sql(CURVE).select("target_id", "energy"), v.clip_motion, clip_moods(v), 3, strategy=strategy))


PAIRS = """SELECT u.clip_id, u.track_id * 100 + CAST(u.start_t AS BIGINT) % 100 AS pair_id, CAST(u.start_t AS BIGINT) % 10 / 10e0 AS energy,
  CASE CAST(u.start_t AS BIGINT) % 4 WHEN 0 THEN 'CALM' WHEN 1 THEN 'ENERGETIC' WHEN 2 THEN 'DARK' ELSE 'CHEERFUL' END AS mood,
  CASE CAST(u.start_t AS BIGINT) % 5 WHEN 0 THEN 'STATIC' WHEN 1 THEN 'SLOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'FAST' ELSE 'EXTREME' END AS motion, 'PAN_LEFT' AS camera FROM v_usage u"""


@query("m01_mood_score_of_pairs", f"""
WITH {COMPAT}, {MOODS}, p AS ({PAIRS}), md AS (SELECT DISTINCT m1, m2 FROM cm), tg AS (SELECT DISTINCT mood FROM p),
lv AS (SELECT tg.mood, md.m1, md.m2, coalesce((SELECT 1 FROM compat c WHERE c.target = tg.mood AND c.mood = md.m1), 0) AS n1, coalesce((SELECT 1 FROM compat c WHERE c.target = tg.mood AND c.mood = md.m2), 0) AS n2 FROM tg, md),
s AS (SELECT p.clip_id, p.pair_id, p.mood, cm.m1, cm.m2, lv.n1, lv.n2, cm.energy AS ce, abs(cm.energy - p.energy) AS gap, p.mood IN (cm.m1, cm.m2) AS exact FROM p JOIN cm ON cm.clip_id = p.clip_id
  JOIN lv ON lv.mood = p.mood AND lv.m1 = cm.m1 AND lv.m2 = cm.m2),
b AS (SELECT *, CASE WHEN exact THEN 0.5e0 WHEN n1 + n2 > 0 THEN 0.3e0 ELSE 0e0 END + CASE WHEN n1 + n2 > 1 THEN 0.2e0 ELSE 0e0 END AS base FROM s)
SELECT clip_id, pair_id, round(least(1e0, base + greatest(0e0, 0.3e0 - gap * 0.5e0)), 6) AS similar, round(least(1e0, base + CASE WHEN round(gap, 9) < 0.1e0 THEN 0.3e0 ELSE 0e0 END), 6) AS exact,
  round(least(1e0, base + CASE WHEN round(gap, 9) > 0.5e0 THEN 0.3e0 ELSE 0e0 END), 6) AS contrast,
  concat_ws('; ', CASE WHEN exact THEN concat('Exact mood match: ', mood) WHEN n1 = 1 THEN concat('Compatible mood: ', m1) WHEN n2 = 1 THEN concat('Compatible mood: ', m2) END,
  CASE WHEN greatest(0e0, 0.3e0 - gap * 0.5e0) > 0.1e0 THEN concat('Similar energy: ', printf('%.2f', ce)) END, CASE WHEN n1 + n2 > 1 THEN 'Multiple mood matches' END) AS reasons FROM b""")
def _(v):
    rows = v.sql(PAIRS).withColumn("target_energy", F.col("energy")).drop("energy").join(clip_moods(v), "clip_id")
    # energies are hundredths; rounding keeps 0.1 and 0.5 gaps on their side of the limit
    target, own = F.col("target_energy"), F.col("energy")
    gap = F.round(F.abs(own - target), 9)
    args = (F.col("mood"), target, F.col("moods"), own)
    stepped = (F.col("mood"), F.lit(0.0), F.col("moods"), gap)
    return rows.select("clip_id", "pair_id", F.round(matching.mood_score(*args), 6).alias("similar"), F.round(matching.mood_score(*stepped, "exact"), 6).alias("exact"),
                       F.round(matching.mood_score(*stepped, "contrast"), 6).alias("contrast"), F.array_join(matching.mood_reasons(*args), "; ").alias("reasons"))


@query("m02_motion_score_of_pairs", f"""
WITH p AS ({PAIRS}), o AS (SELECT * FROM (VALUES ('STATIC', 1), ('SLOW', 2), ('MEDIUM', 3), ('FAST', 4), ('EXTREME', 5)) x(k, i)),
s AS (SELECT p.clip_id, p.pair_id, abs(a.i - b.i) AS d, greatest(0e0, 0.3e0 - abs(m.motion_score - p.energy) * 0.5e0) AS bonus, CASE WHEN m.camera_motion = p.camera THEN 0.2e0 ELSE 0e0 END AS cam
  FROM p JOIN v_clip_motion m ON m.clip_id = p.clip_id JOIN o a ON a.k = p.motion JOIN o b ON b.k = m.motion_type)
SELECT clip_id, pair_id, round(least(1e0, CASE d WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.2e0 ELSE 0e0 END + cam + bonus), 6) AS similar,
  round(least(1e0, CASE d WHEN 0 THEN 0.5e0 ELSE 0e0 END + cam + bonus), 6) AS exact, round(CASE WHEN d >= 2 THEN 0.4e0 ELSE 0e0 END + cam, 6) AS contrast FROM s""")
def _(v):
    rows = v.sql(PAIRS).join(v.clip_motion, "clip_id")

    def score(strategy):
        return F.round(matching.motion_score(F.col("motion"), F.col("energy"), F.col("camera"), F.col("motion_type"), F.col("motion_score"), F.col("camera_motion"), strategy), 6)

    return rows.select("clip_id", "pair_id", *[score(s).alias(s) for s in ("similar", "exact", "contrast")])


COMBINED = f"""{MOOD_SCORE}, {MOTION_SCORE},
f AS (SELECT coalesce(a.target_id, b.target_id) AS target_id, coalesce(a.clip_id, b.clip_id) AS clip_id, coalesce(a.score * %(a)s, 0e0) + coalesce(b.score * %(b)s, 0e0) AS score
  FROM (SELECT t.target_id, nr.clip_id, nr.score FROM t JOIN nr ON nr.motion = t.motion AND nr.level = t.level WHERE nr.rank <= %(k)s) a
  FULL JOIN (SELECT t.target_id, mr.clip_id, mr.score FROM t JOIN mr ON mr.mood = t.mood AND mr.energy = t.energy WHERE mr.rank <= %(k)s) b ON a.target_id = b.target_id AND a.clip_id = b.clip_id),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, clip_id) AS rank FROM f)"""


@query("m03_weighted_combination", f"WITH t AS ({TARGETS}), " + COMBINED % {"a": "0.6e0", "b": "0.4e0", "k": 10} + " SELECT target_id, clip_id, round(score, 9) AS score, rank FROM r")
def _(v):
    return ranked(matching.best_combined(targets(v), v.clip_motion, clip_moods(v), 10))


CURVE = """SELECT track_id * 100 + CAST(floor(t / 43200e0) AS BIGINT) AS target_id, energy, energy AS level,
  CASE WHEN energy < 0.2e0 THEN 'STATIC' WHEN energy < 0.4e0 THEN 'SLOW' WHEN energy < 0.6e0 THEN 'MEDIUM' WHEN energy < 0.8e0 THEN 'FAST' ELSE 'EXTREME' END AS motion,
  CASE WHEN energy < 0.3e0 THEN 'CALM' WHEN energy < 0.45e0 THEN 'PEACEFUL' WHEN energy < 0.6e0 THEN 'CHEERFUL' ELSE 'ENERGETIC' END AS mood FROM v_energy"""


@query("m04_curve_to_clips", f"WITH t AS ({CURVE}), " + COMBINED % {"a": "0.6e0", "b": "0.4e0", "k": 3} + " SELECT target_id, clip_id, round(score, 9) AS score, rank FROM r WHERE rank <= 3")
def _(v):
    curve = v.sql(CURVE).select("target_id", "energy")
    return ranked(matching.match_curve(curve, v.clip_motion, clip_moods(v), 3))


for _strategy in ("exact", "contrast"):
    _by_strategy(_strategy)

FITTING = "(SELECT * FROM %s WHERE clip_id IN (SELECT clip_id FROM d))"


@query("t03_best_clip_per_target", f"WITH t AS ({TARGETS}), d AS (SELECT clip_id FROM v_clip WHERE duration >= 0.5e0 AND duration <= 30), "
       + re.sub(r"\b(v_clip_motion|v_clip_mood)\b", lambda m: FITTING % m[0], COMBINED) % {"a": "0.5e0", "b": "0.5e0", "k": 20}
       + " SELECT target_id, clip_id, round(score, 9) AS score, rank FROM r WHERE rank = 1")
def _(v):
    return ranked(matching.best_clip(targets(v), v.clip_motion, clip_moods(v), v.clip, 20, 0.5, 30.0))


@query("m05_energy_mapping", """
SELECT track_id, t, CASE WHEN energy < 0.2e0 THEN 'STATIC' WHEN energy < 0.4e0 THEN 'SLOW' WHEN energy < 0.6e0 THEN 'MEDIUM' WHEN energy < 0.8e0 THEN 'FAST' ELSE 'EXTREME' END AS motion,
  (CASE WHEN energy < 0.2e0 THEN ['CALM', 'DREAMY', 'PEACEFUL'] WHEN energy < 0.4e0 THEN ['PEACEFUL', 'COOL', 'MELANCHOLIC'] WHEN energy < 0.6e0 THEN ['CHEERFUL', 'WARM', 'BRIGHT']
   WHEN energy < 0.8e0 THEN ['ENERGETIC', 'EUPHORIC', 'CHEERFUL'] ELSE ['ENERGETIC', 'EUPHORIC', 'AGGRESSIVE'] END)[CAST(t / 43200e0 AS BIGINT) % 3 + 1] AS mood FROM v_energy""")
def _(v):
    e = F.col("energy")
    return v.energy.select("track_id", "t", moods.motion_for_energy(e).alias("motion"), moods.cycled_mood(e, (F.col("t") / 43_200.0).cast("bigint")).alias("mood"))


EMO_MAP = "em AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}e0, {a}e0)" for k, (v, a) in moods.MOOD_EMOTIONS.items()) + ") e(mood, v, a))"
CLIP_EMO = f"""{EMO_MAP}, ce AS (SELECT o.clip_id, o.energy, coalesce(avg(em.v), 0e0) AS v, coalesce(avg(em.a), (o.energy - 0.5e0) * 2) AS a FROM v_clip_mood o LEFT JOIN em ON contains(o.moods, concat('"', em.mood, '"')) GROUP BY o.clip_id, o.energy)"""
EMO_TARGETS = """SELECT track_id * 10 + seg_idx AS target_id, CAST((track_id * 7 + seg_idx) % 21 AS DOUBLE) / 10 - 1 AS v, CAST((track_id * 3 + seg_idx * 5) % 21 AS DOUBLE) / 10 - 1 AS a, CAST(energy AS DOUBLE) AS energy,
  CAST((track_id + seg_idx) % 10 AS DOUBLE) / 10 AS motion FROM v_segment"""


def clip_points(v):
    joined = clip_moods(v).join(v.clip_motion.select("clip_id", "motion_score"), "clip_id", "left")
    val, aro = matching.clip_emotion(F.col("moods"), F.col("energy"))
    return joined.select("clip_id", F.array(val, aro, F.coalesce("motion_score", F.lit(0.5)), F.col("energy")).alias("embedding"))


@query("m06_emotion_best_clip", f"""
WITH {CLIP_EMO}, t AS ({EMO_TARGETS}), u AS (SELECT DISTINCT v, a, energy, motion FROM t),
s AS (SELECT u.*, ce.clip_id, 0.4e0 * greatest(0e0, 1 - sqrt((u.v - ce.v) * (u.v - ce.v) + (u.a - ce.a) * (u.a - ce.a)) / 2) + 0.3e0 * (1 - (abs(u.motion - coalesce(m.motion_score, 0.5e0)) + abs(u.energy - ce.energy)) / 2) + 0.3e0 AS score
  FROM u JOIN ce ON TRUE LEFT JOIN v_clip_motion m ON m.clip_id = ce.clip_id),
r AS (SELECT *, row_number() OVER (PARTITION BY v, a, energy, motion ORDER BY round(score, 9) DESC, clip_id) AS k FROM s)
SELECT t.target_id, r.clip_id, round(r.score, 6) AS score FROM t JOIN r ON r.v = t.v AND r.a = t.a AND r.energy = t.energy AND r.motion = t.motion WHERE r.k = 1""")
def _(v):
    t = v.sql(EMO_TARGETS).select("target_id", F.array("v", "a", "motion", "energy").alias("embedding"))
    return palette.best_by_emotion(t, clip_points(v), 1).select("target_id", "clip_id", F.round("score", 6).alias("score"))


@query("m07_quadrant_moods", """
SELECT track_id, t, CASE WHEN a >= 0 THEN CASE WHEN v >= 0 THEN CASE WHEN a > 0.7e0 THEN 'EUPHORIC' WHEN a > 0.4e0 THEN 'ENERGETIC' ELSE 'CHEERFUL' END WHEN a > 0.7e0 THEN 'AGGRESSIVE' ELSE 'TENSE' END
  WHEN v >= 0 THEN CASE WHEN v > 0.5e0 THEN 'PEACEFUL' ELSE 'CALM' END WHEN a < -0.5e0 THEN 'MELANCHOLIC' ELSE 'MYSTERIOUS' END AS mood
FROM (SELECT track_id, t, energy * 2 - 1 AS v, CAST(track_id % 21 AS DOUBLE) / 10 - 1 AS a FROM v_energy)""")
def _(v):
    mood = moods.quadrant_mood(F.col("energy") * 2 - 1, (F.col("track_id") % 21).cast("double") / 10 - 1)
    return v.energy.select("track_id", "t", mood.alias("mood"))


AUDIO = "SELECT track_id, seg_idx, segment_type, CAST(energy AS DOUBLE) AS energy, CAST((track_id * 3 + seg_idx) % 11 AS DOUBLE) / 10 AS brightness, CAST((track_id + seg_idx * 7) % 11 AS DOUBLE) / 10 AS richness FROM v_segment"
SEG_MOODS = "sm AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{m}', {i})" for s, ms in moods.PALETTE_MOODS.items() for i, m in enumerate(ms)) + ") x(seg, mood, i))"
PAL = "pal AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {p[0][0]}e0, {p[0][1]}e0, {p[0][2]}e0, '{p[1]}', '{p[2]}', {p[3]}e0)" for m, p in moods.PALETTES.items()) + ") x(mood, l, a, b, temperature, brightness, saturation))"
PALETTE_SQL = f"""{EMO_MAP}, {SEG_MOODS}, {PAL}, au AS ({AUDIO}), e AS (SELECT *, greatest(-1e0, least(1e0, (brightness * 0.4e0 + richness * 0.3e0 - 0.35e0) * 2)) AS v, greatest(-1e0, least(1e0, (energy * 0.5e0 + 0.5e0 * 0.5e0 - 0.25e0) * 2)) AS ar FROM au),
n AS (SELECT e.*, sm.mood, row_number() OVER (PARTITION BY e.track_id, e.seg_idx ORDER BY round(sqrt((e.v - em.v) * (e.v - em.v) + (e.ar - em.a) * (e.ar - em.a)), 9), sm.i) AS k FROM e JOIN sm ON sm.seg = e.segment_type JOIN em ON em.mood = sm.mood),
pp AS (SELECT n.track_id, n.seg_idx, n.mood, pal.temperature, pal.brightness, greatest(10e0, least(95e0, pal.l * (0.7e0 + n.brightness * 0.6e0))) AS l, pal.a, pal.b, greatest(0.1e0, least(1e0, pal.saturation * (0.5e0 + n.richness))) AS saturation
  FROM n JOIN pal ON pal.mood = n.mood WHERE n.k = 1)"""


def palettes(v):
    audio = v.sql(AUDIO)
    val, aro = moods.audio_emotion(F.col("energy"), F.col("brightness"), F.col("richness"), F.lit(0.5))
    return palette.audio_palette(audio.withColumn("valence", val).withColumn("arousal", aro))


@query("m08_audio_palettes", f"""
WITH {PALETTE_SQL} SELECT track_id, seg_idx, mood, temperature, brightness AS brightness_class, round(l, 4) AS l, round(saturation, 6) AS saturation, round(-a * 0.8e0, 4) AS comp_a,
  round(sqrt(a * a + b * b) * cos(atan2(b, a) + radians(30)), 4) AS ana1_a, round(sqrt(a * a + b * b) * sin(atan2(b, a) - radians(30)), 4) AS ana2_b FROM pp""")
def _(v):
    out = palettes(v)
    return out.select("track_id", "seg_idx", "mood", "temperature", "brightness_class", F.round("primary_lab.l", 4).alias("l"), F.round("saturation_level", 6).alias("saturation"),
                      F.round("complementary.a", 4).alias("comp_a"), F.round("analogous_1.a", 4).alias("ana1_a"), F.round("analogous_2.b", 4).alias("ana2_b"))


COLOR_PAIRS = """SELECT u.clip_id, u.track_id, u.clip_id * 13 % 256 AS r1, u.clip_id * 29 % 256 AS g1, u.clip_id * 43 % 256 AS b1, u.clip_id * 3 % 256 AS r2, u.clip_id * 5 % 256 AS g2, u.clip_id * 7 % 256 AS b2,
  u.track_id % 256 AS pr, u.track_id * 3 % 256 AS pg, u.track_id * 7 % 256 AS pb, CASE u.track_id % 3 WHEN 0 THEN 'WARM' WHEN 1 THEN 'COOL' ELSE 'NEUTRAL' END AS temperature,
  CASE u.track_id % 4 WHEN 0 THEN 'DARK' WHEN 1 THEN 'BRIGHT' ELSE 'MEDIUM' END AS brightness FROM (SELECT DISTINCT clip_id, track_id FROM v_usage) u"""


def _xyz(row, white):
    return "(" + " + ".join(f"{c} * {w}e0" for c, w in zip("rgb", row, strict=True)) + f") / {white}e0"


LAB_STEPS = f"""p AS (SELECT *, row_number() OVER () AS id FROM ({COLOR_PAIRS})),
ch AS (SELECT id, 0 AS k, pr AS r, pg AS g, pb AS b FROM p UNION ALL SELECT id, 1, r1, g1, b1 FROM p UNION ALL SELECT id, 2, r2, g2, b2 FROM p),
li AS (SELECT id, k, {", ".join(f"CASE WHEN {c} / 255e0 > {palette.GAMMA_LIMIT} THEN pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {c} / 255e0 / 12.92e0 END AS {c}" for c in "rgb")} FROM ch),
xy AS (SELECT id, k, {", ".join(f"{_xyz(row, w)} AS {n}" for n, row, w in zip("xyz", palette.XYZ_OF_RGB, palette.WHITE, strict=True))} FROM li),
cu AS (SELECT id, k, {", ".join(f"CASE WHEN {n} > {palette.LAB_LIMIT} THEN cbrt({n}) ELSE {n} * 7.787e0 + 16e0 / 116 END AS {n}" for n in "xyz")} FROM xy),
la AS (SELECT id, k, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM cu),
s1 AS (SELECT m.id, m.l AS l1, m.a AS a1, m.b AS b1, n.l AS l2, n.a AS a2, n.b AS b2, (sqrt(m.a * m.a + m.b * m.b) + sqrt(n.a * n.a + n.b * n.b)) / 2 AS cm FROM la m JOIN la n ON n.id = m.id AND m.k = 0 AND n.k > 0),
s2 AS (SELECT *, 1 + 0.5e0 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25e0, 7)))) AS g FROM s1),
s3 AS (SELECT id, l1, l2, sqrt(a1 * g * a1 * g + b1 * b1) AS c1, sqrt(a2 * g * a2 * g + b2 * b2) AS c2, atan2(b1, a1 * g) + CASE WHEN atan2(b1, a1 * g) < 0 THEN 2 * pi() ELSE 0 END AS h1, atan2(b2, a2 * g) + CASE WHEN atan2(b2, a2 * g) < 0 THEN 2 * pi() ELSE 0 END AS h2 FROM s2),
s4 AS (SELECT id, (l1 + l2) / 2 - 50 AS lm, (c1 + c2) / 2 AS cm, l2 - l1 AS dl, c2 - c1 AS dc,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= pi() THEN (h1 + h2) / 2 WHEN h1 + h2 < 2 * pi() THEN (h1 + h2) / 2 + pi() ELSE (h1 + h2) / 2 - pi() END AS h,
  2 * sqrt(c1 * c2) * sin(CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > pi() THEN h2 - h1 - 2 * pi() WHEN h2 - h1 < -pi() THEN h2 - h1 + 2 * pi() ELSE h2 - h1 END / 2) AS dh FROM s3),
s5 AS (SELECT id, dl / (1 + 0.015e0 * lm * lm / sqrt(20 + lm * lm)) AS l, dc / (1 + 0.045e0 * cm) AS c,
  dh / (1 + 0.015e0 * cm * (1 - 0.17e0 * cos(h - radians(30)) + 0.24e0 * cos(2 * h) + 0.32e0 * cos(3 * h + radians(6)) - 0.2e0 * cos(4 * h - radians(63)))) AS h,
  -sin(2 * radians(30) * exp(-pow((degrees(h) - 275) / 25, 2))) * 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25e0, 7))) AS r FROM s4),
near AS (SELECT id, greatest(0e0, 1 - min(sqrt(greatest(0e0, l * l + c * c + h * h + r * c * h))) / 50) AS near FROM s5 GROUP BY id)"""


@query("m09_color_match", f"""
WITH {LAB_STEPS}, d AS (SELECT p.*, near.near, least(sqrt((pr-r1)*(pr-r1) + (pg-g1)*(pg-g1) + (pb-b1)*(pb-b1)), sqrt((pr-r2)*(pr-r2) + (pg-g2)*(pg-g2) + (pb-b2)*(pb-b2))) AS dist, (r1 - b1) + (r2 - b2) AS warm,
  ((r1 + g1 + b1) / 3e0 + (r2 + g2 + b2) / 3e0) / 2 AS lum FROM p JOIN near USING (id)),
c AS (SELECT *, CASE WHEN warm > 50 THEN 'WARM' WHEN warm < -50 THEN 'COOL' ELSE 'NEUTRAL' END AS ct, CASE WHEN lum < 85 THEN 'DARK' WHEN lum < 170 THEN 'MEDIUM' ELSE 'BRIGHT' END AS cb FROM d)
SELECT clip_id, track_id, round(greatest(0e0, 1 - dist / 441), 6) AS rgb_similarity, round(near, 6) AS lab_similarity, ct AS clip_temperature, cb AS clip_brightness,
  round(least(1e0, near * 0.5e0 + CASE WHEN ct = temperature THEN 0.25e0 WHEN ct = 'NEUTRAL' OR temperature = 'NEUTRAL' THEN 0.125e0 ELSE 0e0 END
   + CASE WHEN cb = brightness THEN 0.25e0 WHEN cb = 'MEDIUM' OR brightness = 'MEDIUM' THEN 0.125e0 ELSE 0e0 END), 6) AS score FROM c""")
def _(v):
    def rgb(i):
        return F.array(*[F.col(f"{c}{i}").cast("double") for c in "rgb"])

    pairs = v.sql(COLOR_PAIRS).withColumns({"colors": F.array(rgb(1), rgb(2)), "primary": F.array(*[F.col(f"p{c}").cast("double") for c in "rgb"])})
    rows = palette.with_similarities(pairs.select("clip_id", "track_id", "temperature", "brightness", "primary", "colors"), "primary", "colors")
    colors = F.col("colors")
    return rows.select(
        "clip_id", "track_id", F.round("rgb_similarity", 6).alias("rgb_similarity"), F.round("lab_similarity", 6).alias("lab_similarity"),
        palette.color_temperature(colors).alias("clip_temperature"), palette.color_brightness(colors).alias("clip_brightness"),
        F.round(palette.color_match(F.col("primary"), F.col("temperature"), F.col("brightness"), colors, F.col("lab_similarity")), 6).alias("score"))


@query("m10_nearest_energy_motion", f"""
WITH t AS ({TARGETS}), c AS (SELECT o.clip_id, o.energy, m.motion_score FROM v_clip_mood o JOIN v_clip_motion m ON m.clip_id = o.clip_id), u AS (SELECT DISTINCT energy, level FROM t),
s AS (SELECT u.*, c.clip_id, sqrt((u.energy - c.energy) * (u.energy - c.energy) + (u.level - c.motion_score) * (u.level - c.motion_score)) AS d FROM u, c),
r AS (SELECT *, row_number() OVER (PARTITION BY energy, level ORDER BY round(d, 9), clip_id) AS k FROM s)
SELECT t.target_id, r.clip_id, round(r.d, 6) AS distance FROM t JOIN r ON r.energy = t.energy AND r.level = t.level WHERE r.k = 1""")
def _(v):
    clips = v.clip_mood.select("clip_id", "energy").join(v.clip_motion.select("clip_id", "motion_score"), "clip_id")
    items = clips.select("clip_id", F.array("energy", "motion_score").alias("embedding"))
    asked = targets(v).select("target_id", F.array("energy", "level").alias("embedding"))
    out = knn.search(asked, items, 1, "target_id", "clip_id", few_dimensions=True, metric=knn.ROUNDED_L2)
    return out.select("target_id", "clip_id", F.round("distance", 6).alias("distance"))


DUR = "SELECT s.track_id, s.seg_idx, s.segment_type, CAST(s.energy AS DOUBLE) AS energy, CAST((s.track_id * 3 + s.seg_idx) % 11 AS DOUBLE) / 10 AS strength, CAST((s.track_id + s.seg_idx) % 11 AS DOUBLE) / 10 AS quality, CAST((s.track_id * s.seg_idx) % 25 AS DOUBLE) AS clip_duration, CAST((s.track_id * 5 + s.seg_idx) % 13 AS DOUBLE) AS next_gap, k.bpm FROM v_segment s JOIN v_track k ON k.track_id = s.track_id"


@query("m13_dynamic_duration", f"""
WITH d AS ({DUR}), p AS (SELECT *, 60e0 / greatest(30e0, least(300e0, bpm)) * CASE WHEN segment_type IN ('intro', 'outro') THEN CASE WHEN energy < 0.4e0 THEN 16 ELSE 8 END WHEN segment_type IN ('drop', 'chorus') THEN 4
  WHEN segment_type = 'verse' THEN 8 ELSE CASE WHEN energy < 0.5e0 THEN 8 ELSE 4 END END * CASE WHEN energy > 0.8e0 THEN 0.5e0 WHEN energy > 0.6e0 THEN 0.75e0 WHEN energy < 0.3e0 THEN 1.5e0 WHEN energy < 0.5e0 THEN 1.25e0 ELSE 1e0 END AS m FROM d),
s AS (SELECT *, CASE WHEN strength >= 0.7e0 AND next_gap < m * 1.2e0 THEN next_gap ELSE m END AS x FROM p)
SELECT track_id, seg_idx, round(CASE WHEN quality >= 0.85e0 AND least(clip_duration, 20) >= 2 THEN least(clip_duration, 20) ELSE greatest(2e0, least(x, 16e0)) END, 6) AS duration FROM s""")
def _(v):
    out = durations.dynamic_duration(F.col("energy"), F.col("strength"), F.col("segment_type"), F.col("quality"), F.col("clip_duration"), F.col("next_gap"), F.col("bpm"),
                                     durations.Limits(2.0, 16.0, 4, True, 20.0))
    return v.sql(DUR).select("track_id", "seg_idx", F.round(out, 6).alias("duration"))


@query("m14_adaptive_duration", """
SELECT t.track_id, t.seq, round(greatest(2e0, round_even(CASE WHEN trigger_type = 'kick' THEN 6e0 ELSE 8e0 END * (1 - base_strength * 0.5e0) / (60e0 / k.bpm), 0) * (60e0 / k.bpm)), 6) AS duration
FROM v_trigger t JOIN v_track k ON k.track_id = t.track_id""")
def _(v):
    rows = v.trigger.join(v.track.select("track_id", "bpm"), "track_id")
    d = durations.adaptive_duration(F.col("trigger_type"), F.col("base_strength"), F.col("bpm"))
    return rows.select("track_id", "seq", F.round(d, 6).alias("duration"))


def uniform_sql(key: str, salt: str) -> str:
    return f"(CAST('0x' || substring(md5({key} || '|{salt}'), 1, 8) AS BIGINT) / 4294967296e0)"


def parts_sql(strength: str) -> str:
    """CTEs of the part of a clip that is shown, per use."""
    key, where = "CAST(clip_id AS VARCHAR)", "CAST(clip_id AS VARCHAR) || '|' || CAST(wanted AS VARCHAR)"
    return f"""a AS (SELECT u.clip_id, u.track_id, u.start_t, (u.end_t - u.start_t) / 4 AS wanted, {strength} AS strength, greatest(0.5e0, c.duration - 0.3e0) AS usable FROM v_usage u JOIN v_clip c ON c.clip_id = u.clip_id),
b AS (SELECT *, least(greatest(1.5e0, least(15e0, usable, wanted * (0.5e0 + strength * 0.5e0) * (0.8e0 + 0.4e0 * {uniform_sql(key, 'length')}))), usable) AS part, {uniform_sql(where, 'third')} AS roll, {uniform_sql(where, 'place')} AS place FROM a),
p AS (SELECT *, CASE WHEN usable > wanted AND usable - part > 0.5e0 THEN round((usable - part) * (CASE WHEN roll < 0.6e0 THEN 0e0 WHEN roll < 0.9e0 THEN 0.33e0 ELSE 0.66e0 END
  + (CASE WHEN roll < 0.6e0 THEN 0.33e0 WHEN roll < 0.9e0 THEN 0.66e0 ELSE 1e0 END - CASE WHEN roll < 0.6e0 THEN 0e0 WHEN roll < 0.9e0 THEN 0.33e0 ELSE 0.66e0 END) * place), 2) ELSE 0e0 END AS clip_start,
  CASE WHEN usable > wanted THEN round(part, 2) ELSE usable END AS clip_duration FROM b)"""


@query("m15_clip_sub_segments", f"WITH {parts_sql('(u.track_id % 11) / 10e0')} SELECT clip_id, track_id, start_t, clip_start, clip_duration FROM p")
def _(v):
    start, duration = durations.sub_segment(F.col("available"), F.col("wanted"), F.col("strength"), F.col("clip_id").cast("string"))
    rows = v.usage.join(v.clip.select("clip_id", F.col("duration").alias("available")), "clip_id")
    rows = rows.withColumn("wanted", (F.col("end_t") - F.col("start_t")) / 4).withColumn("strength", (F.col("track_id") % 11) / 10.0)
    return rows.select("clip_id", "track_id", "start_t", start.alias("clip_start"), duration.alias("clip_duration"))


@query("m15_sub_segment_bounds", f"""
WITH {parts_sql('0.5e0')} SELECT clip_id, count(*) AS n, bool_and(clip_start >= 0 AND clip_start + clip_duration <= usable + 0.011e0) AS inside, bool_and(clip_duration >= 0.5e0) AS long_enough FROM p GROUP BY clip_id""")
def _(v):
    rows = v.usage.join(v.clip.select("clip_id", F.col("duration").alias("available")), "clip_id")
    start, duration = durations.sub_segment(F.col("available"), (F.col("end_t") - F.col("start_t")) / 4, F.lit(0.5), F.col("clip_id").cast("string"))
    usable = F.greatest(F.lit(0.5), F.col("available") - 0.3)
    ok = (start >= 0) & (start + duration <= usable + 0.011)
    return rows.withColumn("ok", ok).withColumn("long", duration >= 0.5).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("inside"), F.bool_and("long").alias("long_enough"))


@query("m17_diverse_selection", f"""
WITH RECURSIVE cl AS (SELECT m.clip_id, o.energy, m.motion_score, row_number() OVER (ORDER BY m.clip_id) - 1 AS r FROM v_clip_motion m JOIN v_clip_mood o ON o.clip_id = m.clip_id),
tg AS ({TARGETS}), d AS (SELECT track_id, seg_idx, r, clip_id, sqrt((tg.energy - cl.energy) * (tg.energy - cl.energy) + (level - motion_score) * (level - motion_score)) AS d FROM tg, cl),
q AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY d, clip_id) AS rank FROM d), a AS (SELECT track_id, seg_idx, list(r ORDER BY rank) AS cands FROM q WHERE rank <= 5 GROUP BY track_id, seg_idx),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) AS k, (SELECT count(*) FROM cl) AS n FROM a),
w AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seg_idx, CAST([] AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS picked, CAST(NULL AS DOUBLE) AS score FROM l UNION ALL
  SELECT track_id, k, seg_idx, list_append(used, p), turn + CASE WHEN len(free) = 0 THEN 1 ELSE 0 END, p, CASE WHEN len(free) = 0 THEN 0e0 ELSE 1e0 END
  FROM (SELECT *, CASE WHEN len(free) > 0 THEN free[1] ELSE list_filter(range(0, n), lambda x: NOT list_contains(used, x))[turn % (n - len(used)) + 1] END AS p
    FROM (SELECT *, list_filter(cands, lambda x: NOT list_contains(used, x)) AS free FROM (SELECT w.track_id, l.k, CAST(l.seg_idx AS BIGINT) AS seg_idx, l.cands, l.n, w.turn,
      CASE WHEN len(w.used) >= greatest(1, CAST(floor(l.n * 0.8e0) AS BIGINT)) THEN CAST([] AS BIGINT[]) ELSE w.used END AS used FROM w JOIN l ON l.track_id = w.track_id AND l.k = w.k + 1))))
SELECT w.track_id, w.seg_idx, cl.clip_id, w.score FROM w JOIN cl ON cl.r = w.picked""")
def _(v):
    # cuts of a track are its segments; a clip may not return until 80 % of the catalog was used
    clips = selection.rank_clips(v.clip_mood.select("clip_id", "energy").join(v.clip_motion.select("clip_id", "motion_score"), "clip_id"), width=100_000.0)
    items = clips.select("clip_id", F.array("energy", "motion_score").alias("embedding"))
    asked = targets(v).select("target_id", F.array("energy", "level").alias("embedding"))
    found = knn.search(asked, items, 5, "target_id", "clip_id", few_dimensions=True).join(clips.select("clip_id", "clip_rank"), "clip_id")
    lists = found.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("rank", "clip_rank"))).alias("l"))
    cuts = targets(v).select("target_id", "track_id", "seg_idx").join(lists, "target_id").withColumn("candidates", F.transform("l", lambda e: e["clip_rank"]))
    total = clips.agg(F.count(F.lit(1)).alias("n_clips")).first()["n_clips"]
    out = selection.select_diverse(cuts.withColumn("n_clips", F.lit(total)).drop("l"), ["track_id"], ["seg_idx"])
    named = out.join(clips.select(F.col("clip_rank").alias("picked"), "clip_id"), "picked")
    return named.select("track_id", "seg_idx", "clip_id", "score")


#: squared distance of a target's query vector and a clip's: levels, motion class (two slots), moods (one slot each) and camera
CASCADE = f"""t AS ({TARGETS}), {COMBINED % {"a": "0.6e0", "b": "0.4e0", "k": 20}}, n AS (SELECT count(*) AS n FROM v_clip), c AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS rk FROM v_clip),
x AS (SELECT coalesce(m.clip_id, o.clip_id) AS clip_id, coalesce(m.motion_score, 0.5e0) AS ms, coalesce(o.energy, 0.5e0) AS en, coalesce(m.motion_type, 'MEDIUM') AS mt, coalesce(m.camera_magnitude, 0e0) AS cam,
  coalesce(o.moods, '[]') AS moods, CASE WHEN o.moods IS NULL THEN 0 ELSE 2 END AS nm FROM v_clip_motion m FULL JOIN v_clip_mood o ON o.clip_id = m.clip_id),
d AS (SELECT t.track_id, t.seg_idx, x.clip_id, sqrt((ms - level) * (ms - level) + (en - t.energy) * (en - t.energy) + CASE WHEN mt = motion THEN 0 ELSE 2 END
  + nm + 1 - CASE WHEN contains(moods, '"' || mood || '"') THEN 2 ELSE 0 END + cam * cam) AS distance FROM t, x),
a AS (SELECT track_id, seg_idx, clip_id, distance, 0 AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY round(distance, 9), clip_id) AS k FROM d WHERE round(distance, 9) <= 1.02e0) WHERE k = 1),
b AS (SELECT t.track_id, t.seg_idx, r.clip_id, 1 - r.score AS distance, 1 AS strategy FROM t JOIN r ON r.target_id = t.target_id WHERE r.rank = 1 AND round(r.score, 9) >= 0.6e0),
e AS (SELECT t.track_id, t.seg_idx, c.clip_id, 1e0 AS distance, 2 AS strategy FROM t, n JOIN c ON c.rk = t.seg_idx % n.n),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY strategy, clip_id) AS i FROM u)"""


def cascaded(v):
    """Nearest clip of a target's vector, if it is near; else the best by motion and mood, if it is good; else the clip whose turn it is."""
    t = targets(v)
    keyed = t.select("target_id", "track_id", "seg_idx")
    clips = v.clip_motion.join(v.clip_mood.select("clip_id", "energy", "moods"), "clip_id", "full")
    items = vectorops.clip_vectors(clips.withColumn("moods", F.from_json("moods", "array<string>")))
    vector = matching.nearest_by_vector(t, items, max_distance=1.02).join(keyed, "target_id")
    both = matching.best_combined(t, v.clip_motion, clip_moods(v), 20, 1)
    smart = both.filter(F.round("score", 9) >= 0.6).join(keyed, "target_id").withColumn("distance", 1 - F.col("score"))
    ranks = selection.rank_clips(v.clip.select("clip_id"), width=100_000.0)
    turn = keyed.withColumn("clip_rank", F.pmod("seg_idx", F.lit(v.clip.count()))).join(ranks, "clip_rank").withColumn("distance", F.lit(1.0))
    return selection.cascade(vector, smart, turn, keys=("track_id", "seg_idx"))


@query("m18_strategy_cascade", f"WITH {CASCADE} SELECT track_id, seg_idx, clip_id, strategy FROM k WHERE i = 1")
def _(v):
    return cascaded(v).select("track_id", "seg_idx", "clip_id", "strategy")


@query("m18_vector_cascade", f"WITH {CASCADE} SELECT track_id, seg_idx, clip_id, strategy, round(distance, 6) AS distance FROM k WHERE i = 1")
def _(v):
    return cascaded(v).select("track_id", "seg_idx", "clip_id", "strategy", F.round("distance", 6).alias("distance"))
