"""Queries that turn feature columns into labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import labels
from cadenza.plans.registry import query


def _pairs(pairs, source="s0"):
    """SQL steps that apply exclusive pairs one after the other."""
    steps = []
    for i, (a, b) in enumerate(pairs):
        src = source if i == 0 else f"x{i - 1}"
        steps.append(f"x{i} AS (SELECT * REPLACE (CASE WHEN {a} > 0 AND {b} > 0 AND {a} < {b} THEN 0e0 ELSE {a} END AS {a}, "
                     f"CASE WHEN {a} > 0 AND {b} > 0 AND {a} >= {b} THEN 0e0 ELSE {b} END AS {b}) FROM {src})")
    return ", ".join(steps), f"x{len(pairs) - 1}"


def _ranking(names, last, first_above, second_above, fallback, extra=""):
    rows = ", ".join(f"({i}, '{n.upper()}', {n})" for i, n in enumerate(names))
    return f"""p AS (SELECT clip_id{extra}, u.i, u.name, u.s FROM {last}, LATERAL (VALUES {rows}) u(i, name, s)),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY s DESC, i) AS k FROM p WHERE s > {first_above}),
g AS (SELECT {last}.clip_id, coalesce(a.name, {fallback}) AS one, CASE WHEN b.s > {second_above} THEN b.name END AS two FROM {last}
  LEFT JOIN r a ON a.clip_id = {last}.clip_id AND a.k = 1 LEFT JOIN r b ON b.clip_id = {last}.clip_id AND b.k = 2)
SELECT clip_id, concat_ws(',', one, two) AS picked FROM g"""


MOOD_NAMES = "dark bright energetic calm melancholic euphoric aggressive peaceful mysterious cheerful tense dreamy cool warm".split()
MOOD_STEPS, MOOD_LAST = _pairs([("dark", "bright"), ("energetic", "calm"), ("cool", "warm")])


@query("c03_mood_labels", f"""
WITH s0 AS (SELECT clip_id, energy, CASE WHEN brightness < 80 THEN (80 - brightness) / 80 ELSE 0 END AS dark, CASE WHEN brightness > 180 THEN (brightness - 180) / 75 ELSE 0 END AS bright,
  CASE WHEN energy > 0.6e0 THEN (energy - 0.6e0) / 0.4e0 ELSE 0 END AS energetic, CASE WHEN energy < 0.4e0 AND brightness > 60 AND brightness < 180 THEN (0.4e0 - energy) / 0.4e0 ELSE 0 END AS calm,
  least(1e0, greatest(0e0, (1 - brightness / 255) * 0.4e0 + (1 - saturation) * 0.4e0 + contrast * 0.2e0)) AS melancholic,
  CASE WHEN brightness > 150 AND saturation > 0.5e0 THEN saturation * (brightness / 255) ELSE 0 END AS euphoric,
  CASE WHEN contrast > 0.5e0 AND saturation > 0.4e0 AND warm_ratio > 0.3e0 THEN contrast * saturation ELSE 0 END AS aggressive,
  least(1e0, greatest(0e0, brightness / 255 * 0.3e0 + (1 - contrast) * 0.4e0 + (1 - energy) * 0.3e0)) AS peaceful,
  CASE WHEN brightness < 100 AND saturation > 0.4e0 THEN saturation * ((100 - brightness) / 100) ELSE 0 END AS mysterious,
  CASE WHEN brightness > 140 AND saturation > 0.4e0 AND warm_ratio > 0.3e0 THEN saturation * (brightness / 255) * (warm_ratio * 1.5e0) ELSE 0 END AS cheerful,
  CASE WHEN contrast > 0.5e0 AND brightness < 120 THEN contrast * ((120 - brightness) / 120) ELSE 0 END AS tense,
  CASE WHEN saturation < 0.3e0 AND contrast < 0.4e0 THEN (0.3e0 - saturation) / 0.3e0 * ((0.4e0 - contrast) / 0.4e0) ELSE 0 END AS dreamy,
  CASE WHEN cool_ratio > warm_ratio AND cool_ratio > 0.2e0 THEN cool_ratio ELSE 0 END AS cool, CASE WHEN warm_ratio > cool_ratio AND warm_ratio > 0.2e0 THEN warm_ratio ELSE 0 END AS warm FROM v_clip_mood),
{MOOD_STEPS}, {_ranking(MOOD_NAMES, MOOD_LAST, '0.3e0', '0.3e0', f"CASE WHEN {MOOD_LAST}.energy > 0.5e0 THEN 'ENERGETIC' ELSE 'CALM' END")}""")
def _(v):
    out = labels.mood_labels(v.clip_mood.drop("moods"))
    return out.select("clip_id", F.array_join("moods", ",").alias("picked"))


STYLE_NAMES = "vintage filmic neon minimalist psychedelic cinematic digital dreamy high_contrast low_key high_key standard".split()
STYLE_STEPS, STYLE_LAST = _pairs([("low_key", "high_key"), ("minimalist", "psychedelic"), ("digital", "vintage"), ("digital", "dreamy")])


@query("c05_style_labels", f"""
WITH s0 AS (SELECT clip_id, CASE WHEN unique_colors < 800 AND vignette_score > 0.05e0 THEN ((800 - unique_colors) / 800e0 + least(vignette_score / 0.15e0, 1)) / 2 ELSE 0 END AS vintage,
  CASE WHEN noise_level > 0.3e0 AND saturation_mean < 0.6e0 THEN (least((noise_level - 0.3e0) / 0.3e0, 1) + (0.6e0 - saturation_mean) / 0.6e0) / 2 ELSE 0 END AS filmic,
  CASE WHEN saturation_mean > 0.5e0 AND sharpness > 800 THEN ((saturation_mean - 0.5e0) / 0.5e0 + least((sharpness - 800) / 1200, 1)) / 2 ELSE 0 END AS neon,
  CASE WHEN unique_colors < 500 AND dynamic_range > 0.6e0 THEN ((500 - unique_colors) / 500e0 + (dynamic_range - 0.6e0) / 0.4e0) / 2 ELSE 0 END AS minimalist,
  CASE WHEN unique_colors > 2000 AND saturation_mean > 0.4e0 THEN (least((unique_colors - 2000) / 1000e0, 1) + (saturation_mean - 0.4e0) / 0.6e0) / 2 ELSE 0 END AS psychedelic,
  CASE WHEN vignette_score > 0.03e0 AND saturation_mean > 0.3e0 AND saturation_mean < 0.7e0 THEN (least(vignette_score / 0.1e0, 1) + (1 - abs(saturation_mean - 0.5e0) / 0.2e0)) / 2 ELSE 0 END AS cinematic,
  CASE WHEN sharpness > 1000 AND noise_level < 0.15e0 THEN (least((sharpness - 1000) / 1000, 1) + (0.15e0 - noise_level) / 0.15e0) / 2 ELSE 0 END AS digital,
  CASE WHEN sharpness < 300 AND saturation_mean < 0.4e0 THEN ((300 - sharpness) / 300 + (0.4e0 - saturation_mean) / 0.4e0) / 2 ELSE 0 END AS dreamy,
  CASE WHEN dynamic_range > 0.8e0 THEN (dynamic_range - 0.8e0) / 0.2e0 ELSE 0 END AS high_contrast, CASE WHEN mean_brightness < 80 THEN (80 - mean_brightness) / 80 ELSE 0 END AS low_key,
  CASE WHEN mean_brightness > 180 THEN (mean_brightness - 180) / 75 ELSE 0 END AS high_key, 0.3e0 AS standard FROM v_clip_style),
{STYLE_STEPS}, {_ranking(STYLE_NAMES, STYLE_LAST, '0.3e0', '0.4e0', "'STANDARD'")}""")
def _(v):
    return labels.style_labels(v.clip_style).select("clip_id", F.array_join("styles", ",").alias("picked"))


SCENE_INPUT = """SELECT clip_id, (clip_id * 41 % 101) / 300e0 AS edge_density, (clip_id * 67 % 101) / 100e0 AS texture_variance, (clip_id * 59 % 101) / 100e0 AS center_ratio,
  width / CAST(height AS DOUBLE) AS aspect_ratio, clip_id % 4 > 0 AS has_face, clip_id % 4 AS face_count, (clip_id * 7 % 21) / 100e0 AS face_size_ratio FROM v_clip"""
SCENE_NAMES = "portrait closeup crowd busy minimal abstract geometric landscape wide_shot indoor nature urban".split()
SCENE_STEPS, SCENE_LAST = _pairs([("portrait", "wide_shot"), ("closeup", "wide_shot"), ("closeup", "landscape"), ("busy", "minimal"), ("abstract", "geometric"), ("nature", "urban")])


@query("c06_scene_labels", f"""
WITH c AS ({SCENE_INPUT}), s0 AS (SELECT clip_id,
  CASE WHEN has_face AND face_size_ratio > 0.03e0 THEN CASE WHEN face_size_ratio > 0.12e0 THEN 0.5e0 WHEN face_size_ratio > 0.06e0 THEN 0.8e0 ELSE 0.6e0 END ELSE 0 END AS portrait,
  CASE WHEN has_face AND face_size_ratio > 0.03e0 THEN CASE WHEN face_size_ratio > 0.12e0 THEN least(0.95e0, 0.6e0 + face_size_ratio * 2) WHEN face_size_ratio > 0.06e0 THEN 0.3e0 ELSE 0e0 END ELSE 0 END AS closeup,
  CASE WHEN face_count >= 2 THEN least(0.4e0 + face_count * 0.15e0, 0.95e0) ELSE 0 END AS crowd,
  CASE WHEN edge_density > 0.08e0 AND texture_variance > 0.25e0 THEN least(((edge_density - 0.08e0) / 0.2e0 + (texture_variance - 0.25e0) / 0.5e0) / 2 + 0.4e0, 0.95e0) ELSE 0 END AS busy,
  CASE WHEN edge_density < 0.08e0 AND texture_variance < 0.25e0 THEN greatest(0.4e0, (0.08e0 - edge_density) / 0.08e0 * 0.5e0 + (0.25e0 - texture_variance) / 0.25e0 * 0.5e0) ELSE 0 END AS minimal,
  CASE WHEN edge_density < 0.1e0 AND texture_variance > 0.2e0 THEN least((texture_variance - 0.2e0) / 0.6e0 * 0.6e0 + (0.1e0 - edge_density) / 0.1e0 * 0.4e0 + 0.3e0, 0.85e0) ELSE 0 END AS abstract,
  CASE WHEN edge_density > 0.08e0 AND texture_variance < 0.25e0 THEN least((edge_density - 0.08e0) / 0.2e0 * 0.6e0 + (0.25e0 - texture_variance) / 0.25e0 * 0.4e0 + 0.3e0, 0.85e0) ELSE 0 END AS geometric,
  CASE WHEN aspect_ratio > 1.3e0 AND center_ratio < 0.6e0 THEN least((aspect_ratio - 1.3e0) / 0.5e0 * 0.5e0 + (0.6e0 - center_ratio) / 0.6e0 * 0.5e0 + 0.3e0, 0.85e0) ELSE 0 END AS landscape,
  CASE WHEN NOT has_face OR face_size_ratio < 0.03e0 THEN CASE WHEN edge_density > 0.03e0 THEN greatest(0.4e0, least(edge_density * 2, 0.7e0)) ELSE 0.4e0 END ELSE 0 END AS wide_shot,
  CASE WHEN center_ratio > 0.6e0 AND edge_density < 0.1e0 THEN greatest(0.5e0, (center_ratio - 0.6e0) / 0.4e0 * 0.5e0 + (0.1e0 - edge_density) / 0.1e0 * 0.5e0 + 0.3e0) ELSE 0 END AS indoor,
  CASE WHEN texture_variance > 0.2e0 AND center_ratio < 0.5e0 AND NOT has_face THEN least(texture_variance * (1 - center_ratio) * 1.2e0, 0.7e0) ELSE 0 END AS nature,
  CASE WHEN edge_density > 0.1e0 AND texture_variance < 0.4e0 THEN least(edge_density * (1 - texture_variance) * 1.5e0, 0.7e0) ELSE 0 END AS urban FROM c),
{SCENE_STEPS}, {_ranking(SCENE_NAMES, SCENE_LAST, '0.35e0', '0.45e0', "'WIDE_SHOT'")}""")
def _(v):
    return labels.scene_labels(v.sql(SCENE_INPUT)).select("clip_id", F.array_join("scene_types", ",").alias("picked"))


PALETTE = """SELECT clip_id, CAST(clip_id * 37 % 256 AS DOUBLE) AS brightness, ((clip_id * 31 % 61) - (clip_id * 23 % 61)) / 100e0 AS temp, clip_id * 13 % 256 AS r1, clip_id * 29 % 256 AS g1,
  clip_id * 43 % 256 AS b1, 20e0 + clip_id % 50 AS p1, clip_id * 3 % 256 AS r2, clip_id * 5 % 256 AS g2, clip_id * 7 % 256 AS b2, 45e0 - clip_id % 30 AS p2 FROM v_clip"""


@query("c01_color_classes", f"""
WITH c AS ({PALETTE}), s AS (SELECT *, CASE WHEN greatest(r1, g1, b1) > 0 THEN (greatest(r1, g1, b1) - least(r1, g1, b1)) / CAST(greatest(r1, g1, b1) AS DOUBLE) * p1 / 100 ELSE 0 END
  + CASE WHEN greatest(r2, g2, b2) > 0 THEN (greatest(r2, g2, b2) - least(r2, g2, b2)) / CAST(greatest(r2, g2, b2) AS DOUBLE) * p2 / 100 ELSE 0 END AS sat FROM c)
SELECT clip_id, CASE WHEN brightness < 80 THEN 'DARK' WHEN brightness > 180 THEN 'BRIGHT' ELSE 'MEDIUM' END AS brightness_class,
  CASE WHEN temp > 0.15e0 THEN 'WARM' WHEN temp < -0.15e0 THEN 'COOL' ELSE 'NEUTRAL' END AS temperature_class,
  concat_ws(',', CASE WHEN brightness < 80 THEN 'DARK' WHEN brightness > 180 THEN 'BRIGHT' END, CASE WHEN temp > 0.2e0 THEN 'WARM' WHEN temp < -0.2e0 THEN 'COOL' END,
  CASE WHEN sat > 0.6e0 THEN 'VIBRANT' WHEN sat < 0.2e0 THEN 'MUTED' END, CASE WHEN p1 > 30 AND p2 > 30 THEN 'CONTRASTING' END) AS moods FROM s""")
def _(v):
    def color(i):
        return F.struct(F.array(*[F.col(f"{x}{i}").cast("int") for x in "rgb"]).alias("rgb"), F.col(f"p{i}").cast("double").alias("pct"))

    colors = F.array(color(1), color(2))
    return v.sql(PALETTE).select("clip_id", labels.brightness_class(F.col("brightness")).alias("brightness_class"),
                                 labels.temperature_class(F.col("temp")).alias("temperature_class"),
                                 F.array_join(labels.color_moods(colors, F.col("brightness"), F.col("temp")), ",").alias("moods"))


@query("c02_color_harmony", """
WITH h AS (SELECT clip_id, list(CAST(clip_id * k * 17 % 180 AS DOUBLE) ORDER BY k) AS l FROM v_clip, (SELECT unnest(range(1, 5)) AS k) WHERE k <= 1 + clip_id % 4 GROUP BY clip_id),
d AS (SELECT clip_id, len(l) AS n, list_transform(range(1, len(l)), lambda i: least(abs(l[i] * 2 - l[i + 1] * 2), 360 - abs(l[i] * 2 - l[i + 1] * 2))) AS s FROM h),
m AS (SELECT clip_id, n, list_avg(s) AS x FROM d)
SELECT clip_id, CASE WHEN n < 2 THEN 'monochromatic' WHEN x < 30 THEN 'analogous' WHEN x > 150 AND x < 210 THEN 'complementary' WHEN (x > 110 AND x < 130) OR (x > 230 AND x < 250) THEN 'triadic'
  WHEN x > 80 AND x < 100 THEN 'split_complementary' ELSE 'custom' END AS harmony FROM m""")
def _(v):
    hues = F.transform(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("clip_id") % 4), lambda k: (F.col("clip_id") * k * 17 % 180).cast("double"))
    return v.clip.select("clip_id", labels.harmony(hues).alias("harmony"))


@query("c04_mood_profile", """
SELECT clip_id, round(1 - brightness / 255, 6) AS darkness, round(warm_ratio / greatest(warm_ratio + cool_ratio, 0.001e0), 6) AS warmth,
  round(energy + saturation + contrast + brightness / 255 + (warm_ratio - cool_ratio), 6) AS vector_sum FROM v_clip_mood""")
def _(v):
    out = labels.mood_profile(v.clip_mood)
    return out.select("clip_id", F.round("darkness", 6).alias("darkness"), F.round("warmth", 6).alias("warmth"),
                      F.round(F.aggregate("mood_vector", F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"))


@query("c04_style_profile", """
SELECT clip_id, CASE WHEN unique_colors < 500 THEN 'LOW' WHEN unique_colors < 1500 THEN 'MEDIUM' ELSE 'HIGH' END AS color_complexity,
  CASE WHEN noise_level < 0.1e0 THEN 'NONE' WHEN noise_level < 0.3e0 THEN 'LIGHT' ELSE 'HEAVY' END AS grain_level, CASE WHEN sharpness < 300 THEN 'SOFT' WHEN sharpness < 1000 THEN 'NORMAL' ELSE 'SHARP' END AS focus_quality,
  CASE WHEN mean_brightness < 80 THEN 'LOW_KEY' WHEN mean_brightness > 180 THEN 'HIGH_KEY' ELSE 'BALANCED' END AS lighting FROM v_clip_style""")
def _(v):
    return labels.style_profile(v.clip_style).select("clip_id", "color_complexity", "grain_level", "focus_quality", "lighting")


@query("c04_mood_similarity", """
SELECT a.clip_id, round(1 - (abs(a.brightness - b.brightness) / 255 + abs(a.saturation - b.saturation) + abs(a.contrast - b.contrast) + abs(a.energy - b.energy) + abs(a.warm_ratio - b.warm_ratio)) / 5, 6) AS similarity
FROM v_clip_mood a JOIN v_clip_mood b ON b.clip_id = a.clip_id + 1""")
def _(v):
    cols = ["brightness", "saturation", "contrast", "energy", "warm_ratio"]
    a = v.clip_mood.select("clip_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = v.clip_mood.select((F.col("clip_id") - 1).alias("clip_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, "clip_id")
    return pairs.select("clip_id", F.round(labels.mood_similarity(pairs), 6).alias("similarity"))


OBJECTS = """SELECT clip_id, clip_id % 70 AS line_count, (clip_id * 11 % 41) / 100e0 AS green_ratio, (clip_id * 19 % 61) / 100e0 AS sky_ratio,
  CASE clip_id % 5 WHEN 0 THEN 'car,person' WHEN 1 THEN 'dog,frisbee' WHEN 2 THEN 'chair' WHEN 3 THEN 'boat,kite,bird' ELSE '' END AS objects FROM v_clip"""


@query("c07_content_tags", f"""
WITH o AS ({OBJECTS}), t AS (SELECT clip_id, unnest([CASE WHEN objects LIKE '%dog%' OR objects LIKE '%bird%' THEN 'ANIMALS' END, CASE WHEN objects LIKE '%car%' OR objects LIKE '%boat%' THEN 'VEHICLES' END,
  CASE WHEN objects LIKE '%person%' THEN 'PEOPLE' END, CASE WHEN objects LIKE '%frisbee%' OR objects LIKE '%kite%' THEN 'SPORTS' END,
  CASE WHEN green_ratio > 0.3e0 THEN 'NATURE' WHEN green_ratio > 0.15e0 THEN 'OUTDOOR' END, CASE WHEN sky_ratio > 0.4e0 THEN 'SKY' END, CASE WHEN sky_ratio > 0.4e0 THEN 'OUTDOOR' END,
  CASE WHEN line_count > 50 THEN 'GEOMETRIC' WHEN line_count > 20 THEN 'STRUCTURED' END, CASE WHEN green_ratio < 0.05e0 AND sky_ratio < 0.1e0 AND line_count > 30 THEN 'URBAN' END,
  CASE WHEN green_ratio < 0.05e0 AND sky_ratio < 0.1e0 AND line_count < 20 THEN 'INDOOR' END]) AS tag FROM o)
SELECT o.clip_id, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM t WHERE t.clip_id = o.clip_id), '') AS tags FROM o""")
def _(v):
    rows = v.sql(OBJECTS)
    tags = labels.content_tags(F.split("objects", ","), F.col("line_count"), F.col("green_ratio"), F.col("sky_ratio"))
    return rows.select("clip_id", F.array_join(tags, ",").alias("tags"))


LABEL_MEANS = "m AS (SELECT clip_id, label, avg(score) AS s FROM v_frame_label GROUP BY clip_id, label)"


@query("c08_combined_tags", f"""
WITH {LABEL_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(s, 9) DESC, label) AS k FROM m),
t AS (SELECT clip_id, list(label ORDER BY k) FILTER (k <= 3 AND round(s, 9) >= 0.45e0) AS top, max(s) AS best FROM r GROUP BY clip_id),
x AS (SELECT clip_id, coalesce(top, []::VARCHAR[]) AS top, best, CASE clip_id % 3 WHEN 0 THEN ['PORTRAIT', 'AF'] WHEN 1 THEN ['CROWD'] ELSE []::VARCHAR[] END AS scenes, clip_id % 4 > 0 AS face, clip_id % 4 AS n FROM t),
y AS (SELECT *, list_concat(top, list_filter(list_transform(scenes, lambda z: lower(z)), lambda z: NOT list_contains(list_transform(top, lambda q: lower(q)), z))) AS tags FROM x),
w AS (SELECT *, list_concat(tags, CASE WHEN face THEN [CASE WHEN n = 1 THEN 'person' ELSE 'people' END] ELSE []::VARCHAR[] END) AS final FROM y)
SELECT clip_id, CASE WHEN len(final) > 0 THEN array_to_string(final, ',') ELSE 'unknown' END AS tags, round(least(1e0, best * 0.7e0 + least(clip_id % 10 / 10e0 * 2, 1e0) * 0.3e0), 6) AS quality FROM w""")
def _(v):
    means = v.frame_label.groupBy("clip_id", "label").agg(F.round(F.avg("score"), 9).alias("s"))
    # at most one entry per label name
    maps = means.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("scores"))
    c = F.col("clip_id")
    scenes = F.when(c % 3 == 0, F.array(F.lit("PORTRAIT"), F.lit("AF"))).when(c % 3 == 1, F.array(F.lit("CROWD"))).otherwise(F.array().cast("array<string>"))
    tags = labels.combined_tags(F.col("scores"), scenes, c % 4 > 0, c % 4, 0.45)
    return maps.select("clip_id", F.array_join(tags, ",").alias("tags"), F.round(labels.analysis_quality(F.col("scores"), c % 10 / 10.0), 6).alias("quality"))


BANDS = "SELECT l_orderkey AS track_id, l_linenumber AS onset, l_quantity AS low, l_extendedprice / 2000e0 AS mid, l_discount * 500e0 AS high FROM lineitem"


@query("c09_onset_classes", f"""
WITH b AS ({BANDS}), s AS (SELECT *, low + mid + high AS tot, low + mid + high + 1e-10 AS tot2 FROM b)
SELECT track_id, onset, CASE WHEN tot = 0 THEN 'unknown' WHEN low / tot > 0.5e0 THEN 'kick' WHEN high / tot > 0.4e0 THEN 'hihat' WHEN mid / tot > 0.5e0 THEN 'snare' ELSE 'other' END AS onset_class,
  CASE WHEN low / tot2 > 0.4e0 THEN 'kick' WHEN mid / tot2 > 0.4e0 THEN 'snare' WHEN high / tot2 > 0.3e0 THEN 'hihat' WHEN low >= mid AND low >= high THEN 'kick' WHEN mid >= high THEN 'snare' ELSE 'hihat' END AS drum,
  CASE WHEN low / tot2 > 0.4e0 OR mid / tot2 > 0.4e0 OR high / tot2 > 0.3e0 THEN 1e0 ELSE 0.5e0 END AS factor FROM s""")
def _(v):
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")
    drum, factor = labels.drum_class(low, mid, high)
    return v.sql(BANDS).select("track_id", "onset", labels.onset_class(low, mid, high).alias("onset_class"), drum.alias("drum"), factor.alias("factor"))


@query("c10_scene_consistency", """
WITH d AS (SELECT clip_id, count(DISTINCT label) AS n FROM v_frame_label GROUP BY clip_id)
SELECT clip_id, CASE WHEN n = 1 THEN 'consistent' WHEN n <= 2 THEN 'dynamic' ELSE 'chaotic' END AS consistency FROM d""")
def _(v):
    counts = v.frame_label.groupBy("clip_id").agg(F.count_distinct("label").alias("n"))
    return counts.select("clip_id", labels.consistency(F.col("n")).alias("consistency"))


@query("a15_frame_label_summary", f"""
WITH {LABEL_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(s, 9) DESC, label) AS k FROM m WHERE round(s, 9) >= 0.5e0),
a AS (SELECT clip_id, string_agg(label, ',' ORDER BY k) AS tags, min_by(label, k) AS p, max(s) AS c FROM r WHERE k <= 5 GROUP BY clip_id)
SELECT f.clip_id, coalesce(a.tags, '') AS tags, coalesce(a.p, 'unknown') AS primary_label, round(coalesce(a.c, 0), 6) AS confidence FROM (SELECT DISTINCT clip_id FROM v_frame_label) f LEFT JOIN a ON a.clip_id = f.clip_id""")
def _(v):
    out = labels.label_summary(v.frame_label, ["clip_id"], threshold=0.5)
    return out.select("clip_id", F.array_join("tags", ",").alias("tags"), "primary_label", F.round("confidence", 6).alias("confidence"))


@query("a18_circular_statistics", """
WITH s AS (SELECT clip_id, sum(sin(radians(hue))) AS s, sum(cos(radians(hue))) AS c, count(*) AS n FROM v_frame GROUP BY clip_id), r AS (SELECT *, least(1e0, sqrt(s * s + c * c) / n) AS r FROM s)
SELECT clip_id, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 4) AS mean_angle,
  round(CASE WHEN r < 1e-10 THEN 180 ELSE least(180e0, degrees(sqrt(greatest(0e0, -2 * ln(greatest(r, 1e-12)))))) END, 4) AS angle_std FROM r""")
def _(v):
    out = labels.circular_stats(v.frame, ["clip_id"], "hue")
    return out.select("clip_id", F.round("mean_angle", 4).alias("mean_angle"), F.round("angle_std", 4).alias("angle_std"))


@query("a19_temporal_dynamics", """
WITH s AS (SELECT clip_id, count(*) AS n, stddev_pop(brightness) AS sd, sum(sin(radians(hue))) AS s, sum(cos(radians(hue))) AS c FROM v_frame GROUP BY clip_id),
r AS (SELECT *, least(1e0, sqrt(s * s + c * c) / n) AS r FROM s), d AS (SELECT clip_id, CASE WHEN n >= 2 THEN least(1e0, sd / 128) ELSE 0 END AS b,
  CASE WHEN n >= 2 THEN CASE WHEN r < 1e-10 THEN 180 ELSE least(180e0, degrees(sqrt(greatest(0e0, -2 * ln(greatest(r, 1e-12)))))) END / 180 ELSE 0 END AS h FROM r)
SELECT clip_id, round(b, 3) AS brightness_dynamics, round(h, 3) AS color_dynamics, CASE WHEN (b + h) / 2 < 0.15e0 THEN 'STEADY' WHEN (b + h) / 2 < 0.4e0 THEN 'DYNAMIC' ELSE 'FLASHY' END AS temporal_rhythm FROM d""")
def _(v):
    return labels.temporal_dynamics(v.frame, ["clip_id"])


@query("a20_motion_summary", """
WITH s AS (SELECT clip_id, avg(magnitude) AS a, stddev_pop(magnitude) AS sd FROM v_frame GROUP BY clip_id)
SELECT clip_id, round(a, 6) AS avg_magnitude, CASE WHEN a < 0.5e0 THEN 'STATIC' WHEN a < 2 THEN 'SLOW' WHEN a < 5 THEN 'MEDIUM' WHEN a < 10 THEN 'FAST' ELSE 'EXTREME' END AS motion_type,
  round(least(1e0, a / 15), 6) AS motion_score, CASE WHEN a < 0.1e0 OR sd / greatest(a, 0.001e0) < 0.5e0 THEN 'STEADY' ELSE 'ERRATIC' END AS motion_rhythm FROM s""")
def _(v):
    out = labels.motion_summary(v.frame, ["clip_id"])
    return out.select("clip_id", F.round("avg_magnitude", 6).alias("avg_magnitude"), "motion_type", F.round("motion_score", 6).alias("motion_score"), "motion_rhythm")


@query("a20_camera_motion", """
WITH f AS (SELECT clip_id, (frame_idx * 13 % 21) - 10e0 + clip_id % 3 AS x, (frame_idx * 7 % 15) - 7e0 AS y, magnitude / 10 AS m FROM v_frame),
s AS (SELECT clip_id, avg(x) AS x, avg(y) AS y, stddev_pop(m) AS sd FROM f GROUP BY clip_id), g AS (SELECT *, sqrt(x * x + y * y) / 320 * 100 AS size, (degrees(atan2(y, x)) + 180 + 360) % 360 AS ang FROM s)
SELECT clip_id, round(size, 6) AS camera_magnitude, CASE WHEN size < 0.5e0 THEN 'STATIC_CAM' WHEN sd > size * 0.5e0 THEN 'HANDHELD' WHEN ang >= 315 OR ang < 45 THEN 'PAN_RIGHT' WHEN ang < 135 THEN 'TILT_UP'
  WHEN ang < 225 THEN 'PAN_LEFT' ELSE 'TILT_DOWN' END AS camera_motion FROM g""")
def _(v):
    flow = v.frame.select("clip_id", (F.col("frame_idx") * 13 % 21 - 10.0 + F.col("clip_id") % 3).alias("flow_x"), (F.col("frame_idx") * 7 % 15 - 7.0).alias("flow_y"),
                          (F.col("magnitude") / 10).alias("magnitude"), F.lit(320.0).alias("norm_factor"))
    out = labels.camera_motion(flow, ["clip_id"])
    return out.withColumn("camera_magnitude", F.round("camera_magnitude", 6))


COUNTS = "SELECT clip_id, label, count(*) AS n FROM v_frame_label GROUP BY clip_id, label"


@query("t06_dominant_shares", f"""
WITH c AS ({COUNTS}), s AS (SELECT *, n * 100e0 / sum(n) OVER (PARTITION BY clip_id) AS p FROM c)
SELECT clip_id, label, n, round(p, 1) AS percent, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, label) AS rank FROM s WHERE p > 1""")
def _(v):
    return labels.dominant_shares(v.sql(COUNTS), ["clip_id"], "label")


@query("t07_top_objects", f"""
WITH c AS ({COUNTS}), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, label) AS k FROM c)
SELECT clip_id, string_agg(label, ',' ORDER BY k) FILTER (k <= 5) AS top, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY clip_id""")
def _(v):
    maps = v.sql(COUNTS).groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    return maps.select("clip_id", F.array_join(labels.top_objects(F.col("counts")), ",").alias("top"), labels.total_detections(F.col("counts")).alias("total"))
