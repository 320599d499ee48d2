"""Queries over processing state and usage statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import vectors
from cadenza.operators import matching, state
from cadenza.plans.registry import query

MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {f} THEN '{n}' END" for n, f in state.FLAGS.items()) + ")"
OUTDATED = "concat_ws(',', CASE WHEN colors_version < 1 THEN 'colors' END, CASE WHEN motion_version < 2 THEN 'motion' END)"
VERSIONS = {"colors": 1, "motion": 2}
SIX = "colors_analyzed AND motion_analyzed AND scene_analyzed AND mood_analyzed AND style_analyzed AND fingerprint_created"


@query("f04_missing_analyses", f"SELECT clip_id, {MISSING} AS missing, {MISSING} = '' AS complete FROM v_status")
def _(v):
    return v.status.select("clip_id", F.array_join(state.missing_analyses(), ",").alias("missing"), state.fully_analyzed().alias("complete"))


@query("f05_outdated_analyses", f"SELECT clip_id, {OUTDATED} AS outdated FROM v_status")
def _(v):
    return v.status.select("clip_id", F.array_join(state.outdated_analyses(VERSIONS), ",").alias("outdated"))


@query("x07_outdated_clips", f"SELECT clip_id FROM v_status WHERE {OUTDATED} <> '' ORDER BY clip_id")
def _(v):
    return v.status.filter(F.size(state.outdated_analyses(VERSIONS)) > 0).select("clip_id").orderBy("clip_id")


@query("j03_unanalyzed_clips", f"""
SELECT a.clip_id FROM v_asset a LEFT JOIN v_status s ON s.clip_id = a.clip_id WHERE a.needs_reanalysis OR (a.is_available AND (s.clip_id IS NULL OR NOT ({SIX})))""")
def _(v):
    return state.unanalyzed(v.asset, v.status).select("clip_id")


@query("a01_analysis_statistics", f"""
WITH c AS (SELECT count(*) AS total FROM v_asset WHERE is_available), s AS (SELECT count(*) FILTER ({SIX}) AS f, count(*) FILTER (colors_analyzed) AS colors_count, count(*) FILTER (motion_analyzed) AS motion_count,
  count(*) FILTER (scene_analyzed) AS scene_count, count(*) FILTER (mood_analyzed) AS mood_count, count(*) FILTER (objects_analyzed) AS objects_count, count(*) FILTER (style_analyzed) AS style_count FROM v_status)
SELECT total AS total_clips, f AS fully_analyzed, total - f AS pending, round(f * 100e0 / total, 1) AS percentage, colors_count, motion_count, scene_count, mood_count, objects_count, style_count FROM c, s""")
def _(v):
    return state.statistics(v.asset, v.status)


@query("a02_catalog_statistics", """
SELECT count(*) AS total_clips, count(*) FILTER (NOT needs_reanalysis) AS analyzed, count(*) FILTER (needs_reanalysis) AS unanalyzed, count(*) FILTER (is_available) AS available,
  count(*) FILTER (NOT is_available) AS unavailable FROM v_asset""")
def _(v):
    return state.catalog_counts(v.asset)


@query("a24_unanalyzed_count", "SELECT count(*) AS n FROM (SELECT CASE WHEN clip_id % 6 = 0 THEN NULL ELSE needs_reanalysis END AS f FROM v_asset) WHERE f OR f IS NULL")
def _(v):
    return state.needs_analysis_count(v.asset.withColumn("needs_reanalysis", F.when(F.col("clip_id") % 6 != 0, F.col("needs_reanalysis"))))


@query("a25_status_breakdown", f"""
WITH j AS (SELECT a.needs_reanalysis AS flag, CASE WHEN s.clip_id IS NULL THEN 'no_record' WHEN {MISSING} = '' THEN 'full' ELSE 'partial' END AS level FROM v_asset a LEFT JOIN v_status s ON s.clip_id = a.clip_id)
SELECT level, count(*) AS n FROM j GROUP BY level UNION ALL SELECT 'flagged', count(*) FROM j WHERE flag HAVING count(*) > 0 UNION ALL SELECT 'total', count(*) FROM j""")
def _(v):
    return state.breakdown(v.asset, v.status)


@query("a26_level_distribution", """
WITH c AS (SELECT motion_type, count(*) AS n FROM v_clip_motion GROUP BY motion_type) SELECT motion_type, n, round(n * 100e0 / sum(n) OVER (), 6) AS percent FROM c""")
def _(v):
    return state.distribution(v.clip_motion, "motion_type").withColumn("percent", F.round("percent", 6))


def uses(v):
    return v.usage.select("clip_id", (F.col("end_t") - F.col("start_t")).alias("duration"), "start_t", "track_id", F.col("start_t").alias("used_at"))


@query("a07_usage_upsert_halving", """
WITH s AS (SELECT clip_id, list(end_t - start_t ORDER BY track_id, start_t, end_t - start_t) AS l, max(start_t) AS last_used FROM v_usage GROUP BY clip_id),
o AS (SELECT p_partkey AS clip_id, p_size AS n, p_retailprice AS a FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(s.clip_id, o.clip_id) AS clip_id, coalesce(len(l), 0) + coalesce(n, 0) AS usage_count, coalesce(s.last_used, 0e0) AS last_used,
  round(list_reduce(list_concat(CASE WHEN o.a IS NULL THEN []::DOUBLE[] ELSE [o.a] END, coalesce(l, []::DOUBLE[])), lambda x, y: (x + y) / 2), 6) AS avg_duration
FROM s FULL JOIN o ON o.clip_id = s.clip_id""")
def _(v):
    stats = v.table("part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("clip_id"), F.col("p_size").cast("bigint").alias("usage_count"), F.col("p_retailprice").alias("avg_duration"), F.lit(0.0).alias("last_used"))
    out = state.merge_usage(stats, uses(v), ["track_id", "start_t", "duration"], halving=True, width=20_000.0)
    return out.withColumn("avg_duration", F.round("avg_duration", 6))


@query("a07_usage_upsert_mean", """
WITH s AS (SELECT clip_id, count(*) AS k, sum(end_t - start_t) AS t, max(start_t) AS last_used FROM v_usage GROUP BY clip_id), o AS (SELECT p_partkey AS clip_id, p_size AS n, p_retailprice AS a FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(s.clip_id, o.clip_id) AS clip_id, coalesce(k, 0) + coalesce(n, 0) AS usage_count, coalesce(s.last_used, 0e0) AS last_used,
  round((coalesce(a * n, 0) + coalesce(t, 0)) / (coalesce(k, 0) + coalesce(n, 0)), 6) AS avg_duration FROM s FULL JOIN o ON o.clip_id = s.clip_id""")
def _(v):
    stats = v.table("part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("clip_id"), F.col("p_size").cast("bigint").alias("usage_count"), F.col("p_retailprice").alias("avg_duration"), F.lit(0.0).alias("last_used"))
    return state.merge_usage(stats, uses(v), []).withColumn("avg_duration", F.round("avg_duration", 6))


@query("a08_last_write_wins", """
SELECT track_id, arg_max(base_strength, seq) AS bpm, max(seq) AS written FROM v_trigger WHERE track_id % 2 = 0 GROUP BY track_id UNION ALL SELECT track_id, bpm, 0 FROM v_track WHERE track_id % 2 = 1""")
def _(v):
    writes = v.trigger.filter("track_id % 2 = 0").select("track_id", F.col("base_strength").alias("bpm"), F.col("seq").alias("written"))
    stored = v.track.select("track_id", "bpm", F.lit(0).cast("bigint").alias("written"))
    return state.last_write_wins(stored, writes, ["track_id"], "written")


STATUS_EVENTS = """SELECT doc_id AS clip_id, CASE doc_id % 4 WHEN 0 THEN 'colors' WHEN 1 THEN 'motion' WHEN 2 THEN 'vector' ELSE 'unknown' END AS analysis, n_chars % 2 = 0 AS success, doc_id AS happened FROM documents
UNION ALL SELECT doc_id, 'colors', n_chars % 3 = 0, doc_id + 100000 FROM documents WHERE doc_id % 8 = 0"""


@query("x05_status_updates", f"""
WITH e AS ({STATUS_EVENTS}), l AS (SELECT clip_id, arg_max(success, happened) FILTER (analysis = 'colors') AS c, arg_max(success, happened) FILTER (analysis = 'motion') AS m, arg_max(success, happened) FILTER (analysis = 'vector') AS x
  FROM e WHERE analysis <> 'unknown' GROUP BY clip_id)
SELECT coalesce(s.clip_id, l.clip_id) AS clip_id, coalesce(l.c, s.colors_analyzed, FALSE) AS colors_analyzed, coalesce(l.m, s.motion_analyzed, FALSE) AS motion_analyzed, coalesce(s.scene_analyzed, FALSE) AS scene_analyzed,
  coalesce(l.x, s.vector_extracted, FALSE) AS vector_extracted, CASE WHEN l.c IS NOT NULL THEN 1 ELSE coalesce(s.colors_version, 0) END AS colors_version,
  CASE WHEN l.m IS NOT NULL THEN 1 ELSE coalesce(s.motion_version, 0) END AS motion_version FROM v_status s FULL JOIN l ON l.clip_id = s.clip_id""")
def _(v):
    out = state.apply_status_events(v.status, v.sql(STATUS_EVENTS))
    return out.select("clip_id", "colors_analyzed", "motion_analyzed", "scene_analyzed", "vector_extracted", "colors_version", "motion_version")


@query("x06_reset_analyses", """
SELECT s.clip_id, s.colors_analyzed AND s.clip_id % 3 <> 0 AS colors_analyzed, CASE WHEN s.clip_id % 3 = 0 THEN 0 ELSE s.motion_version END AS motion_version, a.needs_reanalysis OR s.clip_id % 3 = 0 AS needs_reanalysis
FROM v_status s JOIN v_asset a ON a.clip_id = s.clip_id""")
def _(v):
    s, c = state.reset(v.status, v.asset, v.status.filter("clip_id % 3 = 0"))
    return s.join(c.select("clip_id", "needs_reanalysis"), "clip_id").select("clip_id", "colors_analyzed", "motion_version", "needs_reanalysis")


@query("x16_status_repair", """
SELECT clip_id, TRUE AS fingerprint_created, vector_extracted OR clip_id % 5 = 0 AS vector_extracted, clip_id % 5 = 0 AND NOT vector_extracted AS repaired FROM v_status""")
def _(v):
    prints = v.asset.select("clip_id", F.when(F.col("clip_id") % 3 == 0, F.col("content_fingerprint")).alias("phash"), F.lit(None).cast("string").alias("dhash"),
                            F.when(F.col("clip_id") % 5 == 0, F.col("file_path")).alias("vector_file"))
    return state.repair_status(v.status, prints).select("clip_id", "fingerprint_created", "vector_extracted", "repaired")


@query("x17_ad_hoc_sql", "SELECT clip_id, count(*) AS n, sum(end_t - start_t) AS total FROM v_usage GROUP BY clip_id HAVING count(*) >= 25")
def _(v):
    return state.run_sql({"clip_usage": v.usage}, "SELECT clip_id, count(*) AS n, sum(end_t - start_t) AS total FROM clip_usage GROUP BY clip_id HAVING count(*) >= :least",
                         {"least": 25})


@query("x03_safe_numbers", """
SELECT event_id, coalesce(TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN NULL ELSE '1e3' END AS DOUBLE), 0.5e0) AS value FROM events""")
def _(v):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "abc").when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.lit(None)).otherwise("1e3")
    return v.table("events").select("event_id", vectors.safe_number(text, 0.5).alias("value"))


@query("u03_available_minus_excluded", "SELECT clip_id FROM v_clip WHERE is_available EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(v):
    excluded = v.table("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("clip_id"))
    return v.clip.filter("is_available").join(excluded, "clip_id", "left_anti").select("clip_id")


TAG_INPUT = """SELECT t.track_id, t.bpm, CASE t.track_id % 3 WHEN 0 THEN 'party,crowd,city,night' WHEN 1 THEN 'calm,beach' ELSE 'party' END AS tags, t.track_id % 2 = 0 AS stems, (t.track_id % 10) / 10e0 AS quality,
  (t.track_id % 7) / 7e0 AS confidence, (t.track_id % 4) / 4e0 AS stability FROM v_track t"""


@query("u04_ordered_distinct_tags", f"""
WITH i AS ({TAG_INPUT}), p AS (SELECT *, list_concat(string_split(tags, ',')[1:3], list_concat(CASE WHEN bpm > 130 THEN ['high_energy', 'fast_tempo'] WHEN bpm < 100 THEN ['slow_tempo', 'chill'] ELSE ['medium_tempo'] END,
  CASE WHEN stems THEN ['stems_enhanced'] ELSE []::VARCHAR[] END)) AS l FROM i)
SELECT track_id, array_to_string(l[1:5], ',') AS tags FROM p""")
def _(v):
    rows = v.sql(TAG_INPUT)
    return rows.select("track_id", F.array_join(matching.multi_modal_tags(F.split("tags", ","), F.col("bpm"), F.col("stems")), ",").alias("tags"))


@query("m11_cross_modal_scores", f"""
WITH i AS ({TAG_INPUT}), f AS (SELECT *, tags LIKE '%party%' AS lively, tags LIKE '%calm%' AS calm, tags LIKE '%party%' OR tags LIKE '%crowd%' AS lively2 FROM i),
s AS (SELECT *, least(1e0, greatest(0e0, 0.5e0 + CASE WHEN bpm > 130 THEN CASE WHEN lively THEN 0.3e0 WHEN calm THEN -0.2e0 ELSE 0 END WHEN bpm < 100 THEN CASE WHEN calm THEN 0.3e0 WHEN lively THEN -0.2e0 ELSE 0 END ELSE 0 END
  + ((quality + stability) / 2 - 0.5e0) * 0.2e0)) AS sync, CASE WHEN bpm > 130 AND lively2 THEN 'high_energy' WHEN bpm < 100 AND calm THEN 'calm' WHEN bpm BETWEEN 100 AND 130 THEN 'dynamic' ELSE 'mismatch' END AS align FROM f)
SELECT track_id, round(sync, 6) AS sync, align AS alignment, round((0.8e0 + stability + quality + confidence + sync + CASE WHEN stems THEN 0.9e0 ELSE 0 END) / CASE WHEN stems THEN 6 ELSE 5 END, 6) AS quality,
  CASE align WHEN 'high_energy' THEN 'fast' WHEN 'calm' THEN 'slow' WHEN 'mismatch' THEN 'adaptive' ELSE CASE WHEN bpm > 140 THEN 'fast' WHEN bpm > 110 THEN 'medium' ELSE 'slow' END END AS pacing,
  coalesce(nullif(concat_ws(',', CASE WHEN bpm > 80 THEN 'beat_sync' END, CASE WHEN stems THEN 'stem_triggers' END, CASE WHEN quality <> 0 THEN 'energy_peaks' END, CASE WHEN confidence > 0.6e0 THEN 'scene_changes' END,
  CASE WHEN sync > 0.7e0 THEN 'audio_video_sync' END), ''), 'beat_sync') AS suggestions FROM s""")
def _(v):
    rows = v.sql(TAG_INPUT).withColumn("tags", F.split("tags", ","))
    bpm, tags, stems, quality, conf, stab = (F.col(c) for c in ("bpm", "tags", "stems", "quality", "confidence", "stability"))
    rows = rows.withColumn("sync", matching.cross_modal_score(bpm, tags, quality, stab)).withColumn("alignment", matching.mood_alignment(bpm, tags))
    sync = F.col("sync")
    return rows.select("track_id", F.round("sync", 6).alias("sync"), "alignment", F.round(matching.content_quality(bpm, quality, conf, sync, stab, stems), 6).alias("quality"),
                       matching.recommended_pacing(bpm, F.col("alignment")).alias("pacing"),
                       F.array_join(matching.cut_suggestions(bpm, stems, quality, conf, sync), ",").alias("suggestions"))


@query("m12_confidence_and_zones", f"""
WITH i AS ({TAG_INPUT}) SELECT track_id, round(least(1e0, greatest(0e0, (confidence + quality) / 2 + least((track_id % 6) / 5e0, 0.2e0) - CASE WHEN quality >= 0.5e0 THEN 0 ELSE 0.3e0 END)), 6) AS confidence,
  round(least(1e0, greatest(0e0, (least(bpm / 140, 1e0) + confidence) / 2)), 6) AS correlation, CASE WHEN (stability + confidence) / 2 > 0.5e0 THEN round((stability + confidence) / 2, 6) END AS zone_quality FROM i""")
def _(v):
    bpm, quality, conf, stab = (F.col(c) for c in ("bpm", "quality", "confidence", "stability"))
    return v.sql(TAG_INPUT).select("track_id", F.round(matching.pacing_confidence(conf, quality, F.col("track_id") % 6), 6).alias("confidence"),
                                   F.round(matching.energy_correlation(bpm, conf), 6).alias("correlation"),
                                   F.round(matching.quality_zone(stab, conf)["quality"], 6).alias("zone_quality"))


@query("u02_suggested_cut_points", """
WITH s AS (SELECT track_id, list(DISTINCT CAST(floor(t / 86400e0) AS DOUBLE)) FILTER (base_strength > 0.9e0) AS tr FROM v_trigger GROUP BY track_id),
p AS (SELECT s.track_id, unnest(list_concat(CASE WHEN k.bpm > 60 THEN list_transform(range(0, CAST(floor(k.duration / 3600 * k.bpm / 60) AS BIGINT), 4), lambda i: i * (60e0 / k.bpm)) ELSE []::DOUBLE[] END, coalesce(tr, []::DOUBLE[]))) AS x FROM s JOIN v_track k ON k.track_id = s.track_id),
r AS (SELECT track_id, x, row_number() OVER (PARTITION BY track_id ORDER BY x) AS i FROM (SELECT DISTINCT * FROM p))
SELECT track_id, i, round(x, 6) AS t FROM r""")
def _(v):
    # at most one transition per calendar day; beats for as many seconds as the track has hours
    strong = v.trigger.groupBy("track_id").agg(F.collect_set(F.when(F.col("base_strength") > 0.9, F.floor(F.col("t") / 86_400.0).cast("double"))).alias("tr"))
    points = matching.suggested_points(F.col("bpm"), F.col("tr"), F.floor(F.col("duration") / 3600 * F.col("bpm") / 60))
    return v.track.join(strong, "track_id").select("track_id", F.posexplode(points).alias("i", "t")).select(
        "track_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("t", 6).alias("t"))
