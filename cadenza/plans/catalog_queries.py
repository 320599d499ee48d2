"""Queries over the clip catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import catalog, media
from cadenza.operators.ordered import borders, row_index
from cadenza.plans.registry import query
from cadenza.plans.walks_queries import ROWS


def families(v):
    """Side tables of the clips: motion, mood, style, colour and status."""
    mood = v.clip_mood.withColumn("moods", catalog.json_list(F.col("moods")))
    color = v.clip_mood.select("clip_id", F.col("brightness").alias("brightness_value"),
                               F.when(F.col("brightness") < 80, "DARK").when(F.col("brightness") > 180, "BRIGHT").otherwise("MEDIUM").alias("brightness"))
    style = v.clip_style.withColumn("styles", F.when(F.col("noise_level") > 0.5, F.array(F.lit("FILMIC"))).otherwise(F.array(F.lit("STANDARD"))))
    return {"motion": v.clip_motion, "mood": mood, "color": color, "style": style, "status": v.status}


def library(v):
    """Clips with all families."""
    return catalog.with_families(v.clip, families(v))


@query("s01_catalog_scan", """
SELECT c.clip_id, c.name, c.duration, m.motion_type, o.energy, o.brightness, s.sharpness, t.clip_id IS NOT NULL AS has_status FROM v_clip c LEFT JOIN v_clip_motion m ON m.clip_id = c.clip_id
LEFT JOIN v_clip_mood o ON o.clip_id = c.clip_id LEFT JOIN v_clip_style s ON s.clip_id = c.clip_id LEFT JOIN v_status t ON t.clip_id = c.clip_id WHERE c.is_available""")
def _(v):
    rows = library(v).filter("is_available")
    return rows.select("clip_id", "name", "duration", "motion.motion_type", "mood.energy", "mood.brightness", "style.sharpness", F.col("status").isNotNull().alias("has_status"))


@query("s02_project_clips_paged", "SELECT clip_id, name FROM v_clip WHERE project_id = 3 ORDER BY clip_id LIMIT 50 OFFSET 20")
def _(v):
    return catalog.page(v.clip.filter("project_id = 3"), ["clip_id"], 50, 20).select("clip_id", "name")


@query("s03_projects_newest_first", """
SELECT project_id, count(*) AS n_clips, max(clip_id) AS newest FROM v_clip GROUP BY project_id ORDER BY newest DESC LIMIT 5 OFFSET 2""")
def _(v):
    projects = v.clip.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_clips"), F.max("clip_id").alias("newest"))
    return catalog.page(projects, [F.col("newest").desc()], 5, 2)


@query("s04_audio_tracks_of_project", """
WITH k AS (SELECT track_id, bpm, track_id % 10 AS project_id FROM v_track) SELECT track_id, bpm FROM k WHERE project_id = 4""")
def _(v):
    return catalog.page(v.track.withColumn("project_id", F.col("track_id") % 10).filter("project_id = 4"), ["track_id"]).select("track_id", "bpm")


BROKEN = "CASE clip_id % 5 WHEN 0 THEN '[bad' WHEN 1 THEN NULL ELSE moods END"


@query("s05_json_decode", f"""
SELECT clip_id, CASE WHEN clip_id % 5 < 2 THEN 0 ELSE 2 END AS n, CASE WHEN clip_id % 5 < 2 THEN NULL ELSE json_extract_string(moods, '$[0]') END AS first FROM (SELECT clip_id, {BROKEN} AS raw, moods FROM v_clip_mood)""")
def _(v):
    rows = v.sql(f"SELECT clip_id, {BROKEN} AS raw FROM v_clip_mood").withColumn("list", catalog.json_list(F.col("raw")))
    return rows.select("clip_id", F.size("list").alias("n"), F.get("list", F.lit(0)).alias("first"))


@query("s06_json_encode", """
SELECT clip_id, concat('["', tags[1], '","', tags[2], '"]') AS json FROM (SELECT clip_id, list(tag ORDER BY tag) AS tags FROM v_tag GROUP BY clip_id) WHERE len(tags) = 2""")
def _(v):
    # a document has its source and its language as tags
    lists = v.tag.groupBy("clip_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return lists.filter(F.size("tags") == 2).select("clip_id", F.to_json("tags").alias("json"))


@query("s08_upsert_by_path", """
WITH n AS (SELECT p_partkey AS id, concat('/lib/', p_brand, '/', CAST(p_partkey + 100 AS VARCHAR(20)), '.mp4') AS file_path FROM part)
SELECT file_path, 'old' AS origin FROM v_clip UNION ALL SELECT file_path, 'new' FROM n WHERE file_path NOT IN (SELECT file_path FROM v_clip)""")
def _(v):
    old = v.clip.select("file_path", F.lit("old").alias("origin"))
    path = F.concat(F.lit("/lib/"), F.col("p_brand"), F.lit("/"), (F.col("p_partkey") + 100).cast("string"), F.lit(".mp4"))
    return catalog.upsert_by_path(old, v.table("part").select(path.alias("file_path"), F.lit("new").alias("origin")))


@query("s12_replace_analysis_rows", """
SELECT clip_id, motion_score FROM v_clip_motion WHERE clip_id % 4 <> 0 UNION ALL SELECT clip_id, 1 - motion_score FROM v_clip_motion WHERE clip_id % 4 = 0""")
def _(v):
    stored = v.clip_motion.select("clip_id", "motion_score")
    fresh = stored.filter("clip_id % 4 = 0").withColumn("motion_score", 1 - F.col("motion_score"))
    return catalog.replace_by_key(stored, fresh, ["clip_id"])


@query("s13_scene_timestamps", """
WITH n AS (SELECT clip_id, start_t, end_t, row_number() OVER (PARTITION BY clip_id ORDER BY start_t, end_t, track_id) - 1 AS i FROM v_usage)
SELECT clip_id, i * 2 AS position, start_t AS t, end_t - start_t AS duration FROM n UNION ALL SELECT clip_id, i * 2 + 1, end_t, end_t - start_t FROM n""")
def _(v):
    # start and end of scene i are entries 2i and 2i + 1 of the clip's list; the list stays rows
    scenes = row_index(v.usage, ["clip_id"], ["start_t", "end_t", "track_id"], "i", 365.0)
    points = F.array(F.struct((F.col("i") * 2).alias("position"), F.col("start_t").alias("t")), F.struct((F.col("i") * 2 + 1).alias("position"), F.col("end_t").alias("t")))
    return scenes.select("clip_id", (F.col("end_t") - F.col("start_t")).alias("duration"), F.inline(points)).select("clip_id", "position", "t", "duration")


@query("f01_composite_clip_filter", """
SELECT c.clip_id FROM v_clip c JOIN v_clip_motion m ON m.clip_id = c.clip_id JOIN v_clip_mood o ON o.clip_id = c.clip_id
WHERE m.motion_type IN ('FAST', 'EXTREME') AND (o.moods LIKE '%"CALM"%' OR o.moods LIKE '%"EUPHORIC"%') AND c.duration BETWEEN 5 AND 40 AND o.brightness >= 60 AND o.energy <= 0.8e0""")
def _(v):
    wanted = {"motion_type": ["FAST", "EXTREME"], "mood": ["CALM", "EUPHORIC"], "duration_range": (5, 40), "brightness_range": (60, None), "energy_range": (None, 0.8)}
    return catalog.filtered_families(v.clip, families(v), wanted).filter(catalog.clip_filter(wanted)).select("clip_id")


@query("j02_filter_on_analysis_state", """
SELECT c.clip_id FROM v_clip c LEFT JOIN v_status s ON s.clip_id = c.clip_id
WHERE s.clip_id IS NULL OR NOT (s.colors_analyzed AND s.motion_analyzed AND s.scene_analyzed AND s.mood_analyzed AND s.objects_analyzed AND s.style_analyzed)""")
def _(v):
    flags = ["colors_analyzed", "motion_analyzed", "scene_analyzed", "mood_analyzed", "objects_analyzed", "style_analyzed"]
    wanted = {"is_analyzed": False}
    return catalog.filtered_families(v.clip, families(v), wanted).filter(catalog.clip_filter(wanted, flags)).select("clip_id")


@query("j01_family_joins", """
SELECT count(*) AS n, count(m.clip_id) AS n_motion, count(o.clip_id) AS n_mood, count(s.clip_id) AS n_status FROM v_clip c LEFT JOIN v_clip_motion m ON m.clip_id = c.clip_id
LEFT JOIN v_clip_mood o ON o.clip_id = c.clip_id LEFT JOIN v_status s ON s.clip_id = c.clip_id""")
def _(v):
    return library(v).agg(F.count(F.lit(1)).alias("n"), F.count("motion").alias("n_motion"), F.count("mood").alias("n_mood"), F.count("status").alias("n_status"))


@query("f02_facet_filter", """
SELECT c.clip_id FROM v_clip c JOIN v_clip_motion m ON m.clip_id = c.clip_id JOIN v_clip_mood o ON o.clip_id = c.clip_id WHERE m.camera_motion = 'PAN_LEFT' AND contains(o.moods, '"DARK"')""")
def _(v):
    facets = {"camera_motion": "PAN_LEFT", "mood": "DARK", "motion_type": "All"}
    return catalog.filtered_families(v.clip, families(v), facets).filter(catalog.facet_filter(facets)).select("clip_id")


@query("f03_name_search", """
SELECT c.clip_id, contains(lower(concat(CAST(c.clip_id AS VARCHAR), '.mp4 ', c.codec, ' ', CAST(c.width AS VARCHAR), 'x', CAST(c.height AS VARCHAR))), 'h264 19') AS technical
FROM v_clip c JOIN v_clip_motion m ON m.clip_id = c.clip_id WHERE contains(lower(c.name), 'ring') AND m.motion_type = 'SLOW'""")
def _(v):
    facets = {"motion_type": "SLOW"}
    hits = catalog.filtered_families(v.clip, families(v), facets).filter(catalog.name_search("RING") & catalog.facet_filter(facets))
    return hits.select("clip_id", catalog.technical_search("H264 19").alias("technical"))


@query("f10_bounded_segments", """
WITH u AS (SELECT u.clip_id, u.track_id, (u.track_id % 40) * 1e0 AS s, u.end_t - u.start_t AS d, c.duration AS dur FROM v_usage u JOIN v_clip c ON c.clip_id = u.clip_id),
b AS (SELECT *, CASE WHEN dur <= 0 THEN NULL WHEN s + d > dur THEN CASE WHEN greatest(0e0, dur - s) >= 0.1e0 THEN greatest(0e0, dur - s) END ELSE d END AS kept FROM u)
SELECT clip_id, track_id, s, kept FROM b WHERE kept IS NOT NULL""")
def _(v):
    rows = v.usage.join(v.clip.select("clip_id", F.col("duration").alias("available")), "clip_id")
    rows = rows.withColumn("s", (F.col("track_id") % 40).cast("double"))
    kept = catalog.bounded_segment(F.col("s"), F.col("end_t") - F.col("start_t"), F.col("available"))
    return rows.withColumn("kept", kept).filter("kept IS NOT NULL").select("clip_id", "track_id", "s", "kept")


def sized(v):
    return v.clip.withColumn("frame_count", (F.col("duration") * F.col("fps")).cast("bigint"))


PROPS = """p AS (SELECT clip_id, width AS w, height AS h, fps, CAST(trunc(duration * fps) AS BIGINT) AS fc, codec FROM v_clip),
q AS (SELECT *, w * h * 3 / 1048576e0 AS mb, least(1920e0 / w, 1080e0 / h) AS sc, w > 1920 OR h > 1080 AS big, codec = 'h264' AS fast, CASE WHEN fps >= 60 THEN 0.25e0 WHEN fps >= 30 THEN 0.5e0 ELSE 1e0 END AS sr FROM p)"""


@query("f13_media_properties", f"""
WITH {PROPS} SELECT clip_id, round(w / CAST(h AS DOUBLE), 6) AS aspect_ratio, CASE WHEN w >= 3840 THEN '4K+' WHEN w >= 1920 THEN '1080p' WHEN w >= 1280 THEN '720p' WHEN w >= 720 THEN '480p' ELSE 'low_res' END AS resolution_class,
  CASE WHEN fps >= 60 THEN 'high_fps' WHEN fps >= 30 THEN 'standard_fps' WHEN fps >= 24 THEN 'cinema_fps' ELSE 'low_fps' END AS fps_class,
  round(least(1e0, least(w * h / 2073600e0, 1e0) * 0.6e0 + least(fps / 60, 1e0) * 0.4e0), 6) AS quality_score, sr AS sample_rate,
  CASE WHEN big THEN CAST(trunc(w * sc) AS INT) // 2 * 2 END AS resize_width, CASE WHEN big THEN CAST(trunc(h * sc) AS INT) // 2 * 2 END AS resize_height,
  round(mb * least(fc, 100), 4) AS total_mb, fast AS fast_decode FROM q""")
def _(v):
    out = media.properties(sized(v))
    return out.select("clip_id", F.round("aspect_ratio", 6).alias("aspect_ratio"), "resolution_class", "fps_class", F.round("quality_score", 6).alias("quality_score"),
                      "sample_rate", F.col("resize.width").alias("resize_width"), F.col("resize.height").alias("resize_height"),
                      F.round("total_mb", 4).alias("total_mb"), "fast_decode")


@query("f14_compatibility_score", f"""
WITH {PROPS}, r AS (SELECT *, mb * least(fc, 100) AS tot, least(fc * sr, 100) AS fr, w * h / 2073600e0 * 0.05e0 * 3 AS ft FROM q)
SELECT clip_id, round(least(1e0, least(1e0, sc) * 0.3e0 + least(1e0, 60 / fps) * 0.2e0 + CASE WHEN fast THEN 1e0 ELSE 0.5e0 END * 0.25e0 + greatest(0e0, 1 - tot / 4000) * 0.25e0), 6) AS compatibility,
  round(fr * (0.01e0 + ft) + fc * 0.005e0, 4) AS total_seconds, concat_ws(',', CASE WHEN big THEN 'resize' END, CASE WHEN fps > 60 THEN 'frame_sampling' END, CASE WHEN NOT fast THEN 'codec_warning' END,
  CASE WHEN tot > 2000 THEN 'high_memory' END) AS recommendations, CASE WHEN tot > 2000 THEN 'high' ELSE 'low' END AS impact FROM r""")
def _(v):
    out = media.compatibility(media.properties(sized(v)))
    return out.select("clip_id", F.round("compatibility", 6).alias("compatibility"), F.round("total_seconds", 4).alias("total_seconds"),
                      F.array_join("recommendations", ",").alias("recommendations"), "impact")


@query("f15_point_lookup", "SELECT clip_id, name, file_path FROM v_clip WHERE clip_id = 42")
def _(v):
    return v.clip.filter("clip_id = 42").select("clip_id", "name", "file_path")


@query("f15_available_ids", "SELECT clip_id FROM v_clip WHERE is_available AND clip_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _(v):
    keys = v.table("lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("clip_id"))
    return v.clip.filter("is_available").join(keys, "clip_id", "left_semi").select("clip_id")


@query("t01_library_sort", """
SELECT clip_id, motion_score FROM (SELECT c.clip_id, coalesce(m.motion_score, 0) AS motion_score FROM v_clip c LEFT JOIN v_clip_motion m ON m.clip_id = c.clip_id) ORDER BY motion_score DESC, clip_id""")
def _(v):
    rows = catalog.with_families(v.clip, {"motion": v.clip_motion}).orderBy(*catalog.library_order("motion"))
    return rows.select("clip_id", F.coalesce("motion.motion_score", F.lit(0.0)).alias("motion_score"))


@query("t02_page_by_sort", """
SELECT clip_id, duration FROM v_clip ORDER BY duration DESC, clip_id LIMIT 100 OFFSET 40""")
def _(v):
    return catalog.page(v.clip, catalog.library_order("duration"), 100, 40).select("clip_id", "duration")


@query("t04_unavailable_latest_first", "SELECT clip_id, content_fingerprint FROM v_asset WHERE NOT is_available ORDER BY clip_id DESC")
def _(v):
    return v.asset.filter("NOT is_available").orderBy(F.col("clip_id").desc()).select("clip_id", "content_fingerprint")


@query("a03_exact_duplicate_groups", """
WITH g AS (SELECT content_fingerprint, min(clip_id) AS group_id, count(*) AS group_size FROM v_asset GROUP BY content_fingerprint HAVING count(*) > 1)
SELECT a.clip_id, g.group_id, g.group_size FROM v_asset a JOIN g ON g.content_fingerprint = a.content_fingerprint""")
def _(v):
    return catalog.duplicate_groups(v.asset).select("clip_id", "group_id", "group_size")


@query("a04_clips_by_folder", """
SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, clip_id, count(*) OVER (PARTITION BY regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS n_in_folder FROM v_asset WHERE is_available""")
def _(v):
    return catalog.by_folder(v.asset)


@query("j04_orphaned_rows", """
SELECT s.clip_id, 'orphan' AS state FROM v_status s WHERE NOT EXISTS (SELECT 1 FROM v_asset a WHERE a.clip_id = s.clip_id AND a.is_available)
UNION ALL SELECT s.clip_id, 'kept' FROM v_status s WHERE EXISTS (SELECT 1 FROM v_asset a WHERE a.clip_id = s.clip_id AND a.is_available)""")
def _(v):
    gone = v.asset.filter("NOT is_available").select("clip_id")
    left, children = catalog.cascade_delete(v.asset, gone, "clip_id", {"status": v.status})
    lost = catalog.orphans(v.status, left, "clip_id").select("clip_id", F.lit("orphan").alias("state"))
    return lost.unionByName(children["status"].select("clip_id", F.lit("kept").alias("state")))


@query("j05_new_content", """
SELECT clip_id FROM v_asset WHERE clip_id % 2 = 0 AND content_fingerprint NOT IN (SELECT content_fingerprint FROM v_asset WHERE clip_id % 2 = 1)""")
def _(v):
    return catalog.new_content(v.asset.filter("clip_id % 2 = 0"), v.asset.filter("clip_id % 2 = 1")).select("clip_id")


@query("j06_exact_duplicate_lookup", """
SELECT a.clip_id, min(b.clip_id) AS match_id FROM v_asset a JOIN v_asset b ON b.content_fingerprint = a.content_fingerprint WHERE a.clip_id % 2 = 0 AND b.clip_id % 2 = 1 GROUP BY a.clip_id""")
def _(v):
    return catalog.exact_duplicates(v.asset.filter("clip_id % 2 = 0"), v.asset.filter("clip_id % 2 = 1").withColumnRenamed("clip_id", "known_id"),
                                    item_id="known_id").select("clip_id", "match_id")


LISTING = """SELECT CASE WHEN clip_id % 3 = 0 THEN concat('/moved', file_path) ELSE file_path END AS file_path, content_fingerprint FROM v_asset WHERE clip_id % 5 <> 0"""


@query("j07_relocation", f"""
WITH l AS ({LISTING}), lost AS (SELECT a.* FROM v_asset a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.file_path = a.file_path)),
d AS (SELECT *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM l)
SELECT clip_id, file_path AS new_path, 'present' AS status FROM v_asset a WHERE EXISTS (SELECT 1 FROM l WHERE l.file_path = a.file_path)
UNION ALL SELECT clip_id, p, CASE WHEN p IS NULL THEN 'missing' ELSE 'relocated' END FROM (SELECT clip_id, coalesce((SELECT min(d.file_path) FROM d WHERE d.content_fingerprint = lost.content_fingerprint
  AND d.dir = regexp_extract(lost.file_path, '^(.*)/[^/]*$', 1)), (SELECT min_by(d.file_path, (CASE WHEN d.file_path LIKE '/moved%' THEN 0 ELSE 1 END, d.file_path)) FROM d WHERE d.content_fingerprint = lost.content_fingerprint)) AS p FROM lost)""")
def _(v):
    return catalog.relocate(v.asset, v.sql(LISTING), ["/moved"]).select("clip_id", "new_path", "status")


@query("j07_relocation_statistics", f"""
WITH l AS ({LISTING}), s AS (SELECT a.clip_id, EXISTS (SELECT 1 FROM l WHERE l.file_path = a.file_path) AS here, EXISTS (SELECT 1 FROM l WHERE l.content_fingerprint = a.content_fingerprint) AS copy FROM v_asset a)
SELECT count(*) AS total, count(*) FILTER (here OR copy) AS available, count(*) FILTER (NOT here AND NOT copy) AS missing, count(*) FILTER (NOT here AND copy) AS relocated FROM s""")
def _(v):
    return catalog.relocation_stats(catalog.relocate(v.asset, v.sql(LISTING), ["/moved"]))


@query("x08_availability_update", f"""
WITH l AS ({LISTING}), s AS (SELECT a.clip_id, a.file_path, EXISTS (SELECT 1 FROM l WHERE l.file_path = a.file_path OR l.content_fingerprint = a.content_fingerprint) AS seen FROM v_asset a)
SELECT clip_id, file_path AS original_path, seen AS is_available, seen AS has_sight FROM s""")
def _(v):
    found = catalog.relocate(v.asset, v.sql(LISTING), ["/moved"])
    out = catalog.apply_availability(v.asset, found, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("clip_id", "original_path", "is_available", F.col("last_seen_at").isNotNull().alias("has_sight"))


@query("j17_tags_of_clips", "SELECT t.clip_id, t.tag FROM v_tag t JOIN v_asset a ON a.clip_id = t.clip_id WHERE a.is_available AND t.tag IN (SELECT DISTINCT lang FROM documents)")
def _(v):
    return catalog.tags_of(v.asset.filter("is_available"), v.tag, v.table("documents").select(F.col("lang").alias("tag")))


@query("x12_tag_edits", """
SELECT clip_id, tag FROM (SELECT clip_id, tag FROM v_tag UNION SELECT clip_id, 'en' FROM v_tag WHERE clip_id % 3 = 0) t
WHERE NOT (clip_id % 5 = 0 AND tag = 'de') AND tag <> (SELECT min(source) FROM documents)""")
def _(v):
    assign = v.tag.filter("clip_id % 3 = 0").select("clip_id", F.lit("en").alias("tag"))
    remove = v.tag.filter("clip_id % 5 = 0 AND tag = 'de'")
    deleted = v.table("documents").agg(F.min("source").alias("tag"))
    return catalog.edit_tags(v.tag, assign, remove, deleted)


@query("x04_cache_keys", """
SELECT clip_id, sha256(concat_ws('_', file_path, CAST(width AS VARCHAR), CAST(height AS VARCHAR))) AS key, md5(concat(file_path, printf('%.3f_%.3f', duration, fps), concat_ws('_', CAST(width AS VARCHAR), codec))) AS segment_key FROM v_clip""")
def _(v):
    key = catalog.cache_key(F.col("file_path"), F.col("width"), F.col("height"))
    seg = catalog.segment_cache_key(F.col("file_path"), F.col("duration"), F.col("fps"), [F.col("width").cast("string"), F.col("codec")])
    return v.clip.select("clip_id", key.alias("key"), seg.alias("segment_key"))


@query("x09_batch_delete", """
SELECT 'clips' AS part, count(*) AS n FROM v_asset WHERE clip_id % 6 <> 1 UNION ALL SELECT 'status', count(*) FROM v_status WHERE clip_id IN (SELECT clip_id FROM v_asset WHERE clip_id % 6 <> 1)
UNION ALL SELECT 'tags', count(*) FROM v_tag WHERE clip_id IN (SELECT clip_id FROM v_asset WHERE clip_id % 6 <> 1)""")
def _(v):
    left, children = catalog.cascade_delete(v.asset, v.asset.filter("clip_id % 6 = 1"), "clip_id", {"status": v.status, "tags": v.tag})
    out = None
    for name, df in {"clips": left, **children}.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("x10_create_with_parent_check", """
SELECT l_orderkey AS id, l_linenumber AS line, EXISTS (SELECT 1 FROM v_clip c WHERE c.clip_id = l_partkey AND c.is_available) AS accepted FROM lineitem""")
def _(v):
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("clip_id"))
    good, bad = catalog.accept_with_parent(rows, v.clip.filter("is_available"), "clip_id")
    return good.select("id", "line", F.lit(True).alias("accepted")).unionByName(bad.select("id", "line", F.lit(False).alias("accepted")))


INVENTORY = "SELECT o_orderkey AS path, o_totalprice AS size_bytes, o_orderdate AS modified_at, o_custkey % 7 AS cache FROM orders"


@query("x11_expired_rows", f"WITH i AS ({INVENTORY}) SELECT path FROM i WHERE epoch(TIMESTAMP '1995-06-01 00:00:00') - epoch(modified_at) > 604800")
def _(v):
    rows = v.sql(INVENTORY).withColumn("modified_at", F.col("modified_at").cast("timestamp"))
    return catalog.expired(rows, F.lit("1995-06-01 00:00:00").cast("timestamp")).select("path")


@query("x11_size_bounded_eviction", f"""
WITH i AS ({INVENTORY}), s AS (SELECT path, cache, sum(CAST(round(size_bytes) AS BIGINT)) OVER (PARTITION BY cache ORDER BY modified_at DESC, path ROWS UNBOUNDED PRECEDING) AS total FROM i) SELECT path, cache FROM s WHERE total > 5000000""")
def _(v):
    rows = v.sql(INVENTORY).withColumn("modified", F.unix_seconds(F.col("modified_at").cast("timestamp"))).withColumn("size_bytes", F.round("size_bytes").cast("bigint"))
    axis = borders(rows.withColumn("_age", -F.col("modified")), ["cache"], "_age", ROWS)
    return catalog.over_budget(rows, 5_000_000, ["cache"], width=axis).select("path", "cache")


@query("x15_field_updates", """
SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN concat(name, ' v2') ELSE name END AS name, CASE WHEN clip_id % 6 = 0 THEN 1e0 ELSE duration END AS duration, CASE WHEN clip_id % 3 = 0 THEN 2 ELSE 1 END AS modified_at FROM v_clip""")
def _(v):
    changes = v.clip.filter("clip_id % 3 = 0").select("clip_id", F.concat("name", F.lit(" v2")).alias("name"), F.when(F.col("clip_id") % 6 == 0, 1.0).alias("duration"))
    table = v.clip.select("clip_id", "name", "duration", F.lit(1).alias("modified_at"))
    return catalog.update_fields(table, changes, "clip_id", F.lit(2))
