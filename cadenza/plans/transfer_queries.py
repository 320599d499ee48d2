"""Queries over documents, keyframes, XML libraries and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators.ordered import row_index
from cadenza.plans.registry import query
from cadenza.session import scratch_path
from cadenza.sources import documents

KEYFRAMES = """w AS (SELECT track_id, t, seq, CAST(trunc(t * 30) AS BIGINT) AS f FROM v_beat),
x AS (SELECT track_id, f + d AS frame, v, t, seq, o FROM w, (VALUES %s) k(d, v, o) UNION ALL SELECT track_id, 0, %s, -1, -1, -1 FROM v_track),
l AS (SELECT track_id, frame, arg_max(v, (t, seq, o)) AS v FROM x GROUP BY track_id, frame)
SELECT track_id, CAST(floor(frame / 10000000) AS BIGINT) AS part, string_agg(printf('%%d: (%%.3f)', frame, v), ', ' ORDER BY frame) AS keyframes FROM l GROUP BY 1, 2"""


@query("s10_zoom_keyframes", "WITH " + KEYFRAMES % ("(0, 1.05e0, 0), (5, 1e0, 1)", "1e0"))
def _(v):
    return documents.keyframes(v.beat, v.track)


@query("s10_shake_keyframes", "WITH " + KEYFRAMES % ("(0, 10e0, 0), (2, -10e0, 1), (4, 0e0, 2)", "0e0"))
def _(v):
    return documents.keyframes(v.beat, v.track, documents.SHAKE, rest=0.0)


@query("s09_blueprint_round_trip", """
SELECT clip_id AS list_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_t, track_id, end_t) - 1 AS seq, CAST(track_id AS VARCHAR) AS clip_id, start_t, end_t, CASE WHEN end_t - start_t > 25 THEN 'long' ELSE 'short' END AS kind FROM v_usage""")
def _(v):
    rows = row_index(v.usage, ["clip_id"], ["start_t", "track_id", "end_t"], "seq", 365.0)
    kind = F.when(F.col("end_t") - F.col("start_t") > 25, "long").otherwise("short")
    cuts = rows.select(F.col("clip_id").alias("list_id"), "seq", F.col("track_id").alias("clip_id"), "start_t", "end_t", F.create_map(F.lit("kind"), kind).alias("metadata"))
    out = documents.from_blueprints(documents.to_blueprints(cuts, F.lit("edit"), ["list_id"]), ["list_id"])
    return out.select("list_id", "seq", "clip_id", "start_t", "end_t", F.col("metadata")["kind"].alias("kind"))


@query("s09_curve_round_trip", "SELECT track_id, t, energy * 2 - 1 AS valence, energy AS arousal FROM v_energy")
def _(v):
    points = v.energy.select("track_id", "t", (F.col("energy") * 2 - 1).alias("valence"), F.col("energy").alias("arousal"))
    return documents.from_curve_documents(documents.to_curve_documents(points)).select("track_id", "t", "valence", "arousal")


def _attr(name, col):
    safe = F.replace(F.replace(F.replace(col.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit(f' {name}="'), safe, F.lit('"'))


def library_xml(v):
    """Writes a DJ library derived from the part table."""
    path = scratch_path(v.spark, "djlibrary")
    p, k = v.table("part"), F.col("p_partkey")
    head = F.concat(F.lit("<TRACK"), _attr("TrackID", k), _attr("Name", F.col("p_name")), _attr("Artist", F.col("p_brand")),
                    F.lit(' Location="file://localhost/music/'), F.url_encode("p_type"), F.lit("/"), k.cast("string"), F.lit('.mp3"'), _attr("TotalTime", F.col("p_size") * 10),
                    F.when(k % 5 != 0, _attr("AverageBpm", 60 + k % 120)).otherwise(F.lit("")), F.lit(">"))
    tempo = F.when(k % 3 != 0, F.concat(F.lit("<TEMPO"), _attr("Inizio", (k % 100) / 100), F.lit("/>"))).otherwise(F.lit(""))
    cue = F.concat(F.lit('<POSITION_MARK Name="in"'), _attr("Start", k % 50), _attr("Num", F.lit(0)), F.lit('/><POSITION_MARK Name="drop"'), _attr("Start", 50 + k % 50), F.lit("/>"))
    track = F.concat(head, tempo, F.when(k % 2 == 0, cue).otherwise(F.lit("")), F.lit("</TRACK>"))
    node = F.concat(F.lit('<NODE Type="0" Name="'), F.col("p_brand"), F.lit('"><NODE Type="1"'), _attr("Name", F.concat_ws(" ", "p_brand", k.cast("string"))),
                    F.lit("><TRACK"), _attr("Key", k), F.lit("/><TRACK"), _attr("Key", k + 1), F.lit("/></NODE></NODE>"))
    for part, row, opening, closing in (("collection", track, "<COLLECTION>", "</COLLECTION>"), ("playlists", node, "<PLAYLISTS>", "</PLAYLISTS>")):
        # one well-formed document per thousand parts
        docs = p.select(F.floor(k / 1000).alias("doc"), row.alias("row")).groupBy("doc").agg(F.array_join(F.collect_list("row"), "").alias("rows"))
        text = F.concat(F.lit(f"<DJ_PLAYLISTS>{opening}"), F.col("rows"), F.lit(f"{closing}</DJ_PLAYLISTS>"))
        docs.select("doc", text.alias("value")).repartition("doc").write.partitionBy("doc").text(f"{path}/{part}")
    return path


@query("s07_dj_library_tracks", """
SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_name AS name, p_brand AS artist, concat('music/', p_type, '/', CAST(p_partkey AS VARCHAR), '.mp3') AS file_path,
  CASE WHEN p_partkey % 5 <> 0 THEN 60e0 + p_partkey % 120 ELSE 120e0 END AS bpm, CAST(p_size AS BIGINT) * 10000 AS duration_ms, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 100 / 100e0 ELSE 0e0 END AS beatgrid_offset FROM part""")
def _(v):
    tracks, _ = documents.read_dj_tracks(v.spark, f"{library_xml(v)}/collection")
    return tracks.drop("key")


@query("s07_dj_library_cues", """
SELECT CAST(p_partkey AS VARCHAR) AS track_id, 0 AS position, 'in' AS name, '0' AS type, CAST(p_partkey % 50 AS DOUBLE) AS start, 0 AS num FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'drop', '0', 50e0 + p_partkey % 50, -1 FROM part WHERE p_partkey % 2 = 0""")
def _(v):
    _, cues = documents.read_dj_tracks(v.spark, f"{library_xml(v)}/collection")
    return cues


@query("s07_dj_library_playlists", """
SELECT concat(p_brand, ' ', CAST(p_partkey AS VARCHAR)) AS playlist, k AS position, CAST(p_partkey + k AS VARCHAR) AS track_id FROM part, (VALUES (0), (1)) x(k)""")
def _(v):
    return documents.read_dj_playlists(v.spark, f"{library_xml(v)}/playlists")


@query("s11_new_media_in_folder")
def _(v):
    # a folder of text files derived from the documents; the catalog knows none of their contents
    path = scratch_path(v.spark, "media")
    v.table("documents").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value"), "source", "lang").repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    found = documents.scan_new_media(v.spark, path, v.asset, [".txt"])
    return found.select(F.regexp_extract("file_path", r"source=([^/]*)", 1).alias("source"), F.regexp_extract("file_path", r"lang=([^/]*)", 1).alias("lang"), "size_bytes")
