"""Catalog, state, labels, documents and streams on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import catalog, cutlist, labels, matching, rules, state, triggers
from cadenza.sources import documents
from cadenza.streaming import live


def test_bad_json_becomes_empty(spark):
    df = spark.createDataFrame([("[\"a\",\"b\"]",), ("[oops",), (None,), ("",)], "j string")
    assert [r.x for r in df.select(catalog.json_list(F.col("j")).alias("x")).collect()] == [["a", "b"], [], [], []]


@pytest.fixture()
def library(spark):
    clips = spark.createDataFrame([(1, "Rain", 4.0), (2, "Sun", None), (3, "rainbow", 9.0)], "clip_id long, name string, duration double")
    motion = spark.createDataFrame([(1, "FAST", 0.7), (3, "SLOW", 0.2)], "clip_id long, motion_type string, motion_score double")
    mood = spark.createDataFrame([(1, ["CALM"], 0.3), (2, [], 0.9)], "clip_id long, moods array<string>, energy double")
    return catalog.with_families(clips, {"motion": motion, "mood": mood})


def test_filters_treat_missing_families_as_no_match(library):
    def ids(p):
        return {r.clip_id for r in library.filter(p).collect()}

    assert ids(catalog.clip_filter({"motion_type": "FAST"})) == {1}
    assert ids(catalog.clip_filter({"mood": ["CALM"], "duration_range": (None, 5)})) == {1}
    assert ids(catalog.clip_filter({"duration_range": (5, None)})) == {3}
    assert ids(catalog.clip_filter({})) == {1, 2, 3}
    assert ids(catalog.facet_filter({"motion_type": "All", "mood": "CALM"})) == {1}
    assert ids(catalog.name_search("RAIN")) == {1, 3}
    with pytest.raises(ValueError):
        catalog.clip_filter({"colour": 1})


def test_library_order_and_page_limit(library):
    rows = library.orderBy(*catalog.library_order("motion")).collect()
    assert [r.clip_id for r in rows] == [1, 3, 2]
    assert [r.clip_id for r in library.orderBy(*catalog.library_order("name")).collect()] == [1, 3, 2]
    assert catalog.page(library.sparkSession.range(3000), ["id"], 5000).count() == 3000


def test_latest_row_per_clip(spark):
    df = spark.createDataFrame([(1, 10, "old"), (1, 20, "new"), (2, 5, "x")], "clip_id long, analyzed_at long, v string")
    assert {(r.clip_id, r.v) for r in catalog.latest_per_clip(df).collect()} == {(1, "new"), (2, "x")}


def test_relocation_prefers_the_original_folder(spark):
    clips = spark.createDataFrame([(1, "/a/x.mp4", "F1"), (2, "/a/y.mp4", "F2"), (3, "/b/z.mp4", "F3"), (4, "/b/n.mp4", None)],
                                  "clip_id long, file_path string, content_fingerprint string")
    files = spark.createDataFrame([("/a/x.mp4", "F1"), ("/new/y.mp4", "F2"), ("/a/y2.mp4", "F2"), ("/z/q.mp4", "F9")], "file_path string, content_fingerprint string")
    got = {r.clip_id: (r.new_path, r.status) for r in catalog.relocate(clips, files, ["/new"]).collect()}
    assert got == {1: ("/a/x.mp4", "present"), 2: ("/a/y2.mp4", "relocated"), 3: (None, "missing"), 4: (None, "missing")}


def test_eviction_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", 1, 60), ("b", 2, 50), ("c", 3, 40)], "path string, modified long, size_bytes long")
    assert {r.path for r in catalog.over_budget(df, 100, width=1.5).collect()} == {"a"}
    assert catalog.over_budget(df, 150).count() == 0


def test_status_flow(spark):
    status = spark.createDataFrame([(1, True, True, 0)], "clip_id long, colors_analyzed boolean, motion_analyzed boolean, colors_version int")
    events = spark.createDataFrame([(1, "colors", False, 1), (1, "colors", True, 2), (2, "motion", True, 1), (2, "bogus", True, 1)],
                                   "clip_id long, analysis string, success boolean, happened long")
    got = {r.clip_id: r for r in state.apply_status_events(status, events).collect()}
    assert got[1].colors_analyzed and got[1].colors_version == 1 and got[2].motion_analyzed and not got[2].colors_analyzed
    assert got[2].colors_version == 0
    missing = state.apply_status_events(status, events).filter("clip_id = 2").select(state.missing_analyses().alias("m")).first().m
    assert "motion" not in missing and "vector" in missing


def test_usage_halving_equals_the_fold(spark):
    batch = spark.createDataFrame([(1, 8.0, 1), (1, 4.0, 2), (1, 2.0, 3), (2, 5.0, 1)], "clip_id long, duration double, used_at long")
    fresh = {r.clip_id: r.avg_duration for r in state.merge_usage(None, batch, ["used_at"], True, 1.5).collect()}
    assert fresh == {1: ((8 + 4) / 2 + 2) / 2, 2: 5.0}
    old = spark.createDataFrame([(1, 3, 16.0, 0), (9, 1, 2.0, 0)], "clip_id long, usage_count long, avg_duration double, last_used long")
    merged = {r.clip_id: (r.usage_count, r.avg_duration) for r in state.merge_usage(old, batch, ["used_at"], True).collect()}
    assert merged == {1: (6, (((16 + 8) / 2 + 4) / 2 + 2) / 2), 2: (1, 5.0), 9: (1, 2.0)}


def test_mood_labels_fall_back_on_energy(spark):
    df = spark.createDataFrame([(1, 128.0, 0.5, 0.9, 0.55, 0.1, 0.1)], "clip_id long, brightness double, saturation double, contrast double, energy double, warm_ratio double, cool_ratio double")
    row = labels.mood_labels(df).first()
    assert row.moods and set(row.moods) <= set(row.mood_scores)


def test_scores_of_missing_values(spark):
    df = spark.createDataFrame([("CALM", None, ["CALM"], None), ("NOPE", 0.5, ["CALM"], 0.5), ("CALM", 0.5, None, 0.5)],
                               "mood string, e double, moods array<string>, ce double")
    got = [round(r.s, 3) for r in df.select(matching.mood_score(F.col("mood"), F.col("e"), F.col("moods"), F.col("ce")).alias("s")).collect()]
    assert got == [0.5, 0.3, 0.3]


def test_keyframe_strings(spark):
    beats = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.1)], "track_id long, seq long, t double")
    tracks = spark.createDataFrame([(1,), (2,)], "track_id long")
    got = {r.track_id: r.keyframes for r in documents.keyframes(beats, tracks).collect()}
    assert got == {1: "0: (1.000), 30: (1.050), 33: (1.050), 35: (1.000), 38: (1.000)", 2: "0: (1.000)"}


XML = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION Entries="2">
<TRACK TrackID="7" Name="One" Artist="A&amp;B" Location="file://localhost/C:/my%20music/a+b.mp3" AverageBpm="128.00" TotalTime="200" Tonality="8A">
<TEMPO Inizio="0.125" Bpm="128.00"/><POSITION_MARK Name="in" Type="0" Start="1.5" Num="0"/><POSITION_MARK Name="" Type="0" Start="60" Num="-1"/></TRACK>
<TRACK TrackID="8" Name="Two"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="1" Name="set"><TRACK Key="7"/><TRACK Key="99"/></NODE><NODE Type="0" Name="box"><NODE Type="1" Name="deep"><TRACK Key="8"/></NODE></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""


def test_dj_library_import(spark, tmp_path):
    (tmp_path / "lib.xml").write_text(XML)
    tracks, cues = documents.read_dj_tracks(spark, str(tmp_path / "lib.xml"))
    got = {r.track_id: r for r in tracks.collect()}
    assert set(got) == {"7", "8"}
    assert got["7"].file_path == "C:/my music/a+b.mp3" and got["7"].artist == "A&B" and got["7"].duration_ms == 200_000 and got["7"].beatgrid_offset == 0.125
    assert got["8"].bpm == 120.0 and got["8"].artist == "Unknown" and got["8"].beatgrid_offset == 0.0
    assert [(r.start, r.num) for r in cues.orderBy("position").collect()] == [(1.5, 0), (60.0, -1)]
    lists = {(r.playlist, r.track_id) for r in documents.read_dj_playlists(spark, str(tmp_path / "lib.xml")).collect()}
    assert lists == {("set", "7"), ("set", "99"), ("deep", "8")}
    inner = '<NODE Type="1" Name="far"><TRACK Key="7"/></NODE>'
    for i in range(8):
        inner = f'<NODE Type="0" Name="box {i}">{inner}</NODE>'
    (tmp_path / "far.xml").write_text(f"<DJ_PLAYLISTS><PLAYLISTS>{inner}</PLAYLISTS></DJ_PLAYLISTS>")
    assert [(r.playlist, r.track_id) for r in documents.read_dj_playlists(spark, str(tmp_path / "far.xml")).collect()] == [("far", "7")]


def test_filters_join_only_their_families(spark):
    clips = spark.range(6).withColumnRenamed("id", "clip_id")
    sides = {"motion": clips.filter("clip_id < 4").withColumn("motion_type", F.lit("FAST")), "status": clips.filter("clip_id < 2").withColumn("done", F.lit(True))}
    families = {**sides, "mood": clips.withColumn("moods", F.array(F.lit("CALM")))}
    rows = catalog.filtered_families(clips, families, {"motion_type": "FAST", "mood": None, "duration_range": (1, 2)})
    assert rows.columns == ["clip_id", "motion"] and rows.count() == 4
    assert catalog.filtered_families(clips, families, {"is_analyzed": False}).count() == 6
    assert catalog.filtered_families(clips, families, {"is_analyzed": True}).count() == 2


def test_blueprint_parts(spark):
    cuts = spark.createDataFrame([(1, i, f"c{i}", float(i), i + 1.0) for i in range(7)], "track_id long, seq long, clip_id string, start_t double, end_t double")
    docs = documents.to_blueprints(cuts, F.lit("edit"), per_document=3)
    assert docs.count() == 3
    back = documents.from_blueprints(docs).orderBy("seq").collect()
    assert [(r.seq, r.clip_id, r.end_t, r.name) for r in back] == [(i, f"c{i}", i + 1.0, "edit") for i in range(7)]


def test_media_listing_ignores_case_and_other_files(spark, tmp_path):
    for name in ("a.MP4", "b.txt", "sub/c.mkv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = documents.list_media(spark, str(tmp_path), with_fingerprint=True)
    assert {r.file_path.rsplit("/", 1)[1] for r in found.collect()} == {"a.MP4", "c.mkv"}
    known = found.filter("file_path LIKE '%a.MP4'").select("content_fingerprint")
    assert [r.file_path.rsplit("/", 1)[1] for r in documents.scan_new_media(spark, str(tmp_path), known).collect()] == ["c.mkv"]


def test_rule_conditions(spark):
    grid = spark.createDataFrame([(0.0, 0.9, 120.0, 0.0), (0.5, 0.9, 120.0, 0.0), (2.04, 0.1, 120.0, 0.0), (2.2, None, None, 0.0)],
                                 "t double, energy double, bpm double, offset double")
    rows = rules.evaluate_rules(grid, list(rules.PRESETS.values())).collect()
    assert [r.rule for r in rows] == ["Beat Synchronization", "Energy Following", "Beat Synchronization", "Variety Enforcement"]
    assert grid.filter(rules.Combined("and").column()).count() == 4
    assert grid.filter(rules.Combined("not", (rules.TimeIn(0.0, 1.0),)).column()).count() == 2


def test_throttled_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [(k, i * 10 + k, 1_704_067_200 + round(t, 2)) for k in range(4) for i, t in enumerate(sorted(rng.random() * 300 for _ in range(60)))]
    frame = spark.createDataFrame([(k, q, float(s), rng.random()) for k, q, s in rows], "track_id long, seq long, s double, strength double")
    frame = frame.select("track_id", "seq", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"), (F.col("s") - 1_704_067_200).alias("t"),
                         F.lit(0).alias("rank"), F.lit("beat").alias("trigger_type"), "strength")
    for part in range(4):
        frame.filter((F.col("t") >= part * 75) & (F.col("t") < part * 75 + 75)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # the parts arrive in time order; what the last watermark cannot close stays open
    got = {(r.track_id, r.seq) for r in live.run_to_end(live.throttle(stream, 5.0), str(tmp_path / "out")).collect()}
    top = frame.agg(F.max("t")).first()[0]
    batch = triggers.suppress_close(frame.drop("ts", "rank"), 5.0).filter(F.col("t") + 5.0 <= top - 0.002)
    want = {(r.track_id, r.seq) for r in batch.collect()}
    assert len(want) > 50 and got == want


def test_late_usage_batches_are_merged(spark, tmp_path):
    schema = "clip_id long, duration double, used_at timestamp"
    write = live.usage_writer(spark, str(tmp_path / "stats"))
    when = F.lit("2024-01-01").cast("timestamp")
    write(spark.createDataFrame([(1, 2.0)], "clip_id long, duration double").withColumn("used_at", when), 0)
    second = spark.createDataFrame([(1, 4.0), (2, 1.0)], "clip_id long, duration double").withColumn("used_at", when)
    write(second, 1)
    write(second, 1)  # a repeated batch changes nothing
    got = {r.clip_id: (r.usage_count, r.avg_duration) for r in live.read_usage(spark, str(tmp_path / "stats")).collect()}
    assert got == {1: (2, 3.0), 2: (1, 1.0)} and schema


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "stats"), "clip_id long, duration double"
    write = live.usage_writer(spark, path, buckets=16)
    when = F.lit("2024-01-01").cast("timestamp")
    batch = lambda ids: spark.createDataFrame([(i, 2.0) for i in ids], schema).withColumn("used_at", when)
    write(batch(range(400)), 0)
    assert len(list((tmp_path / "stats/data/v=1").glob("bucket=*"))) == 16
    for n in range(1, 6):
        write(batch([7]), n)
        assert len(list((tmp_path / f"stats/data/v={n + 1}").glob("bucket=*"))) == 1
    write(batch([7]), 5)  # repeated
    write(batch([]), 6)
    held = {p.parent.name + "/" + p.name for p in (tmp_path / "stats/data").glob("v=*/bucket=*")}
    assert len(held) == 16 and sum(h.startswith("v=1/") for h in held) == 15 and len(list((tmp_path / "stats/manifest").glob("v=*"))) == 2
    got = {r.clip_id: r.usage_count for r in live.read_usage(spark, path).collect()}
    assert got == {i: 6 if i == 7 else 1 for i in range(400)}


def test_beat_alignment_ends_with_the_clips(spark):
    beats = spark.createDataFrame([(k, i, i * 3.0) for k in (1, 2) for i in range(30)], "track_id long, seq long, t double")
    clips = spark.createDataFrame([(1, i, 50 + i, i / 10) for i in range(25)] + [(2, 0, 7, 0.5)], "track_id long, clip_index long, clip_id long, start_offset double")
    for width in (None, 20.0):
        every = cutlist.align_to_beats(beats, ["track_id"], width=width).groupBy("track_id").count().collect()
        assert {r["track_id"]: r["count"] for r in every} == {1: 30, 2: 30}
        out = cutlist.align_to_beats(beats, ["track_id"], clips, width=width).orderBy("track_id", "clip_index").collect()
        assert [(r.track_id, r.clip_id, r.start_t, r.start_offset) for r in out] == [(1, 50 + i, i * 3.0, i / 10) for i in range(25)] + [(2, 7, 0.0, 0.5)]


def test_best_clip_avoids_the_last_five(spark):
    clips = spark.createDataFrame([(i, 5.0) for i in range(12)], "clip_id long, duration double")
    motion = spark.createDataFrame([(i, 0.5 + i / 100, "MEDIUM", "PAN_LEFT") for i in range(12)], "clip_id long, motion_score double, motion_type string, camera_motion string")
    mood = spark.createDataFrame([(i, 0.5 + i / 100, ["CALM"]) for i in range(12)], "clip_id long, energy double, moods array<string>")
    asked = spark.createDataFrame([(k * 10 + i, k, i, 0.5, 0.5, "MEDIUM", "CALM") for k in (1, 2) for i in range(8)],
                                  "target_id long, track_id long, seg_idx long, energy double, level double, motion string, mood string")
    for pool in (2, 20):
        got = {(r.target_id // 10, r.target_id % 10): r.clip_id for r in matching.best_clip(asked, motion, mood, clips, pool).collect()}
        assert all([got[k, i] for i in range(8)] == [0, 1, 2, 3, 4, 5, 0, 1] for k in (1, 2))
    assert {r.clip_id for r in matching.best_clip(asked, motion, mood, clips, avoid_recent=0).collect()} == {0}
