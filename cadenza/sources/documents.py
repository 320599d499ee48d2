"""Cut lists and curves as JSON documents, keyframe strings, DJ-library XML, media folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.catalog import VIDEO_EXTENSIONS, new_content
from cadenza.operators.intervals import MAX_CUTS
from cadenza.operators.vectorops import fingerprint

CUT = "struct<seq:bigint,clip_id:string,start_t:double,end_t:double,metadata:map<string,string>>"
POINT = "struct<t:double,valence:double,arousal:double,segment_type:string,confidence:double>"


def to_blueprints(cuts: DataFrame, name: Column, keys: Sequence[str] = ("track_id",), per_document: int = MAX_CUTS) -> DataFrame:
    """(keys, part, document): the cuts of a list as JSON, at most `per_document` cuts each.

    `seq` numbers the cuts of a list from 0; longer lists continue in further parts.
    """
    part = F.floor(F.col("seq") / per_document).alias("part")
    entry = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("clip_id").cast("string").alias("clip_id"), "start_t", "end_t",
                     (F.col("metadata") if "metadata" in cuts.columns else F.lit(None).cast("map<string,string>")).alias("metadata"))
    lists = cuts.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("_s"), F.to_json(entry).alias("j")))).alias("_c"),
                                          F.max("end_t").alias("total_duration"))
    body = F.array_join(F.transform("_c", lambda c: c["j"]), ",")
    head = F.to_json(F.struct(name.alias("name"), "total_duration"))
    document = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"cuts":['), body, F.lit("]}"))
    return lists.withColumn("h", head).select(*keys, "part", document.alias("document"))


def from_blueprints(documents: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Cuts of the documents; documents that do not parse give no rows."""
    parsed = F.from_json("document", f"struct<name:string,total_duration:double,cuts:array<{CUT}>>")
    return documents.select(*keys, parsed.alias("d")).select(*keys, F.col("d.name").alias("name"), F.inline("d.cuts"))


def to_curve_documents(points: DataFrame, keys: Sequence[str] = ("track_id",), part_seconds: float = 86_400.0) -> DataFrame:
    """(keys, part, document) of emotion curves, one document per stretch of time."""
    cols = [F.col(c) if c in points.columns else F.lit(None).cast(t).alias(c) for c, t in
            (("t", "double"), ("valence", "double"), ("arousal", "double"), ("segment_type", "string"), ("confidence", "double"))]
    rows = points.select(*keys, F.floor(F.col("t") / part_seconds).alias("part"), F.struct(*cols).alias("p"))
    lists = rows.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("p")).alias("points"))
    return lists.select(*keys, "part", F.to_json(F.struct("points")).alias("document"))


def from_curve_documents(documents: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    return documents.select(*keys, F.from_json("document", f"struct<points:array<{POINT}>>").alias("d")).select(*keys, F.inline("d.points"))


# fixed values: keyframes of one beat as (frames after it, value per intensity, constant part)
ZOOM = [(0, 0.05, 1.0), (5, 0.0, 1.0)]
SHAKE = [(0, 10.0, 0.0), (2, -10.0, 0.0), (4, 0.0, 0.0)]


def keyframes(beats: DataFrame, tracks: DataFrame, shape: Sequence[tuple[int, float, float]] = ZOOM, intensity: float = 1.0, fps: int = 30,
              rest: float = 1.0, part_frames: int = 10_000_000) -> DataFrame:
    """(track_id, part, keyframes): `frame: (value)` texts; a later beat overwrites a frame.

    Long tracks are cut into parts of `part_frames` frames.
    """
    frame = (F.col("t") * fps).cast("bigint")
    writes = F.array(*[F.struct((frame + shift).alias("frame"), F.lit(base + gain * intensity).alias("value"), F.lit(i).alias("w"))
                       for i, (shift, gain, base) in enumerate(shape)])
    rows = beats.select("track_id", F.col("t").alias("_t"), F.col("seq").alias("_q"), F.inline(writes))
    start = tracks.select("track_id", F.lit(-1.0).alias("_t"), F.lit(-1).cast("bigint").alias("_q"), F.lit(0).cast("bigint").alias("frame"),
                          F.lit(rest).alias("value"), F.lit(-1).alias("w"))
    last = rows.unionByName(start).groupBy("track_id", "frame").agg(F.max_by("value", F.struct("_t", "_q", "w")).alias("value"))
    text = F.format_string("%d: (%.3f)", "frame", "value")
    parts = last.groupBy("track_id", F.floor(F.col("frame") / part_frames).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("frame", text.alias("s")))).alias("_k"))
    return parts.select("track_id", "part", F.array_join(F.transform("_k", lambda k: k["s"]), ", ").alias("keyframes"))


_ATTR = T.StringType()
TRACK_SCHEMA = T.StructType([
    *[T.StructField(f"_{n}", _ATTR) for n in ("TrackID", "Name", "Artist", "Location", "AverageBpm", "Tonality", "TotalTime")],
    T.StructField("TEMPO", T.ArrayType(T.StructType([T.StructField("_Inizio", _ATTR), T.StructField("_Bpm", _ATTR)]))),
    T.StructField("POSITION_MARK", T.ArrayType(T.StructType([T.StructField(f"_{n}", _ATTR) for n in ("Name", "Type", "Start", "Num")]))),
])
_KEYS = T.StructField("TRACK", T.ArrayType(T.StructType([T.StructField("_Key", _ATTR)])))


def _node(depth: int) -> T.StructType:
    fields = [T.StructField("_Type", _ATTR), T.StructField("_Name", _ATTR), _KEYS]
    if depth:
        fields.append(T.StructField("NODE", T.ArrayType(_node(depth - 1))))
    return T.StructType(fields)


def read_dj_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, cue points) of DJ-library XML files."""
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(TRACK_SCHEMA).load(path).filter(F.col("_TrackID").isNotNull())
    number = F.coalesce(F.col("_AverageBpm").try_cast("double"), F.lit(120.0))
    tracks = raw.select(
        F.col("_TrackID").alias("track_id"), F.coalesce("_Name", F.lit("Unknown")).alias("name"), F.coalesce("_Artist", F.lit("Unknown")).alias("artist"),
        F.try_url_decode(F.replace(F.replace(F.coalesce("_Location", F.lit("")), F.lit("file://localhost/"), F.lit("")), F.lit("+"), F.lit("%2B"))).alias("file_path"),
        number.alias("bpm"), F.col("_Tonality").alias("key"), (F.coalesce(F.col("_TotalTime").try_cast("double"), F.lit(0.0)) * 1000).cast("bigint").alias("duration_ms"),
        F.coalesce(F.get("TEMPO", F.lit(0))["_Inizio"].try_cast("double"), F.lit(0.0)).alias("beatgrid_offset"))
    cues = raw.select(F.col("_TrackID").alias("track_id"), F.posexplode("POSITION_MARK").alias("position", "c")).select(
        "track_id", "position", F.coalesce("c._Name", F.lit("")).alias("name"), F.coalesce("c._Type", F.lit("0")).alias("type"),
        F.coalesce(F.col("c._Start").try_cast("double"), F.lit(0.0)).alias("start"), F.coalesce(F.col("c._Num").try_cast("int"), F.lit(-1)).alias("num"))
    return tracks, cues


def _nesting(schema: T.StructType) -> int:
    """How many nodes lie inside a node of an inferred schema, at most."""
    inner = [f.dataType for f in schema.fields if f.name == "NODE"]
    node = inner[0].elementType if inner and isinstance(inner[0], T.ArrayType) else inner[0] if inner else None
    return 1 + _nesting(node) if isinstance(node, T.StructType) else 0


def read_dj_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(playlist, position, track_id) of DJ-library XML files, whatever the depth of their folders."""
    depth = _nesting(spark.read.format("xml").option("rowTag", "NODE").load(path).schema)
    level = spark.read.format("xml").option("rowTag", "NODE").schema(_node(depth)).load(path)
    out = None
    for i in range(depth + 1):
        here = level.filter(F.col("_Type") == "1").select(F.coalesce("_Name", F.lit("Unknown Playlist")).alias("playlist"), F.posexplode("TRACK").alias("position", "k"))
        here = here.select("playlist", "position", F.col("k._Key").alias("track_id")).filter(F.col("track_id").isNotNull() & (F.col("track_id") != ""))
        out = here if out is None else out.unionByName(here)
        if i < depth:
            level = level.select(F.explode("NODE").alias("n")).select("n.*")
    return out


def dj_tracks_as_audio(tracks: DataFrame, project_id: Column) -> DataFrame:
    """Imported tracks as catalog rows."""
    return tracks.select(project_id.alias("project_id"), F.concat_ws(" - ", "artist", "name").alias("name"), "file_path", "bpm",
                         (F.col("duration_ms") / 1000.0).alias("duration"), F.lit(True).alias("is_analyzed"))


def list_media(spark: SparkSession, folder: str, extensions: Sequence[str] = tuple(VIDEO_EXTENSIONS), recursive: bool = True,
               with_fingerprint: bool = False) -> DataFrame:
    """(file_path, size_bytes, modified_at[, content_fingerprint]) of media files; endings ignore case.

    File contents are read only when the fingerprint is wanted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    wanted = files.filter(ending.isin([e.lower() for e in extensions]))
    cols = [F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    if with_fingerprint:
        cols.append(fingerprint(F.col("content")).alias("content_fingerprint"))
    return wanted.select(*cols)


def scan_new_media(spark: SparkSession, folder: str, catalog: DataFrame, extensions: Sequence[str] = tuple(VIDEO_EXTENSIONS),
                   recursive: bool = True) -> DataFrame:
    """Media files whose content is not in the catalog."""
    return new_content(list_media(spark, folder, extensions, recursive, with_fingerprint=True), catalog)
