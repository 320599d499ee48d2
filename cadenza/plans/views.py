"""Fixture views over the given tables, as one SELECT per view and engine.

`{US}`, `{SHA}`, `{DAYS}`, `{BITS}` and `{SEGMENTS}` stand for the few
expressions that the two engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SPARK_WORDS = {
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "SHA": "substring(sha2(text, 256), 1, 16)",
    "DAYS": "CAST(datediff(CAST(l_shipdate AS DATE), DATE'1992-01-01') AS DOUBLE)",
    "BITS": "array_join(transform(embedding, x -> CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')",
    "SEGMENTS": "v_track t LATERAL VIEW explode(sequence(CAST(0 AS BIGINT), CAST(5 AS BIGINT))) s AS k",
}
DUCK_WORDS = {
    "US": "epoch_us(ts)",
    "SHA": "substring(sha256(text), 1, 16)",
    "DAYS": "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE)",
    "BITS": "array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')",
    "SEGMENTS": "v_track t CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT 5) s",
}

VIEWS = {
    "v_trigger": """
SELECT user_id AS track_id, event_id AS seq, {US}/1e6 - 1704067200e0 AS t,
       CASE event_type WHEN 'click' THEN 'beat' WHEN 'view' THEN 'onset' WHEN 'purchase' THEN 'kick'
            WHEN 'signup' THEN 'snare' ELSE 'hihat' END AS trigger_type,
       least(value/100e0, 1e0) AS base_strength
FROM events""",
    "v_track": """
SELECT track_id, 60e0 + track_id % 120 AS bpm, 2592000e0 AS duration, CAST(count(*) AS BIGINT) AS n_triggers
FROM v_trigger GROUP BY track_id""",
    "v_beat": "SELECT track_id, seq, t, base_strength AS strength FROM v_trigger WHERE trigger_type = 'beat'",
    "v_motion_peak": "SELECT track_id, seq, t, base_strength AS strength FROM v_trigger WHERE trigger_type = 'onset'",
    "v_energy": """
SELECT track_id, floor(t/43200e0)*43200e0 AS t, round(avg(base_strength), 6) AS energy
FROM v_trigger GROUP BY track_id, floor(t/43200e0)*43200e0""",
    "v_segment": """
SELECT track_id, k AS seg_idx, k*432000e0 AS start_t, (k+1)*432000e0 AS end_t,
       CASE k WHEN 0 THEN 'intro' WHEN 1 THEN 'verse' WHEN 2 THEN 'chorus' WHEN 3 THEN 'bridge'
            WHEN 4 THEN 'drop' ELSE 'outro' END AS segment_type,
       (track_id*7 + k*13) % 10 / 10e0 AS energy
FROM {SEGMENTS}""",
    "v_clip": """
SELECT p_partkey AS clip_id, p_partkey % 10 AS project_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS name,
       concat('/lib/', p_brand, '/', CAST(p_partkey AS VARCHAR(20)), '.mp4') AS file_path,
       CAST(p_size AS DOUBLE) AS duration, p_partkey % 11 <> 0 AS is_available, p_partkey % 7 = 0 AS needs_reanalysis,
       640 + 320*(p_partkey % 11) AS width, 360 + 180*(p_partkey % 11) AS height,
       CASE p_partkey % 4 WHEN 0 THEN 24e0 WHEN 1 THEN 30e0 WHEN 2 THEN 60e0 ELSE 25e0 END AS fps,
       CASE WHEN p_partkey % 3 = 0 THEN 'h264' ELSE 'mjpg' END AS codec
FROM part""",
    "v_clip_motion": """
SELECT clip_id, (clip_id*53 % 101)/100e0 AS motion_score,
       CASE WHEN clip_id*53 % 101 < 20 THEN 'STATIC' WHEN clip_id*53 % 101 < 40 THEN 'SLOW'
            WHEN clip_id*53 % 101 < 60 THEN 'MEDIUM' WHEN clip_id*53 % 101 < 80 THEN 'FAST' ELSE 'EXTREME' END AS motion_type,
       CASE clip_id % 3 WHEN 0 THEN 'STATIC_CAM' WHEN 1 THEN 'PAN_LEFT' ELSE 'TILT_UP' END AS camera_motion,
       (clip_id*29 % 101)/100e0 AS camera_magnitude
FROM v_clip WHERE clip_id % 13 <> 0""",
    "v_clip_mood": """
SELECT clip_id,
       concat('["', CASE clip_id % 4 WHEN 0 THEN 'CALM' WHEN 1 THEN 'ENERGETIC' WHEN 2 THEN 'DARK' ELSE 'CHEERFUL' END,
              '","', CASE clip_id % 3 WHEN 0 THEN 'PEACEFUL' WHEN 1 THEN 'EUPHORIC' ELSE 'MYSTERIOUS' END, '"]') AS moods,
       (clip_id*71 % 101)/100e0 AS energy, CAST(clip_id*37 % 256 AS DOUBLE) AS brightness,
       (clip_id*17 % 101)/100e0 AS saturation, (clip_id*43 % 101)/100e0 AS contrast,
       (clip_id*31 % 61)/100e0 AS warm_ratio, (clip_id*23 % 61)/100e0 AS cool_ratio
FROM v_clip WHERE clip_id % 17 <> 0""",
    "v_clip_style": """
SELECT clip_id, clip_id*97 % 3000 AS unique_colors, (clip_id*19 % 101)/100e0 AS noise_level,
       CAST(clip_id*211 % 2200 AS DOUBLE) AS sharpness, (clip_id*3 % 21)/100e0 AS vignette_score,
       (clip_id*17 % 101)/100e0 AS saturation_mean, (clip_id*61 % 101)/100e0 AS dynamic_range,
       CAST(clip_id*37 % 256 AS DOUBLE) AS mean_brightness
FROM v_clip""",
    "v_status": """
SELECT doc_id AS clip_id, quality = 1 AS colors_analyzed, toxic = 1 AS motion_analyzed, doc_id % 2 = 0 AS scene_analyzed,
       doc_id % 3 = 0 AS mood_analyzed, doc_id % 5 <> 0 AS objects_analyzed, doc_id % 7 <> 0 AS style_analyzed,
       TRUE AS fingerprint_created, doc_id % 11 <> 0 AS vector_extracted,
       CAST(doc_id % 2 AS INT) AS colors_version, CAST(doc_id % 3 AS INT) AS motion_version
FROM labels""",
    "v_asset": """
SELECT doc_id AS clip_id, concat('/', source, '/', lang, '/', CAST(doc_id AS VARCHAR(20))) AS file_path,
       {SHA} AS content_fingerprint, doc_id % 9 <> 0 AS is_available, doc_id % 4 = 0 AS needs_reanalysis
FROM documents""",
    "v_usage": """
SELECT l_partkey AS clip_id, l_orderkey AS track_id, {DAYS} AS start_t, {DAYS} + l_quantity AS end_t
FROM lineitem""",
    "v_frame_label": """
SELECT l_partkey AS clip_id, concat(l_returnflag, l_linestatus) AS label, l_discount*10e0 AS score
FROM lineitem""",
    "v_frame": """
SELECT user_id AS clip_id, event_id AS frame_idx, least(value, 255e0) AS brightness,
       CAST(event_id*47 % 360 AS DOUBLE) AS hue, least(value/20e0, 15e0) AS magnitude
FROM events""",
    "v_vec": "SELECT vec_id, label, embedding FROM embeddings",
    "v_query_vec": "SELECT vec_id AS query_id, embedding FROM embeddings",
    "v_phash": "SELECT vec_id AS clip_id, {BITS} AS bits FROM embeddings",
    "v_tag": "SELECT doc_id AS clip_id, source AS tag FROM documents UNION SELECT doc_id, lang FROM documents",
}


def _render(name: str, words: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: words[m.group(1)], VIEWS[name]).strip()


def _needed(text: str, words: dict[str, str]) -> list[str]:
    """Views that `text` uses, each after the views it builds on."""
    order: list[str] = []

    def visit(fragment: str) -> None:
        for name in re.findall(r"\bv_\w+", fragment):
            if name in VIEWS and name not in order:
                visit(_render(name, words))
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def duckdb_views(text: str) -> list[str]:
    return [f"{n} AS ({_render(n, DUCK_WORDS)})" for n in _needed(text, DUCK_WORDS)]


class Views:
    """Spark DataFrames of the tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = _needed(text, SPARK_WORDS)
        parts = [f"{n} AS ({_render(n, SPARK_WORDS)})" for n in names]
        used = set(re.findall(r"\b\w+\b", " ".join([*parts, text])))
        for table in TABLES:
            if table in used:
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(f"WITH {', '.join(parts)} {text}" if parts else text)

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM v_{name}")
