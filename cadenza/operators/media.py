"""Media properties and compatibility from catalog columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WIDTH, MAX_HEIGHT, MAX_FPS = 1920, 1080, 60.0
# fixed values: codecs with hardware decoding, cost factor per device
FAST_CODECS = ["h264", "h265", "vp9", "av1"]
DEVICE_FACTOR = {"cpu": 3.0, "directml": 1.5, "cuda": 1.0}


def properties(df: DataFrame) -> DataFrame:
    """Classes, scores and estimates from width, height, fps, frame_count and codec."""
    w, h, raw = F.col("width"), F.col("height"), F.col("fps")
    variable = (raw <= 0) | (raw > 1000)
    fps = F.when(variable, 25.0).otherwise(raw)
    base = df.withColumn("is_variable_fps", variable).withColumn("fps", fps)
    fps = F.col("fps")
    scale = F.least(F.lit(float(MAX_WIDTH)) / w, F.lit(float(MAX_HEIGHT)) / h)
    too_big = (w > MAX_WIDTH) | (h > MAX_HEIGHT)

    def even(x: Column) -> Column:
        return (F.floor(x.cast("int") / 2) * 2).cast("int")

    per_frame = w * h * 3 / (1024.0 * 1024.0)
    fast = F.lower("codec").isin(FAST_CODECS)
    return base.withColumns({
        "duration": F.col("frame_count") / fps,
        "aspect_ratio": F.when(h > 0, w / h).otherwise(0.0),
        "resolution_class": F.when(w >= 3840, "4K+").when(w >= 1920, "1080p").when(w >= 1280, "720p").when(w >= 720, "480p").otherwise("low_res"),
        "fps_class": F.when(fps >= 60, "high_fps").when(fps >= 30, "standard_fps").when(fps >= 24, "cinema_fps").otherwise("low_fps"),
        "quality_score": F.least(F.least(w * h / float(MAX_WIDTH * MAX_HEIGHT), F.lit(1.0)) * 0.6 + F.least(fps / 60.0, F.lit(1.0)) * 0.4, F.lit(1.0)),
        "sample_rate": F.when(fps >= 60, 0.25).when(fps >= 30, 0.5).otherwise(1.0),
        "resize": F.when(too_big, F.struct(even(w * scale).alias("width"), even(h * scale).alias("height"))),
        "frame_mb": per_frame, "total_mb": per_frame * F.least(F.col("frame_count"), F.lit(100)), "fast_decode": F.coalesce(fast, F.lit(False))})


def compatibility(df: DataFrame, device: str = "cpu", memory_limit_mb: float = 2000.0, max_width: int = MAX_WIDTH,
                  max_height: int = MAX_HEIGHT, max_fps: float = MAX_FPS) -> DataFrame:
    """Score, time estimates and recommendations over the output of `properties`."""
    w, h, fps = F.col("width"), F.col("height"), F.col("fps")
    res = F.least(F.lit(1.0), F.lit(float(max_width)) / w, F.lit(float(max_height)) / h)
    rate = F.least(F.lit(1.0), F.lit(max_fps) / fps)
    memory = F.greatest(F.lit(0.0), 1.0 - F.col("total_mb") / 4000.0)
    score = res * 0.3 + rate * 0.2 + F.when(F.col("fast_decode"), 1.0).otherwise(0.5) * 0.25 + memory * 0.25
    frames = F.least(F.col("frame_count") * F.col("sample_rate"), F.lit(100.0))
    frame_time = w * h / float(MAX_WIDTH * MAX_HEIGHT) * 0.05 * DEVICE_FACTOR.get(device, 2.0)
    heavy = F.col("total_mb") > memory_limit_mb
    advice = F.array_compact(F.array(
        F.when(F.col("resize").isNotNull(), "resize"), F.when(fps > 60, "frame_sampling"), F.when(~F.col("fast_decode"), "codec_warning"),
        F.when(heavy, "high_memory")))
    return df.withColumns({
        "compatibility": F.least(F.lit(1.0), score), "extraction_seconds": frames * 0.01, "analysis_seconds": frames * frame_time,
        "preprocessing_seconds": F.col("frame_count") * 0.005,
        "total_seconds": frames * (frame_time + 0.01) + F.col("frame_count") * 0.005, "recommendations": advice,
        "impact": F.when(heavy, "high").otherwise("low")})
