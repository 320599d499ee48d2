"""Song structure from feature frames, and melody events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.curves import box_filter
from cadenza.operators.ordered import framed, running, Running, with_group
from cadenza.operators.peaks import find_peaks
from cadenza.operators.triggers import keep_spaced


def novelty(frames: DataFrame, keys: Sequence[str], features: Sequence[str], smooth_frames: int, window_frames: int,
            index: str = "idx", block: int = 100_000, width: float = 100_000.0) -> DataFrame:
    """(keys, index, novelty): summed change of the features between frames,
    smoothed with a short and a long box and scaled to a maximum of 1."""
    row = F.struct(*[F.col(f) for f in features])
    near = running(frames.select(*keys, index, *features), keys, [index], [Running("_prev", "last", row)], width)
    change = F.lit(0.0)
    for f in features:
        change = change + F.abs(F.col(f) - F.col("_prev")[f])
    out = near.select(*keys, index, F.coalesce(change, F.lit(0.0)).alias("novelty"))
    if smooth_frames > 1:
        out = box_filter(out, keys, index, "novelty", smooth_frames, block)
    if window_frames > 1:
        out = box_filter(out, keys, index, "novelty", window_frames, block)
    top = with_group(out, keys, F.max(F.abs("novelty")).alias("_top"))
    return top.withColumn("novelty", F.when(F.col("_top") > 0, F.col("novelty") / F.col("_top")).otherwise(F.col("novelty"))).drop("_top")


def boundaries(curve: DataFrame, keys: Sequence[str], min_frames: int, delta: float, index: str = "idx",
               block: int = 100_000, width: float | None = None) -> DataFrame:
    """(keys, index) of segment borders: novelty peaks plus both ends.

    A peak is the greatest within `min_frames` and exceeds the local mean by
    `delta`. Without one, the greatest interior frame is taken.
    """
    around = {
        "_max": lambda w: F.max("novelty").over(w.rowsBetween(-min_frames, min_frames - 1)),
        "_mean": lambda w: F.avg("novelty").over(w.rowsBetween(-min_frames, min_frames - 1)),
    }
    seen = framed(curve, keys, index, min_frames, around, block)
    hits = seen.filter((F.col("novelty") == F.col("_max")) & (F.col("novelty") >= F.col("_mean") + delta))
    peaks = keep_spaced(hits.select(*keys, index), float(min_frames), (index,), width, tuple(keys), strict=True)
    ends = curve.groupBy(*keys).agg(
        F.max(index).alias("_last"), F.max_by(index, F.struct(F.col("novelty"), -F.col(index))).alias("_top"))
    counted = ends.join(peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys), "left")
    interior = (F.col("_top") > 0) & (F.col("_top") < F.col("_last")) & F.col("_n").isNull()
    fixed = counted.select(*keys, F.explode(F.array_compact(F.array(
        F.lit(0).cast("bigint"), F.col("_last"), F.when(interior, F.col("_top"))))).alias(index))
    return fixed.unionByName(peaks.select(*keys, index)).distinct()


def stabs(onsets: DataFrame, keys: Sequence[str], strength: str = "strength", share: float = 0.6) -> DataFrame:
    """Onsets above `share` of the strongest one, with the relative strength."""
    top = with_group(onsets, keys, F.max(strength).alias("_top"))
    rel = top.withColumn(strength, F.col(strength) / (F.col("_top") + 1e-10)).drop("_top")
    return rel.filter(F.col(strength) > share)


def presence_ratio(curve: DataFrame, keys: Sequence[str], value: str, share: float = 0.15) -> DataFrame:
    """Share of samples above `share` of the greatest one."""
    top = with_group(curve, keys, F.max(value).alias("_top"))
    active = F.col(value) / (F.col("_top") + 1e-10) > share
    return top.groupBy(*keys).agg((F.count_if(active) / F.count(F.lit(1))).alias("presence"))


def hooks(curve: DataFrame, keys: Sequence[str], index: str, value: str, window: int, distance: int,
          prominence: float = 0.15, block: int = 50_000) -> DataFrame:
    """Peaks of the smoothed presence curve."""
    top = with_group(curve, keys, F.max(value).alias("_top"), F.count(F.lit(1)).alias("_size"))
    level = top.withColumn("_level", F.col(value) / (F.col("_top") + 1e-10)).select(*keys, index, "_level", "_size")
    if window > 1:
        wide = box_filter(level.withColumn("_smooth", F.col("_level")), keys, index, "_smooth", window, block)
        level = wide.withColumn("_level", F.when(F.col("_size") > window, F.col("_smooth")).otherwise(F.col("_level")))
    found = find_peaks(level.select(*keys, index, "_level"), keys, index, "_level", distance, prominence, block=block)
    return found.withColumnRenamed("_level", "strength")
