"""Sampled curves: smoothing, framing, resampling, emotion curves, segments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import moods
from cadenza.operators.ordered import framed, row_index, with_group
from cadenza.operators.timejoin import asof, containing, curve_value, lerp

LOW, HIGH = 0.33, 0.66
SAVGOL_WINDOW, GAUSS_SIGMA, GAUSS_TRUNCATE, MEDIAN_WINDOW = 51, 3.0, 4.0, 11
SEGMENT_SECONDS = 120.0


def zone(energy: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(energy < low, "low").when(energy < high, "medium").when(energy.isNotNull(), "high")


def moving_average(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], window: int,
                   block: int = 100_000) -> DataFrame:
    """Centred mean over `window` rows, shorter at the ends; identity for series under 3 points."""
    if window <= 1:
        return df
    half = window // 2
    sized = with_group(df, keys, F.count(F.lit(1)).alias("_size"))
    frames = {f"_avg_{v}": (lambda w, v=v: F.avg(v).over(w.rowsBetween(-half, half))) for v in values}
    out = framed(sized, keys, index, half, frames, block)
    for v in values:
        out = out.withColumn(v, F.when(F.col("_size") < 3, F.col(v)).otherwise(F.col(f"_avg_{v}"))).drop(f"_avg_{v}")
    return out.drop("_size")


def box_filter(df: DataFrame, keys: Sequence[str], index: str, value: str, window: int, block: int = 100_000) -> DataFrame:
    """Mean over `window` rows with zeros outside the series (a `same` convolution)."""
    lo, hi = -(window // 2), (window - 1) // 2
    frame = {"_sum": lambda w: F.sum(value).over(w.rowsBetween(lo, hi))}
    return framed(df, keys, index, window, frame, block).withColumn(value, F.col("_sum") / window).drop("_sum")


def gaussian(df: DataFrame, keys: Sequence[str], index: str, value: str, sigma: float = GAUSS_SIGMA,
             block: int = 100_000) -> DataFrame:
    """Gaussian smoothing, truncated at 4 sigma, the series mirrored at its ends."""
    radius = int(GAUSS_TRUNCATE * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(x / sum(raw)) for x in raw])
    sized = with_group(df, keys, F.count(F.lit(1)).alias("_size"))
    i, n = F.col(index), F.col("_size")
    # images of row i under repeated mirroring that fall within `radius` of the series
    turns = F.ceil(F.lit(radius) / n).cast("int") + 1
    images = F.flatten(F.transform(F.sequence(-turns, turns), lambda m: F.array(2 * n * m + i, 2 * n * m - 1 - i)))
    near = F.filter(images, lambda p: (p >= -radius) & (p < n + radius))
    inside = (i >= radius) & (i < n - radius)
    mirrored = sized.withColumn("_pos", F.explode(F.when(inside, F.array(i)).otherwise(near)))
    frame = {"_around": lambda w: F.collect_list(value).over(w.rowsBetween(-radius, radius))}
    out = framed(mirrored, keys, "_pos", radius, frame, block).filter(F.col("_pos") == i)
    dot = F.aggregate(F.zip_with("_around", weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumn(value, dot).drop("_around", "_pos", "_size")


def median(df: DataFrame, keys: Sequence[str], index: str, value: str, window: int = MEDIAN_WINDOW,
           block: int = 100_000) -> DataFrame:
    """Running median over an odd window, zeros outside the series."""
    half = window // 2
    sized = with_group(df, keys, F.count(F.lit(1)).alias("_size"))
    frame = {"_around": lambda w: F.collect_list(value).over(w.rowsBetween(-half, half))}
    out = framed(sized, keys, index, half, frame, block)
    n = F.col("_size")
    odd = F.least(F.lit(window), F.when(n % 2 == 1, n).otherwise(n - 1)).cast("int")
    h = F.floor(odd / 2).cast("int")
    i = F.col(index)
    from_left = F.least(i, F.lit(half))
    first = F.greatest(from_left - h, F.lit(0)).cast("int")
    stop = F.least(from_left + h + 1, F.size("_around")).cast("int")
    part = F.slice("_around", first + 1, stop - first)
    padded = F.array_sort(F.concat(part, F.array_repeat(F.lit(0.0), odd - F.size(part))))
    return out.withColumn(value, F.element_at(padded, h + 1)).drop("_around", "_size")


def savgol(df: DataFrame, keys: Sequence[str], index: str, value: str, window: int = SAVGOL_WINDOW,
           block: int = 100_000) -> DataFrame:
    """Cubic Savitzky-Golay smoothing; the end windows are fitted once and evaluated.

    The cubic is written in the orthogonal polynomials of the window, so a row
    needs one weighted sum over its window.
    """
    sized = with_group(df, keys, F.count(F.lit(1)).alias("_size"))
    reach = window - 1
    n, i = F.col("_size"), F.col(index)
    wl = F.least(F.lit(window), F.when(n % 2 == 1, n).otherwise(n - 1)).cast("int")
    m = F.floor(wl / 2).cast("int")
    start = F.least(F.greatest(i - m, F.lit(0)), n - wl)
    sized = sized.withColumns({"_wl": wl, "_w": wl.cast("double"), "_m": m.cast("double"), "_x": (i - start - m).cast("double"), "_start": start})
    w = F.col("_w")
    # squared norms of the four polynomials over a window of w points
    spread = w * (w * w - 1)
    norms = [w, spread / 12, spread * (w * w - 4) / 180, spread * (w * w - 4) * (w * w - 9) / 2800]

    def poly(d: int, x: Column) -> Column:
        return [F.lit(1.0), x, x * x - (w * w - 1) / 12, x * x * x - x * (3 * w * w - 7) / 20][d]

    # what a row's own position needs is worked out before the window, once per row
    own = {f"_g{d}": poly(d, F.col("_x")) / norms[d] for d in range(4)} | {"_q": (w * w - 1) / 12, "_r": (3 * w * w - 7) / 20}
    frame = {"_around": lambda win: F.collect_list(value).over(win.rowsBetween(-reach, reach))}
    out = framed(sized.withColumns(own), keys, index, reach, frame, block)
    part = F.slice("_around", (F.col("_start") - i + F.least(i, F.lit(reach)) + 1).cast("int"), F.col("_wl"))

    def weighted(y: Column, k: Column) -> Column:
        u = k - F.col("_m")
        square = u * u
        return y * (F.col("_g0") + u * F.col("_g1") + (square - F.col("_q")) * F.col("_g2") + u * (square - F.col("_r")) * F.col("_g3"))

    fit = F.aggregate(F.transform(part, weighted), F.lit(0.0), lambda acc, x: acc + x)
    smooth = F.when(w < 5, F.col(value)).otherwise(fit)
    return out.withColumn(value, smooth).drop("_around", "_wl", "_w", "_m", "_x", "_start", "_size", *own)


def smooth(df: DataFrame, keys: Sequence[str], index: str, value: str, method: str = "savgol", block: int = 100_000) -> DataFrame:
    """Smoothing by name: savgol, gaussian, median or none."""
    kinds = {"savgol": savgol, "gaussian": gaussian, "median": median}
    return kinds[method](df, keys, index, value, block=block) if method in kinds else df


def normalised(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values divided by the greatest of the group, where that is positive."""
    top = with_group(df, keys, F.max(value).alias("_top"))
    return top.withColumn(value, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def frame_rms(samples: DataFrame, keys: Sequence[str], index: str, value: str, frame: int, hop: int) -> DataFrame:
    """RMS of centred frames: frame f covers samples around f*hop, zeros outside.

    Each sample adds its square to the few frames it lies in; sums are combined
    before the shuffle.
    """
    half = frame // 2
    i = F.col(index)
    sized = with_group(samples, keys, F.max(index).alias("_last"))
    last_frame = F.floor((F.col("_last") + 1) / hop)
    lo = F.greatest(F.lit(0), F.floor((i - (frame - half)) / hop) + 1)
    hi = F.least(last_frame, F.floor((i + half) / hop))
    spread = sized.filter(lo <= hi).withColumn("frame", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    power = spread.groupBy(*keys, "frame").agg((F.sum(F.col(value) * F.col(value)) / frame).alias("_p"))
    return power.select(*keys, "frame", F.sqrt("_p").alias("rms"))


def waveform(samples: DataFrame, keys: Sequence[str], index: str, value: str, pixels: int = 1920, rms: bool = True) -> DataFrame:
    """(keys, pixel, low, high) per display bucket; the ragged tail belongs to the last bucket."""
    sized = with_group(samples, keys, F.max(index).alias("_last"))
    n = F.col("_last") + 1
    per = F.greatest(F.lit(1), F.floor(n / pixels))
    kept = sized.withColumn("pixel", F.least(F.floor(F.col(index) / per), F.floor(n / per) - 1))
    if rms:
        level = F.sqrt(F.avg(F.col(value) * F.col(value)))
        return kept.groupBy(*keys, "pixel").agg((-level).alias("low"), level.alias("high"))
    return kept.groupBy(*keys, "pixel").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def resample(bounds: DataFrame, start: str, end: str, count: Column, name: str = "t") -> DataFrame:
    """`count` evenly spaced times from start to end, both included."""
    steps = bounds.withColumn("_n", F.greatest(count, F.lit(1)).cast("int"))
    out = steps.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = F.when(F.col("_n") > 1, (F.col(end) - F.col(start)) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return out.withColumn(name, F.col(start) + F.col("k") * step).drop("_n")


def gradient(events: DataFrame, curve: DataFrame, keys: Sequence[str], values: Sequence[str], window: float = 1.0,
             width: float | None = None) -> DataFrame:
    """Slope of the curve over `window` around each event, ends clamped."""
    row = F.struct(*[F.col(c) for c in events.columns])
    both = events.select(*keys, row.alias("_event"), F.explode(F.array(F.lit(-0.5), F.lit(0.5))).alias("_side"), F.col("t").alias("_c"))
    asked = both.withColumn("_at", F.col("_c") + F.col("_side") * window).drop("_c")
    found = curve_value(asked, curve, keys, "_at", "t", values, True, width)
    # one row per event again: two sides, so the group is of size two
    out = found.groupBy(*keys, "_event").agg(*[
        (F.sum(F.when(F.col("_side") > 0, F.col(v)).otherwise(-F.col(v))) / window).alias(f"{v}_gradient") for v in values])
    return out.select("_event.*", *[f"{v}_gradient" for v in values])


def interval_average(intervals: DataFrame, curve: DataFrame, keys: Sequence[str], values: Sequence[str],
                     ids: Sequence[str], per_second: float = 4.0, width: float | None = None) -> DataFrame:
    """Mean of the curve over each interval, sampled evenly; 0 for empty intervals."""
    count = F.greatest(F.lit(2), ((F.col("end_t") - F.col("start_t")) * per_second).cast("int"))
    times = resample(intervals.filter("start_t < end_t").select(*keys, *ids, "start_t", "end_t"), "start_t", "end_t", count)
    found = curve_value(times, curve, keys, "t", "t", values, True, width)
    means = found.groupBy(*keys, *ids).agg(*[F.avg(v).alias(v) for v in values])
    return intervals.select(*keys, *ids).join(means, [*keys, *ids], "left").fillna(0.0, list(values))


def emotion_from_segments(segments: DataFrame, duration: str, keys: Sequence[str], smoothing: int = 1,
                          width: float | None = None) -> DataFrame:
    """(t, valence, arousal, segment_type): start, middle and end of each segment."""
    kind = F.lower("segment_type")
    lift = F.coalesce(F.col("energy"), F.lit(0.5)) - 0.5
    base = segments.withColumns({
        "segment_type": kind,
        "valence": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moods.segment_valence(kind) + lift * 0.3)),
        "arousal": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moods.segment_arousal(kind) + lift * 0.5))})
    at = F.array(F.struct(F.col("start_t").alias("t"), F.lit(0).alias("part")),
                 F.struct(((F.col("start_t") + F.col("end_t")) / 2).alias("t"), F.lit(1).alias("part")),
                 F.struct(F.col("end_t").alias("t"), F.lit(2).alias("part")))
    points = base.withColumn("_p", F.explode(at)).select("*", "_p.t", "_p.part").drop("_p")
    points = points.filter((F.col("t") >= 0) & (F.col("t") <= F.col(duration)))
    # touching segments share a time: the earlier segment's end comes first
    points = points.withColumn("_order", F.col("seg_idx") * 3 + F.col("part"))
    numbered = row_index(points, keys, ["t", "_order"], "idx", width)
    out = moving_average(numbered, keys, "idx", ["valence", "arousal"], smoothing)
    return out.select(*keys, "idx", "t", "valence", "arousal", "segment_type")


def emotion_from_features(tracks: DataFrame, curves: dict[str, DataFrame], keys: Sequence[str], sample_rate: float,
                          segments: DataFrame | None = None, smoothing: int = 1, width: float | None = None,
                          segment_bin: float = 60.0) -> DataFrame:
    """Resampled (t, valence, arousal) from energy, brightness and richness curves.

    `curves` maps a feature to a DataFrame (keys, t, value); brightness and
    richness default to 0.5. `tracks` has the duration.
    """
    count = (F.col("duration") * sample_rate).cast("bigint") + 1
    base = tracks.select(*keys, F.lit(0.0).alias("_zero"), "duration")
    out = resample(base, "_zero", "duration", count).select(*keys, F.col("k").cast("bigint").alias("idx"), "t")
    for name in ("energy", "brightness", "richness"):
        if name in curves:
            curve = curves[name].select(*keys, "t", F.col("value").alias(name))
            found = asof(out, curve, keys, "t", "t", [name], width)
            out = found.select(*out.columns, F.coalesce(lerp("t", name, clamp=True), F.lit(0.5)).alias(name))
        else:
            out = out.withColumn(name, F.lit(0.5))
    valence, arousal = moods.audio_emotion(F.col("energy"), F.col("brightness"), F.col("richness"), F.col("energy") * 0.8)
    out = out.withColumn("valence", valence).withColumn("arousal", arousal)
    if segments is not None:
        # segments are looked up at half-second steps, both ends included, the last one wins
        steps = out.withColumn("_half", (F.col("t") * 2).cast("bigint").cast("double"))
        halves = segments.select(*keys, "seg_idx", "segment_type", (F.col("start_t") * 2).cast("bigint").cast("double").alias("_a"),
                                 (F.col("end_t") * 2).cast("bigint").cast("double").alias("_b"))
        out = containing(steps, halves, keys, "_half", "_a", "_b", ["seg_idx"], ["segment_type"], segment_bin * 2,
                         closed_end=True, last=True).drop("_half")
    return moving_average(out, keys, "idx", ["valence", "arousal"], smoothing)


def segment_label(index: Column, total: Column, energy: Column, start: Column, duration: Column) -> Column:
    """Label by position and energy relative to the track median.

    The segment before the last one counts as outro.
    """
    at = start / duration
    return (
        F.when(index == 0, "intro").when((at < 0.15) & (energy < 0.9), "intro")
        .when(index == total - 2, "outro").when((at > 0.85) & (energy < 0.9), "outro")
        .when((at > 0.4) & (at < 0.6) & (energy > 0.85) & (energy < 1.15), "bridge")
        .when(energy > 1.4, "drop").when(energy > 1.15, "chorus").otherwise("verse"))


def segment_energy(curve: DataFrame, median_by_group: DataFrame, bucket: Column, value: str, keys: Sequence[str],
                   index: str = "seg_idx") -> DataFrame:
    """Mean level per segment relative to the track median (column `median`)."""
    means = curve.withColumn(index, bucket).groupBy(*keys, index).agg(F.avg(value).alias("_mean"))
    floor = F.greatest(F.col("median"), F.lit(1e-8))
    return means.join(median_by_group, list(keys)).withColumn("relative", F.col("_mean") / floor).drop("_mean", "median")


def fixed_segments(curve: DataFrame, median_by_group: DataFrame, tracks: DataFrame, value: str, keys: Sequence[str],
                   seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Labelled segments of fixed length; a segment without samples has relative energy 1."""
    n = F.ceil(F.col("duration") / seconds)
    grid = tracks.select(*keys, "duration", n.cast("bigint").alias("total")).filter("total > 0")
    grid = grid.withColumn("seg_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)))
    level = segment_energy(curve, median_by_group, F.floor(F.col("t") / seconds), value, keys)
    out = grid.join(level, [*keys, "seg_idx"], "left").withColumn("relative", F.coalesce("relative", F.lit(1.0)))
    start = F.col("seg_idx") * F.lit(seconds)
    return out.select(
        *keys, "seg_idx", start.alias("start_t"), F.least(start + seconds, F.col("duration")).alias("end_t"),
        segment_label(F.col("seg_idx"), F.col("total"), F.col("relative"), start, F.col("duration")).alias("segment_type"),
        F.least(F.lit(1.0), F.col("relative")).alias("energy"))


def spectral_summary(frames: DataFrame, keys: Sequence[str], feature: str, value: str, features: Sequence[str]) -> DataFrame:
    """One row per group: mean, population variance and deviation of each feature."""
    pivoted = frames.groupBy(*keys).pivot(feature, list(features)).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("std"))
    return pivoted


