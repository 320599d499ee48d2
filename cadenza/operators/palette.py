"""Colour palettes from audio, colour matching, and choice by emotion."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import moods
from cadenza.functions.moods import clamp, pick
from cadenza.operators import knn
from cadenza.session import materialize

MAX_RGB_DISTANCE = 441.0
# fixed values: weights of the colour match and of the emotion score
MATCH_WEIGHTS = {"primary": 0.5, "temperature": 0.25, "brightness": 0.25}
EMOTION_WEIGHT, RELEVANCE_WEIGHT, DIVERSITY_WEIGHT = 0.4, 0.3, 0.3
LEVELS = ["DARK", "MEDIUM", "BRIGHT"]


def audio_palette(df: DataFrame) -> DataFrame:
    """Palette of rows with valence, arousal, brightness, richness and segment_type.

    The mood is the one of the segment's moods nearest to the emotion, or the
    quadrant's mood for segments without moods.
    """
    v, a = F.col("valence"), F.col("arousal")
    options = moods.pick_words(F.lower("segment_type"), moods.PALETTE_MOODS)

    def gap(mood: Column, i: Column) -> Column:
        p = moods.mood_point(mood)
        d = F.sqrt((v - p["v"]) * (v - p["v"]) + (a - p["a"]) * (a - p["a"]))
        return F.struct(F.round(d, 9).alias("d"), i.alias("i"), mood.alias("mood"))

    nearest = F.array_min(F.transform(options, gap))["mood"]
    out = df.withColumn("mood", F.coalesce(nearest, moods.quadrant_mood(v, a)))
    # moods without a palette take the first one's
    mood = F.when(F.col("mood").isin(list(moods.PALETTES)), F.col("mood")).otherwise(F.lit("CALM"))
    table = moods.PALETTES
    light = pick(mood, {m: float(p[0][0]) for m, p in table.items()}) * (0.7 + F.col("brightness") * 0.6)
    lab_a = pick(mood, {m: float(p[0][1]) for m, p in table.items()})
    lab_b = pick(mood, {m: float(p[0][2]) for m, p in table.items()})
    out = out.withColumns({
        "primary_lab": F.struct(clamp(light, 10.0, 95.0).alias("l"), lab_a.alias("a"), lab_b.alias("b")),
        "temperature": pick(mood, {m: p[1] for m, p in table.items()}), "brightness_class": pick(mood, {m: p[2] for m, p in table.items()}),
        "saturation_level": clamp(pick(mood, {m: p[3] for m, p in table.items()}) * (0.5 + F.col("richness")), 0.1, 1.0)})
    p = F.col("primary_lab")
    radius, theta = F.sqrt(p["a"] * p["a"] + p["b"] * p["b"]), F.atan2(p["b"], p["a"])

    def turned(degrees: float) -> Column:
        angle = theta + F.radians(F.lit(degrees))
        return F.struct(p["l"].alias("l"), (radius * F.cos(angle)).alias("a"), (radius * F.sin(angle)).alias("b"))

    return out.withColumns({
        "complementary": F.struct(p["l"].alias("l"), (-p["a"] * 0.8).alias("a"), (-p["b"] * 0.8).alias("b")),
        "analogous_1": turned(30.0), "analogous_2": turned(-30.0)})


def lab_to_rgb(lab: Column) -> Column:
    """array(r, g, b) in 0-255 of a Lab struct (D65)."""
    fy = (lab["l"] + 16.0) / 116.0
    fx, fz = fy + lab["a"] / 500.0, fy - lab["b"] / 200.0

    def inverse(t: Column) -> Column:
        return F.when(t > 0.2068966, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)

    x, y, z = inverse(fx) * 0.95047, inverse(fy), inverse(fz) * 1.08883
    # fixed values: XYZ to linear RGB
    rows = [(3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570)]

    def channel(k: tuple[float, float, float]) -> Column:
        c = x * k[0] + y * k[1] + z * k[2]
        gamma = F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)
        return clamp(gamma * 255.0, 0.0, 255.0).cast("int")

    return F.array(*[channel(k) for k in rows])


def rgb_similarity(primary: Column, colors: Column) -> Column:
    """1 - distance of the nearest colour, relative to the RGB diagonal; 0 without colours."""

    def gap(c: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(primary, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d))

    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.array_min(F.transform(colors, gap)) / MAX_RGB_DISTANCE), F.lit(0.0))


def color_temperature(colors: Column) -> Column:
    lean = F.aggregate(F.transform(colors, lambda c: c[0] - c[2]), F.lit(0.0), lambda acc, d: acc + d)
    return F.when(lean > 50, "WARM").when(lean < -50, "COOL").otherwise("NEUTRAL")


def color_brightness(colors: Column) -> Column:
    mean = F.aggregate(F.transform(colors, lambda c: (c[0] + c[1] + c[2]) / 3), F.lit(0.0), lambda acc, d: acc + d) / F.size(colors)
    return F.when(mean < 85, "DARK").when(mean < 170, "MEDIUM").otherwise("BRIGHT")


# fixed values: sRGB to XYZ, the white of D65, and the limits of the two curves
XYZ_OF_RGB = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)
GAMMA_LIMIT, LAB_LIMIT = 0.04045, 0.008856
#: difference at which two colours have nothing in common any more
FARTHEST = 50.0


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lab(rgb: Column) -> Column:
    """struct(l, a, b) of a colour in 0 .. 255 per channel."""
    linear = F.transform(rgb, lambda c: F.when(c / 255.0 > GAMMA_LIMIT, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92))

    def from_linear(x: Column) -> Column:
        parts = F.array(*[sum(x[j] * row[j] for j in range(3)) / w for row, w in zip(XYZ_OF_RGB, WHITE, strict=True)])
        curved = F.transform(parts, lambda v: F.when(v > LAB_LIMIT, F.cbrt(v)).otherwise(v * 7.787 + 16.0 / 116.0))
        return _let(curved, lambda f: F.struct((f[1] * 116.0 - 16.0).alias("l"), ((f[0] - f[1]) * 500.0).alias("a"), ((f[1] - f[2]) * 200.0).alias("b")))

    return _let(linear, from_linear)


def color_difference(one: Column, two: Column) -> Column:
    """The CIE difference of 2000 between two `lab` colours."""
    full = 2 * math.pi
    share = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))

    def turned(p: Column) -> Column:
        """Both colours with a' stretched by the mean chroma: lightness, chroma, hue."""
        grow = 1.0 + 0.5 * (1.0 - share((F.hypot(p["x"]["a"], p["x"]["b"]) + F.hypot(p["y"]["a"], p["y"]["b"])) / 2.0))

        def polar(c: Column, g: Column) -> list[Column]:
            angle = F.atan2(c["b"], c["a"] * g)
            return [c["l"], F.hypot(c["a"] * g, c["b"]), F.when(angle < 0, angle + full).otherwise(angle)]

        return _let(F.struct(grow.alias("g"), p["x"].alias("x"), p["y"].alias("y")), lambda s: F.struct(
            *[v.alias(n) for n, v in zip(("l1", "c1", "h1", "l2", "c2", "h2"), polar(s["x"], s["g"]) + polar(s["y"], s["g"]), strict=True)]))

    def terms(p: Column) -> Column:
        none, gap, total = p["c1"] * p["c2"] == 0, p["h2"] - p["h1"], p["h1"] + p["h2"]
        turn = F.when(none, 0.0).when(gap > math.pi, gap - full).when(gap < -math.pi, gap + full).otherwise(gap)
        hue = F.when(none, total).when(F.abs(gap) <= math.pi, total / 2.0).when(total < full, (total + full) / 2.0).otherwise((total - full) / 2.0)
        return F.struct(((p["l1"] + p["l2"]) / 2.0 - 50.0).alias("l"), ((p["c1"] + p["c2"]) / 2.0).alias("c"), hue.alias("h"), (p["l2"] - p["l1"]).alias("dl"),
                        (p["c2"] - p["c1"]).alias("dc"), (2.0 * F.sqrt(p["c1"] * p["c2"]) * F.sin(turn / 2.0)).alias("dh"))

    def weighed(p: Column) -> Column:
        t = (1.0 - 0.17 * F.cos(p["h"] - math.radians(30)) + 0.24 * F.cos(2.0 * p["h"]) + 0.32 * F.cos(3.0 * p["h"] + math.radians(6)) - 0.2 * F.cos(4.0 * p["h"] - math.radians(63)))
        return F.struct((p["dl"] / (1.0 + 0.015 * p["l"] * p["l"] / F.sqrt(20.0 + p["l"] * p["l"]))).alias("l"), (p["dc"] / (1.0 + 0.045 * p["c"])).alias("c"),
                        (p["dh"] / (1.0 + 0.015 * p["c"] * t)).alias("h"),
                        (-F.sin(2.0 * math.radians(30) * F.exp(-F.pow((F.degrees(p["h"]) - 275.0) / 25.0, F.lit(2.0)))) * 2.0 * share(p["c"])).alias("r"))

    pair = F.struct(one.alias("x"), two.alias("y"))
    return _let(_let(_let(_let(pair, turned), terms), weighed), lambda w: F.sqrt(
        F.greatest(F.lit(0.0), w["l"] * w["l"] + w["c"] * w["c"] + w["h"] * w["h"] + w["r"] * w["c"] * w["h"])))


def lab_similarity(primary: Column, colors: Column) -> Column:
    """Closeness of the nearest of `colors` to `primary` by the perceptual difference, in [0, 1]; all are RGB."""
    near = _let(lab(primary), lambda p: F.array_min(F.transform(colors, lambda c: color_difference(p, lab(c)))))
    return F.greatest(F.lit(0.0), 1.0 - near / FARTHEST)


def with_similarities(rows: DataFrame, primary: str, colors: str) -> DataFrame:
    """`rows` with rgb_similarity and lab_similarity; rows with the same colours share one comparison."""
    p, c = F.col(primary), F.col(colors)
    pairs = rows.select(primary, colors).distinct()
    # written, so that it is known whether the comparisons are few enough to be sent to all tasks
    near = materialize(pairs.select(p.alias("_p"), c.alias("_c"), rgb_similarity(p, c).alias("rgb_similarity"), lab_similarity(p, c).alias("lab_similarity")), "colours")
    return rows.join(near, p.eqNullSafe(F.col("_p")) & c.eqNullSafe(F.col("_c"))).drop("_p", "_c")


def color_match(primary: Column, temperature: Column, brightness: Column, colors: Column, similarity: Column | None = None) -> Column:
    """Nearest primary by the perceptual difference (`similarity` where it is known), temperature and brightness, weighted."""
    w = MATCH_WEIGHTS
    own_t, own_b = color_temperature(colors), color_brightness(colors)
    t = F.when(own_t == temperature, 1.0).when((own_t == "NEUTRAL") | (temperature == "NEUTRAL"), 0.5).otherwise(0.0)
    levels = moods.words(LEVELS)
    step = F.abs(F.array_position(levels, own_b) - F.array_position(levels, brightness))
    b = F.when(step == 0, 1.0).when(step == 1, 0.5).otherwise(0.0)
    similarity = lab_similarity(primary, colors) if similarity is None else similarity
    score = similarity * w["primary"] + t * w["temperature"] + b * w["brightness"]
    return F.when(F.size(colors) > 0, F.least(F.lit(1.0), score)).otherwise(0.0)


def _emotion_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    gaps = [q[:, None, i] - x[None, :, i] for i in range(4)]
    emotion = np.minimum(1.0, np.sqrt(gaps[0] ** 2 + gaps[1] ** 2) / 2.0)
    return EMOTION_WEIGHT * emotion + RELEVANCE_WEIGHT * (np.abs(gaps[2]) + np.abs(gaps[3])) / 2.0


def _emotion_row(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Loss of score of (valence, arousal, motion, energy) rows against one target.

    A capped distance plus an absolute difference: a metric, as cells need it.
    """
    emotion = np.minimum(1.0, np.sqrt((x[:, 0] - q[0]) ** 2 + (x[:, 1] - q[1]) ** 2) / 2.0)
    relevance = (np.abs(x[:, 2] - q[2]) + np.abs(x[:, 3] - q[3])) / 2.0
    return np.round(EMOTION_WEIGHT * emotion + RELEVANCE_WEIGHT * relevance, 9)


EMOTION_METRIC = knn.Metric(_emotion_pairs, _emotion_row)


def best_by_emotion(targets: DataFrame, clips: DataFrame, k: int = 1) -> DataFrame:
    """(target_id, clip_id, score, rank) for vectors (valence, arousal, motion, energy), without history.

    Of clips with equal vectors only the k lowest ids can be found, so no others are searched.
    """
    by_id = Window.partitionBy("embedding").orderBy("clip_id")
    lowest = materialize(clips.withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k).drop("_r"), "lowest")
    found = knn.search(targets, lowest, k, "target_id", "clip_id", metric=EMOTION_METRIC, few_dimensions=True)
    top = EMOTION_WEIGHT + RELEVANCE_WEIGHT + DIVERSITY_WEIGHT
    return found.select("target_id", "clip_id", (F.lit(top) - F.col("distance")).alias("score"), "rank")
