"""Labels from numeric feature columns, and frame-level summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.moods import MOTIONS, words


def share_above(x: Column, start: float, span: float) -> Column:
    return (x - start) / span


def share_below(x: Column, start: float, span: float | None = None) -> Column:
    return (F.lit(start) - x) / (span or start)


def at_most(x: Column, limit: float = 1.0) -> Column:
    return F.least(x, F.lit(limit))


def at_least(x: Column, limit: float = 0.0) -> Column:
    return F.greatest(x, F.lit(limit))


def scored_if(condition: Column, score: Column) -> Column:
    """Score where the condition holds, 0 elsewhere and for missing inputs."""
    return F.coalesce(F.when(condition, score), F.lit(0.0)).cast("double")


def choose_labels(
    df: DataFrame,
    scores: Mapping[str, Column],
    exclusive: Sequence[tuple[str, str]],
    first_above: float,
    second_above: float,
    fallback: Column,
    labels: str,
    shown_above: float,
    shown: str = "label_scores",
) -> DataFrame:
    """The best one or two labels, and the map of noteworthy scores.

    Of an exclusive pair the lower score is dropped, the second one on a tie;
    pairs are applied in order. Ties of score keep the order of `scores`.
    """
    columns = {name: f"_score_{i}" for i, name in enumerate(scores)}
    out = df.withColumns({columns[name]: score for name, score in scores.items()})
    for a, b in exclusive:
        x, y = F.col(columns[a]), F.col(columns[b])
        clash = (x > 0) & (y > 0)
        out = out.withColumns({columns[a]: F.when(clash & (x < y), 0.0).otherwise(x), columns[b]: F.when(clash & (x >= y), 0.0).otherwise(y)})
    entries = F.array(*[
        F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, c) in enumerate(columns.items())])
    ranked = F.sort_array(F.filter(entries, lambda e: -e["s"] > first_above))
    out = out.withColumn("_ranked", ranked)
    first = F.get("_ranked", F.lit(0))
    second = F.get("_ranked", F.lit(1))
    picked = F.array_compact(F.array(F.coalesce(first["name"], fallback), F.when(-second["s"] > second_above, second["name"])))
    noted = F.map_from_entries(F.transform(F.filter(entries, lambda e: -e["s"] > shown_above),
                                           lambda e: F.struct(e["name"], F.round(-e["s"], 2))))
    return out.withColumn(labels, picked).withColumn(shown, noted).drop("_ranked", *columns.values())


def mood_labels(df: DataFrame) -> DataFrame:
    """`moods` from brightness (0-255), saturation, contrast, energy, warm_ratio, cool_ratio."""
    b, sat, con, en, warm, cool = (F.col(c) for c in ("brightness", "saturation", "contrast", "energy", "warm_ratio", "cool_ratio"))
    unit = b / 255.0
    scores = {
        "DARK": scored_if(b < 80, share_below(b, 80.0)),
        "BRIGHT": scored_if(b > 180, share_above(b, 180.0, 75.0)),
        "ENERGETIC": scored_if(en > 0.6, share_above(en, 0.6, 0.4)),
        "CALM": scored_if((en < 0.4) & (b > 60) & (b < 180), share_below(en, 0.4)),
        "MELANCHOLIC": at_least(at_most((1.0 - unit) * 0.4 + (1.0 - sat) * 0.4 + con * 0.2)),
        "EUPHORIC": scored_if((b > 150) & (sat > 0.5), sat * unit),
        "AGGRESSIVE": scored_if((con > 0.5) & (sat > 0.4) & (warm > 0.3), con * sat),
        "PEACEFUL": at_least(at_most(unit * 0.3 + (1.0 - con) * 0.4 + (1.0 - en) * 0.3)),
        "MYSTERIOUS": scored_if((b < 100) & (sat > 0.4), sat * share_below(b, 100.0)),
        "CHEERFUL": scored_if((b > 140) & (sat > 0.4) & (warm > 0.3), sat * unit * (warm * 1.5)),
        "TENSE": scored_if((con > 0.5) & (b < 120), con * share_below(b, 120.0)),
        "DREAMY": scored_if((sat < 0.3) & (con < 0.4), share_below(sat, 0.3) * share_below(con, 0.4)),
        "COOL": scored_if((cool > warm) & (cool > 0.2), cool),
        "WARM": scored_if((warm > cool) & (warm > 0.2), warm),
    }
    exclusive = [("DARK", "BRIGHT"), ("ENERGETIC", "CALM"), ("COOL", "WARM")]
    fallback = F.when(en > 0.5, "ENERGETIC").otherwise("CALM")
    out = choose_labels(df, scores, exclusive, 0.3, 0.3, fallback, "moods", 0.2, "mood_scores")
    # a fallback mood takes its score from the energy; it has none above 0.3 then
    alone = ~F.map_contains_key("mood_scores", F.get("moods", F.lit(0)))
    level = F.round(F.when(en > 0.5, en).otherwise(1.0 - en), 2)
    return out.withColumn("mood_scores", F.when(alone, F.map_concat("mood_scores", F.create_map(F.get("moods", F.lit(0)), level)))
                          .otherwise(F.col("mood_scores")))


def style_labels(df: DataFrame) -> DataFrame:
    """`styles` from colour count, noise, sharpness, vignette, saturation, range and brightness."""
    colors, noise, sharp, vig, sat, rng, b = (
        F.col(c) for c in ("unique_colors", "noise_level", "sharpness", "vignette_score", "saturation_mean", "dynamic_range", "mean_brightness"))

    def mean(x: Column, y: Column) -> Column:
        return (x + y) / 2

    scores = {
        "VINTAGE": scored_if((colors < 800) & (vig > 0.05), mean(share_below(colors, 800.0), at_most(vig / 0.15))),
        "FILMIC": scored_if((noise > 0.3) & (sat < 0.6), mean(at_most(share_above(noise, 0.3, 0.3)), share_below(sat, 0.6))),
        "NEON": scored_if((sat > 0.5) & (sharp > 800), mean(share_above(sat, 0.5, 0.5), at_most(share_above(sharp, 800.0, 1200.0)))),
        "MINIMALIST": scored_if((colors < 500) & (rng > 0.6), mean(share_below(colors, 500.0), share_above(rng, 0.6, 0.4))),
        "PSYCHEDELIC": scored_if((colors > 2000) & (sat > 0.4), mean(at_most(share_above(colors, 2000.0, 1000.0)), share_above(sat, 0.4, 0.6))),
        "CINEMATIC": scored_if((vig > 0.03) & (sat > 0.3) & (sat < 0.7), mean(at_most(vig / 0.1), 1.0 - F.abs(sat - 0.5) / 0.2)),
        "DIGITAL": scored_if((sharp > 1000) & (noise < 0.15), mean(at_most(share_above(sharp, 1000.0, 1000.0)), share_below(noise, 0.15))),
        "DREAMY": scored_if((sharp < 300) & (sat < 0.4), mean(share_below(sharp, 300.0), share_below(sat, 0.4))),
        "HIGH_CONTRAST": scored_if(rng > 0.8, share_above(rng, 0.8, 0.2)),
        "LOW_KEY": scored_if(b < 80, share_below(b, 80.0)),
        "HIGH_KEY": scored_if(b > 180, share_above(b, 180.0, 75.0)),
        "STANDARD": F.lit(0.3),
    }
    exclusive = [("LOW_KEY", "HIGH_KEY"), ("MINIMALIST", "PSYCHEDELIC"), ("DIGITAL", "VINTAGE"), ("DIGITAL", "DREAMY")]
    return choose_labels(df, scores, exclusive, 0.3, 0.4, F.lit("STANDARD"), "styles", 0.3, "style_scores")


def scene_labels(df: DataFrame) -> DataFrame:
    """`scene_types` from edge_density, texture_variance, center_ratio, aspect_ratio, has_face, face_count, face_size_ratio."""
    edge, tex, center, aspect, face, count, size = (
        F.col(c) for c in ("edge_density", "texture_variance", "center_ratio", "aspect_ratio", "has_face", "face_count", "face_size_ratio"))
    close_face = face & (size > 0.03)
    far = ~face | (size < 0.03)
    scores = {
        "PORTRAIT": scored_if(close_face, F.when(size > 0.12, 0.5).when(size > 0.06, 0.8).otherwise(0.6)),
        "CLOSEUP": scored_if(close_face, F.when(size > 0.12, at_most(0.6 + size * 2, 0.95)).when(size > 0.06, 0.3).otherwise(0.0)),
        "CROWD": scored_if(count >= 2, at_most(0.4 + count * 0.15, 0.95)),
        "BUSY": scored_if((edge > 0.08) & (tex > 0.25), at_most((share_above(edge, 0.08, 0.2) + share_above(tex, 0.25, 0.5)) / 2 + 0.4, 0.95)),
        "MINIMAL": scored_if((edge < 0.08) & (tex < 0.25), at_least(share_below(edge, 0.08) * 0.5 + share_below(tex, 0.25) * 0.5, 0.4)),
        "ABSTRACT": scored_if((edge < 0.1) & (tex > 0.2), at_most(share_above(tex, 0.2, 0.6) * 0.6 + share_below(edge, 0.1) * 0.4 + 0.3, 0.85)),
        "GEOMETRIC": scored_if((edge > 0.08) & (tex < 0.25), at_most(share_above(edge, 0.08, 0.2) * 0.6 + share_below(tex, 0.25) * 0.4 + 0.3, 0.85)),
        "LANDSCAPE": scored_if((aspect > 1.3) & (center < 0.6), at_most(share_above(aspect, 1.3, 0.5) * 0.5 + share_below(center, 0.6) * 0.5 + 0.3, 0.85)),
        "WIDE_SHOT": scored_if(far, F.when(edge > 0.03, at_least(at_most(edge * 2, 0.7), 0.4)).otherwise(0.4)),
        "INDOOR": scored_if((center > 0.6) & (edge < 0.1), at_least(share_above(center, 0.6, 0.4) * 0.5 + share_below(edge, 0.1) * 0.5 + 0.3, 0.5)),
        "NATURE": scored_if((tex > 0.2) & (center < 0.5) & ~face, at_most(tex * (1 - center) * 1.2, 0.7)),
        "URBAN": scored_if((edge > 0.1) & (tex < 0.4), at_most(edge * (1 - tex) * 1.5, 0.7)),
    }
    exclusive = [("PORTRAIT", "WIDE_SHOT"), ("CLOSEUP", "WIDE_SHOT"), ("CLOSEUP", "LANDSCAPE"), ("BUSY", "MINIMAL"), ("ABSTRACT", "GEOMETRIC"),
                 ("NATURE", "URBAN")]
    return choose_labels(df, scores, exclusive, 0.35, 0.45, F.lit("WIDE_SHOT"), "scene_types", 0.25, "confidence_scores")


def brightness_class(value: Column) -> Column:
    return F.when(value < 80, "DARK").when(value > 180, "BRIGHT").otherwise("MEDIUM")


def temperature_class(score: Column) -> Column:
    return F.when(score > 0.15, "WARM").when(score < -0.15, "COOL").otherwise("NEUTRAL")


def palette_saturation(colors: Column) -> Column:
    """Share-weighted saturation of array<struct<rgb array<int>, pct double>>."""

    def one(c: Column) -> Column:
        top, low = F.array_max(c["rgb"]), F.array_min(c["rgb"])
        return F.when(top > 0, (top - low) / top * c["pct"] / 100).otherwise(0.0)

    return F.aggregate(F.transform(colors, one), F.lit(0.0), lambda acc, x: acc + x)


def color_moods(colors: Column, brightness: Column, temperature: Column) -> Column:
    sat = palette_saturation(colors)
    some = F.size(colors) > 0
    bold = (F.size(colors) >= 2) & F.forall(F.slice(colors, 1, 2), lambda c: c["pct"] > 30)
    return F.array_compact(F.array(
        F.when(brightness < 80, "DARK").when(brightness > 180, "BRIGHT"), F.when(temperature > 0.2, "WARM").when(temperature < -0.2, "COOL"),
        F.when(some & (sat > 0.6), "VIBRANT").when(some & (sat < 0.2), "MUTED"), F.when(bold, "CONTRASTING")))


def harmony(hues: Column) -> Column:
    """Class of the mean circular step between hues given in half degrees."""
    n = F.size(hues)

    def step(a: Column, b: Column) -> Column:
        d = F.abs(a * 2.0 - b * 2.0)
        return F.least(d, 360.0 - d)

    steps = F.zip_with(F.slice(hues, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hues, F.lit(2), F.greatest(n - 1, F.lit(0))), step)
    mean = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / (n - 1)
    return (F.when(n < 2, "monochromatic").when(mean < 30, "analogous").when((mean > 150) & (mean < 210), "complementary")
            .when(((mean > 110) & (mean < 130)) | ((mean > 230) & (mean < 250)), "triadic")
            .when((mean > 80) & (mean < 100), "split_complementary").otherwise("custom"))


def mood_profile(df: DataFrame) -> DataFrame:
    """Levels and a 5-d mood vector next to the feature columns."""
    warm, cool = F.col("warm_ratio"), F.col("cool_ratio")
    return df.withColumns({
        "darkness": 1.0 - F.col("brightness") / 255, "warmth": warm / F.greatest(warm + cool, F.lit(0.001)),
        "mood_vector": F.array("energy", "saturation", "contrast", F.col("brightness") / 255, warm - cool)})


def style_profile(df: DataFrame) -> DataFrame:
    """Level names and a 6-d style vector next to the feature columns."""

    def level(x: Column, low: float, high: float, names: Sequence[str]) -> Column:
        return F.when(x < low, names[0]).when(x < high, names[1]).otherwise(names[2])

    b = F.col("mean_brightness")
    return df.withColumns({
        "color_complexity": level(F.col("unique_colors"), 500, 1500, ("LOW", "MEDIUM", "HIGH")),
        "grain_level": level(F.col("noise_level"), 0.1, 0.3, ("NONE", "LIGHT", "HEAVY")),
        "focus_quality": level(F.col("sharpness"), 300, 1000, ("SOFT", "NORMAL", "SHARP")),
        "lighting": F.when(b < 80, "LOW_KEY").when(b > 180, "HIGH_KEY").otherwise("BALANCED"),
        "style_vector": F.array(F.col("unique_colors") / 3000.0, F.col("noise_level"), F.col("sharpness") / 2000.0, F.col("vignette_score"),
                                F.col("saturation_mean"), F.col("dynamic_range"))})


def mood_similarity(pairs: DataFrame, a: str = "a_", b: str = "b_") -> Column:
    """1 - mean difference of the five feature columns of a pair."""
    total = F.abs(F.col(f"{a}brightness") - F.col(f"{b}brightness")) / 255
    for c in ("saturation", "contrast", "energy", "warm_ratio"):
        total = total + F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}"))
    return 1.0 - total / 5


# fixed values: object names per content tag
CONTENT_OBJECTS = {
    "ANIMALS": ["bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "potted plant"],
    "VEHICLES": ["car", "motorcycle", "bicycle", "bus", "train", "truck", "airplane", "boat"],
    "PEOPLE": ["person", "backpack", "handbag", "umbrella"],
    "SPORTS": ["sports ball", "skis", "snowboard", "skateboard", "surfboard", "tennis racket", "baseball bat", "baseball glove", "frisbee", "kite"],
}


def content_tags(objects: Column, lines: Column, green: Column, sky: Column) -> Column:
    """Distinct tags in alphabetical order."""
    bare = (green < 0.05) & (sky < 0.1)
    found = [F.when(F.arrays_overlap(objects, words(names)), tag) for tag, names in CONTENT_OBJECTS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        *found, F.when(green > 0.3, "NATURE").when(green > 0.15, "OUTDOOR"), F.when(sky > 0.4, "SKY"), F.when(sky > 0.4, "OUTDOOR"),
        F.when(lines > 50, "GEOMETRIC").when(lines > 20, "STRUCTURED"), F.when(bare & (lines > 30), "URBAN"),
        F.when(bare & (lines < 20), "INDOOR")))))


def combined_tags(scores: Column, scene_types: Column, has_face: Column, face_count: Column, threshold: float = 0.6) -> Column:
    """Top three labels above the threshold, new scene types in lower case, and a person tag."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))
    top = F.transform(F.filter(F.slice(F.array_sort(entries), 1, 3), lambda e: -e["s"] >= threshold), lambda e: e["k"])
    none = F.array().cast("array<string>")
    lowered = F.transform(F.coalesce(top, none), lambda t: F.lower(t))
    fresh = F.filter(F.array_distinct(F.transform(F.coalesce(scene_types, none), lambda t: F.lower(t))), lambda t: ~F.array_contains(lowered, t))
    tags = F.concat(F.coalesce(top, none), fresh)
    person = F.when(F.coalesce(has_face, F.lit(False)) & ~F.arrays_overlap(tags, words(["person", "people"])),
                    F.array(F.when(face_count == 1, "person").otherwise("people"))).otherwise(none)
    out = F.concat(tags, person)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("unknown")))


def analysis_quality(scores: Column, edge_density: Column) -> Column:
    best = F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))
    return at_most(best * 0.7 + F.coalesce(at_most(edge_density * 2.0) * 0.3, F.lit(0.0)))


def onset_class(low: Column, mid: Column, high: Column) -> Column:
    """kick, hihat, snare or other by share of the band energies."""
    total = low + mid + high
    return (F.when(total == 0, "unknown").when(low / total > 0.5, "kick").when(high / total > 0.4, "hihat")
            .when(mid / total > 0.5, "snare").otherwise("other"))


def drum_class(low: Column, mid: Column, high: Column) -> tuple[Column, Column]:
    """(class, strength factor) for a drum stem; unclear hits count half."""
    total = low + mid + high + 1e-10
    a, b, c = low / total, mid / total, high / total
    clear = F.when(a > 0.4, "kick").when(b > 0.4, "snare").when(c > 0.3, "hihat")
    guess = F.when((a >= b) & (a >= c), "kick").when(b >= c, "snare").otherwise("hihat")
    return F.coalesce(clear, guess), F.when(clear.isNull(), 0.5).otherwise(1.0)


def consistency(distinct_scenes: Column) -> Column:
    return F.when(distinct_scenes == 1, "consistent").when(distinct_scenes <= 2, "dynamic").otherwise("chaotic")


def label_summary(frames: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score", threshold: float = 0.6,
                  limit: int = 5) -> DataFrame:
    """Per group: the best labels by mean score, the primary one and its score."""
    means = frames.groupBy(*keys, label).agg(F.avg(score).alias("_mean"))
    good = means.filter(F.round("_mean", 9) >= threshold)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("_mean", 9).desc(), label))
    top = good.withColumn("_place", place).filter(F.col("_place") <= limit)
    lists = top.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_place", label))).alias("_l"), F.min_by(label, "_place").alias("primary_label"), F.max("_mean").alias("confidence"))
    found = lists.select(*keys, F.transform("_l", lambda e: e[label]).alias("tags"), "primary_label", "confidence")
    out = frames.select(*keys).distinct().join(found, list(keys), "left")
    return out.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "primary_label": F.coalesce("primary_label", F.lit("unknown")),
                            "confidence": F.coalesce("confidence", F.lit(0.0))})


def circular_stats(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """Circular mean (0-360) and deviation in degrees, at most 180."""
    rad = F.radians(angle)
    sums = df.groupBy(*keys).agg(F.sum(F.sin(rad)).alias("_s"), F.sum(F.cos(rad)).alias("_c"), F.count(angle).alias("_n"))
    r = at_most(F.sqrt(F.col("_s") ** 2 + F.col("_c") ** 2) / F.col("_n"))
    mean = F.degrees(F.atan2("_s", "_c"))
    spread = F.when(r < 1e-10, 180.0).otherwise(at_most(F.degrees(F.sqrt(at_least(-2.0 * F.log(at_least(r, 1e-12))))), 180.0))
    return sums.select(*keys, F.when(mean < 0, mean + 360).otherwise(mean).alias("mean_angle"), spread.alias("angle_std"))


def rhythm_class(brightness: Column, color: Column) -> Column:
    both = (brightness + color) / 2.0
    return F.when(both < 0.15, "STEADY").when(both < 0.4, "DYNAMIC").otherwise("FLASHY")


def temporal_dynamics(frames: DataFrame, keys: Sequence[str], brightness: str = "brightness", hue: str = "hue") -> DataFrame:
    """Per clip: brightness and hue dynamics with a rhythm class; 0 below two frames."""
    level = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_frames"), F.stddev_pop(brightness).alias("_std"))
    joined = level.join(circular_stats(frames, keys, hue), list(keys))
    enough = F.col("_frames") >= 2
    b = F.when(enough, at_most(F.col("_std") / 128.0)).otherwise(0.0)
    c = F.when(enough, F.col("angle_std") / 180.0).otherwise(0.0)
    return joined.select(*keys, F.round(b, 3).alias("brightness_dynamics"), F.round(c, 3).alias("color_dynamics"), rhythm_class(b, c).alias("temporal_rhythm"))


# fixed values: upper bounds of the motion classes, in percent of the frame size
MOTION_LIMITS = [0.5, 2.0, 5.0, 10.0]


def motion_class(magnitude: Column) -> Column:
    out = F.lit(MOTIONS[-1])
    for name, limit in reversed(list(zip(MOTIONS, MOTION_LIMITS))):
        out = F.when(magnitude < limit, name).otherwise(out)
    return out


def motion_summary(frames: DataFrame, keys: Sequence[str], magnitude: str = "magnitude") -> DataFrame:
    """Per clip: class, score and rhythm of the frame-to-frame motion."""
    stats = frames.groupBy(*keys).agg(F.avg(magnitude).alias("avg_magnitude"), F.stddev_pop(magnitude).alias("std_magnitude"))
    avg, std = F.col("avg_magnitude"), F.col("std_magnitude")
    rhythm = F.when(avg < 0.1, "STEADY").when(std / at_least(avg, 0.001) < 0.5, "STEADY").otherwise("ERRATIC")
    return stats.withColumns({"motion_type": motion_class(avg), "motion_score": at_most(avg / 15.0), "motion_rhythm": rhythm})


def camera_motion(flow: DataFrame, keys: Sequence[str], x: str = "flow_x", y: str = "flow_y", magnitude: str = "magnitude",
                  norm: str = "norm_factor") -> DataFrame:
    """Per clip: camera class and magnitude from mean flow vectors per frame."""
    stats = flow.groupBy(*keys).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(norm).alias("_n"), F.stddev_pop(magnitude).alias("_std"))
    size = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2) / F.col("_n") * 100.0
    angle = F.pmod(F.degrees(F.atan2("_y", "_x")) + 180.0, F.lit(360.0))
    heading = F.when((angle >= 315) | (angle < 45), "PAN_RIGHT").when(angle < 135, "TILT_UP").when(angle < 225, "PAN_LEFT").otherwise("TILT_DOWN")
    kind = F.when(size < 0.5, "STATIC_CAM").when(F.col("_std") > size * 0.5, "HANDHELD").otherwise(heading)
    return stats.select(*keys, kind.alias("camera_motion"), size.alias("camera_magnitude"))


def dominant_shares(counts: DataFrame, keys: Sequence[str], item: str, count: str = "n", min_percent: float = 1.0) -> DataFrame:
    """Items above a share of their group, largest first."""
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("_total"))
    shares = counts.join(totals, list(keys)).withColumn("percent", F.col(count) * 100.0 / F.col("_total")).filter(F.col("percent") > min_percent)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(count).desc(), item))
    return shares.withColumn("rank", place).withColumn("percent", F.round("percent", 1)).drop("_total")


def top_objects(counts: Column, limit: int = 5) -> Column:
    """Names of the most frequent entries of a count map; names break ties."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(entries), 1, limit), lambda e: e["k"])


def total_detections(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))
