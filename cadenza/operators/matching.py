"""Scores of clips against targets, and the best clips per target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import moods
from cadenza.functions.moods import clamp
from cadenza.operators import knn, vectorops
from cadenza.operators.ordered import row_index
from cadenza.operators.selection import select_unrecent
from cadenza.operators.timejoin import asof, cover
from cadenza.session import materialize

# fixed values: points of the mood and motion scores
EXACT_MOOD, COMPATIBLE_MOOD, SEVERAL_MOODS = 0.5, 0.3, 0.2
MOTION_POINTS = [0.5, 0.35, 0.2]
CAMERA_POINTS = 0.2
MOTION_SHARE, MOOD_SHARE = 0.6, 0.4
# fixed values: energy gap below (true) or above (false) which a strategy adds its bonus
ENERGY_STEPS = {"exact": (0.1, True), "contrast": (0.5, False)}
# tree levels that are filled from one set of rows, and rows of such a set that a task fills them from
STRIDE, TASK_ROWS = 8, 100_000


def closeness(diff: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(0.3) - F.abs(diff) * 0.5)


def _compatible(target: Column, clip_moods: Column) -> Column:
    """Clip moods that go with the target, repeats included."""
    liked = moods.pick_words(target, moods.COMPATIBLE)
    return F.coalesce(F.filter(clip_moods, lambda m: F.array_contains(liked, m)), F.array().cast("array<string>"))


def mood_points(target: Column, clip_moods: Column) -> Column:
    """Points for the moods alone."""
    n = F.size(_compatible(target, clip_moods))
    exact = F.coalesce(F.array_contains(clip_moods, target), F.lit(False))
    base = F.when(exact, EXACT_MOOD).when(n > 0, COMPATIBLE_MOOD).otherwise(0.0)
    return base + F.when(n > 1, SEVERAL_MOODS).otherwise(0.0)


def mood_score(target: Column, energy: Column, clip_moods: Column, clip_energy: Column, strategy: str = "similar") -> Column:
    """Mood score in [0, 1]; a null target energy adds nothing."""
    own = F.coalesce(clip_energy, F.lit(0.5))
    gap = F.abs(own - energy)
    bonus = {
        "exact": F.when(gap < 0.1, 0.3).otherwise(0.0), "similar": closeness(gap), "contrast": F.when(gap > 0.5, 0.3).otherwise(0.0),
    }.get(strategy, F.lit(0.0))
    return F.least(F.lit(1.0), mood_points(target, clip_moods) + F.coalesce(F.when(energy.isNotNull(), bonus), F.lit(0.0)))


def mood_reasons(target: Column, energy: Column, clip_moods: Column, clip_energy: Column, strategy: str = "similar") -> Column:
    """Texts that explain a mood score."""
    own = F.coalesce(clip_energy, F.lit(0.5))
    gap = F.abs(own - energy)
    liked = _compatible(target, clip_moods)
    exact = F.coalesce(F.array_contains(clip_moods, target), F.lit(False))
    shown = F.format_string("%.2f", own)
    by_energy = {
        "exact": F.when(gap < 0.1, F.concat(F.lit("Exact energy match: "), shown)),
        "similar": F.when(closeness(gap) > 0.1, F.concat(F.lit("Similar energy: "), shown)),
        "contrast": F.when(gap > 0.5, F.concat(F.lit("Contrasting energy: "), shown)),
    }.get(strategy, F.lit(None).cast("string"))
    return F.array_compact(F.array(
        F.when(exact, F.concat(F.lit("Exact mood match: "), target)).when(
            F.size(liked) > 0, F.concat(F.lit("Compatible mood: "), F.get(liked, F.lit(0)))),
        by_energy, F.when(F.size(liked) > 1, F.lit("Multiple mood matches"))))


def _ordinal(motion: Column) -> Column:
    return F.array_position(moods.words(moods.MOTIONS), motion)


def motion_points(target: Column, motion: Column, camera_target: Column, camera: Column, strategy: str = "similar") -> Column:
    """Points for the motion class and the camera."""
    a, b = _ordinal(target), _ordinal(motion)
    gap = F.when((a > 0) & (b > 0), F.abs(a - b))
    if strategy == "exact":
        base = F.when(gap == 0, 0.5)
    elif strategy == "contrast":
        base = F.when(gap >= 2, 0.4)
    else:
        base = F.when(gap == 0, MOTION_POINTS[0]).when(gap == 1, MOTION_POINTS[1]).when(gap == 2, MOTION_POINTS[2])
    return F.coalesce(base, F.lit(0.0)) + F.when(camera_target == camera, CAMERA_POINTS).otherwise(0.0)


def motion_score(target: Column, level: Column, camera_target: Column, motion: Column, clip_level: Column, camera: Column,
                 strategy: str = "similar") -> Column:
    """Motion score in [0, 1]."""
    bonus = closeness(F.coalesce(clip_level, F.lit(0.0)) - level) if strategy != "contrast" else F.lit(0.0)
    points = motion_points(target, motion, camera_target, camera, strategy)
    return F.least(F.lit(1.0), points + F.coalesce(F.when(level.isNotNull(), bonus), F.lit(0.0)))


def top_by_level(
    targets: DataFrame,
    levels: DataFrame,
    keys: Sequence[str],
    k: int,
    target_id: str = "target_id",
    item_id: str = "clip_id",
    axis: str = "axis",
    width: float = 0.02,
) -> DataFrame:
    """The k best items per target for scores `points + closeness(axis gap)`.

    `targets` has keys and `axis`; `levels` has one row per item and key value
    it may be asked for: keys, `points`, `axis`. Among the items of equal keys
    and points only those nearest on the axis can win, so a target looks at k
    axis values on each side instead of at every item; beyond the reach of the
    closeness ids decide, so the lowest k ids of each level join in.
    """
    keys = list(keys)
    group = [*keys, "points"]
    by_id = Window.partitionBy(*group, "_axis").orderBy(item_id)
    # all three are read several times below, so they are written once
    asked = materialize(targets.select(*keys, axis).distinct(), "asked")
    wanted = levels.join(asked.select(*keys).distinct(), keys, "left_semi")
    items = materialize(wanted.select(*group, F.col(axis).alias("_axis"), item_id), "levels")
    tied = items.withColumn("_tie", F.row_number().over(by_id)).filter(F.col("_tie") <= k).drop("_tie")
    values = materialize(row_index(tied.select(*group, "_axis").distinct(), group, ["_axis"], "_idx", width), "values")
    by_level = asked.join(values.select(*group).distinct(), keys)
    # values are keyed by (keys, points): equal floats come from the same literals
    spot = asof(by_level, values.select(*group, F.col("_axis").alias("_at"), "_idx"), group, axis, "_at", ["_idx"], width)
    here = F.coalesce(F.col("before")["_idx"], F.lit(-1))
    around = spot.select(*group, axis, F.explode(F.sequence(here - k + 1, here + k)).alias("_idx"))
    near = around.join(values, [*group, "_idx"]).join(tied, [*group, "_axis"]).select(*group, axis, "_axis", item_id)
    lowest = items.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(item_id))).filter(F.col("_r") <= k)
    far = by_level.join(lowest.drop("_r"), group).select(*group, axis, "_axis", item_id)
    scored = near.unionByName(far).distinct().withColumn(
        "score", F.least(F.lit(1.0), F.col("points") + closeness(F.col("_axis") - F.col(axis)))).filter("score > 0")
    # scores that differ by rounding noise only count as equal
    best = Window.partitionBy(*keys, axis).orderBy(F.round("score", 9).desc(), item_id)
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return targets.join(ranked.select(*keys, axis, item_id, "score", "rank"), [*keys, axis])


def top_by_step(
    targets: DataFrame,
    levels: DataFrame,
    keys: Sequence[str],
    k: int,
    gap: float,
    near: bool,
    bonus: float = 0.3,
    target_id: str = "target_id",
    item_id: str = "clip_id",
    axis: str = "axis",
    width: float = 0.02,
) -> DataFrame:
    """The k best items per target for scores `points`, and `bonus` more for an axis gap below `gap` (`near`) or above it.

    Tables as for `top_by_level`. Items that gain the bonus lie in one range of
    the axis, or in two outer ones. Over the places of a key's axis values stands
    a tree whose nodes keep their k lowest ids; a range is a few of its nodes,
    so a target looks at k ids of each of these and at the k lowest ids of each
    level without the bonus, however many items the range holds. The tree is
    filled `STRIDE` levels at a time: higher nodes need only the ids that the
    nodes below them keep. Targets whose ranges hold the same axis values are
    answered once, so the answers follow the axis values and not the targets.
    """
    keys = list(keys)
    group = [*keys, "points"]
    asked = materialize(targets.select(*keys, axis).filter(F.col(axis).isNotNull()).distinct(), "asked")
    wanted = levels.join(asked.select(*keys).distinct(), keys, "left_semi")
    items = materialize(wanted.select(*group, F.col(axis).cast("double").alias("_axis"), item_id), "levels")
    by_id = Window.partitionBy(*group, "_axis").orderBy(item_id)
    tied = items.withColumn("_tie", F.row_number().over(by_id)).filter(F.col("_tie") <= k).drop("_tie")
    values = materialize(row_index(items.select(*keys, "_axis").distinct(), keys, ["_axis"], "_idx", width), "values")
    top = values.agg(F.max("_idx")).first()[0] or 0
    depth = int(top).bit_length()
    # the nodes of a stride lie inside blocks of places; a block is a few rows, so blocks deal evenly
    lowest = Window.partitionBy(*group, "_block", "_level", "_node").orderBy(item_id)
    below, rows, strides = tied.join(values, [*keys, "_axis"]).select(*group, "_idx", item_id), items.count(), []
    for first in range(0, depth + 1, STRIDE):
        last = min(first + STRIDE - 1, depth)
        dealt = below.withColumn("_block", F.shiftright("_idx", last + 1)).repartition(rows // TASK_ROWS + 1, *group, "_block")
        placed = dealt.withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("_node", F.expr("shiftright(_idx, _level)"))
        kept = placed.withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= k).select(*group, "_level", "_node", item_id)
        strides.append(materialize(kept, "nodes"))
        below = strides[-1].filter(F.col("_level") == last).select(*group, F.shiftleft("_node", last).alias("_idx"), item_id)
        rows = below.count()
    nodes = reduce(DataFrame.unionByName, strides)

    # a gap is compared after rounding to nine places
    edge = 5e-10
    low, high = (F.col(axis) - gap + edge, F.col(axis) + gap - edge) if near else (F.col(axis) - gap - edge, F.col(axis) + gap + edge)
    spots = values.select(*keys, F.col("_axis").alias("_at"), "_idx")
    last = F.coalesce(F.col("before")["_idx"].cast("bigint"), F.lit(-1).cast("bigint"))
    found = asof(asked.withColumn("_edge", low), spots, keys, "_edge", "_at", ["_idx"], width).select(*keys, axis, last.alias("_low"))
    found = asof(found.withColumn("_edge", high), spots, keys, "_edge", "_at", ["_idx"], width).select(*keys, axis, "_low", last.alias("_high"))
    found = materialize(found, "ranges")
    alike = [*keys, "_low", "_high"]
    classes = found.select(*alike).distinct()
    span = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    if near:
        spans = F.array(span(F.col("_low") + 1, F.col("_high")))
    else:
        spans = F.array(span(F.lit(0), F.col("_low")), span(F.col("_high") + 1, F.lit(int(top))))
    ranges = classes.select(*alike, F.explode(spans).alias("_s")).filter(F.col("_s.a") <= F.col("_s.b"))
    visited = ranges.select(*alike, F.explode(cover(F.col("_s.a"), F.col("_s.b"))).alias("_n")).select(*alike, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    inside = visited.join(nodes, [*keys, "_level", "_node"]).select(*alike, "points", item_id, F.lit(float(bonus)).alias("_bonus"))
    plain = items.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(item_id))).filter(F.col("_r") <= k)
    outside = classes.join(plain.select(*group, item_id), keys).select(*alike, "points", item_id, F.lit(0.0).alias("_bonus"))
    both = inside.unionByName(outside).groupBy(*alike, "points", item_id).agg(F.max("_bonus").alias("_bonus"))
    scored = both.withColumn("score", F.least(F.lit(1.0), F.col("points") + F.col("_bonus"))).filter("score > 0")
    best = Window.partitionBy(*alike).orderBy(F.round("score", 9).desc(), item_id)
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    answers = found.join(ranked.select(*alike, item_id, "score", "rank"), alike).select(*keys, axis, item_id, "score", "rank")
    return targets.join(answers, [*keys, axis])


def mood_levels(clip_moods: DataFrame) -> DataFrame:
    """(mood, points, axis, clip_id): each clip once per target mood, with its points."""
    asked = clip_moods.withColumn("mood", F.explode(moods.words(list(moods.COMPATIBLE))))
    return asked.select("mood", F.round(mood_points(F.col("mood"), F.col("moods")), 2).alias("points"),
                        F.coalesce("energy", F.lit(0.5)).alias("axis"), "clip_id")


def motion_levels(clip_motion: DataFrame, cameras: Sequence[str | None] = (None,), strategy: str = "similar") -> DataFrame:
    """(motion, camera, points, axis, clip_id) per target motion and wanted camera."""
    wanted = F.array(*[F.lit(c).cast("string") for c in cameras])
    asked = clip_motion.withColumnRenamed("camera_motion", "_camera").withColumn("motion", F.explode(moods.words(moods.MOTIONS)))
    asked = asked.withColumn("camera", F.explode(wanted))
    points = motion_points(F.col("motion"), F.col("motion_type"), F.col("camera"), F.col("_camera"), strategy)
    return asked.select("motion", F.coalesce("camera", F.lit("")).alias("camera"), F.round(points, 2).alias("points"),
                        F.coalesce("motion_score", F.lit(0.0)).alias("axis"), "clip_id")


def lowest_ids(items: DataFrame, like: Sequence[str], k: int, item_id: str = "clip_id") -> DataFrame:
    """Of items that are equal in `like`, and so score alike for any target, the k lowest ids: no other can be among the k best."""
    by_id = Window.partitionBy(*like).orderBy(item_id)
    return items.select(item_id, *like).withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k).drop("_r")


def best_by_mood(targets: DataFrame, clip_moods: DataFrame, k: int = 10, target_id: str = "target_id", strategy: str = "similar") -> DataFrame:
    """Top clips per target (target_id, mood, energy) under a match strategy: `similar`, `exact` or `contrast`."""
    asked = targets.select(target_id, "mood", F.col("energy").cast("double").alias("axis"))
    levels = mood_levels(lowest_ids(clip_moods, ["moods", "energy"], k))
    if strategy == "similar":
        out = top_by_level(asked, levels, ["mood"], k, target_id)
    else:
        out = top_by_step(asked, levels, ["mood"], k, *ENERGY_STEPS[strategy], target_id=target_id)
    return out.select(target_id, "clip_id", "score", "rank")


def best_by_motion(targets: DataFrame, clip_motion: DataFrame, k: int = 10, cameras: Sequence[str] = (),
                   target_id: str = "target_id", strategy: str = "similar") -> DataFrame:
    """Top clips per target (target_id, motion, level and, with `cameras`, camera) under a match strategy.

    `contrast` looks at motion class and camera only, so all levels agree and
    are asked as one.
    """
    camera = F.coalesce(F.col("camera"), F.lit("")) if cameras else F.lit("")
    level = F.when(F.col("level").isNotNull(), 0.0) if strategy == "contrast" else F.col("level").cast("double")
    asked = targets.select(target_id, "motion", camera.alias("camera"), level.alias("axis"))
    if not cameras:
        clip_motion = clip_motion.withColumn("camera_motion", F.lit(None).cast("string"))
    clips = lowest_ids(clip_motion, ["motion_type", "camera_motion", "motion_score"], k)
    levels = motion_levels(clips, [None, *cameras], strategy)
    if strategy == "contrast":
        out = top_by_step(asked, levels.withColumn("axis", F.lit(0.0)), ["motion", "camera"], k, 0.0, True, 0.0, target_id)
    else:
        out = top_by_level(asked, levels, ["motion", "camera"], k, target_id)
    return out.select(target_id, "clip_id", "score", "rank")


def combine(motion_side: DataFrame, mood_side: DataFrame, motion_share: float = MOTION_SHARE, mood_share: float = MOOD_SHARE,
            k: int | None = None, target_id: str = "target_id") -> DataFrame:
    """Weighted sum of two ranked lists; a clip missing on a side scores 0 there."""
    a = motion_side.select(target_id, "clip_id", F.col("score").alias("_motion"))
    b = mood_side.select(target_id, "clip_id", F.col("score").alias("_mood"))
    both = a.join(b, [target_id, "clip_id"], "full")
    score = F.coalesce(F.col("_motion") * motion_share, F.lit(0.0)) + F.coalesce(F.col("_mood") * mood_share, F.lit(0.0))
    out = both.select(target_id, "clip_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy(target_id).orderBy(F.round("score", 9).desc(), "clip_id"))
    out = out.withColumn("rank", rank)
    return out.filter(F.col("rank") <= k) if k else out


def best_combined(targets: DataFrame, clip_motion: DataFrame, clip_moods: DataFrame, pool: int, k: int | None = None, target_id: str = "target_id",
                  strategy: str = "similar") -> DataFrame:
    """`combine` of the `pool` best clips by motion and by mood; targets that ask for the same are answered once."""
    alike = ["motion", "level", "mood", "energy"]
    # read by both sides, so it is written once
    asked = materialize(targets.groupBy(*alike).agg(F.min(target_id).alias("_first")), "asked")
    named = asked.withColumnRenamed("_first", target_id)
    found = combine(best_by_motion(named, clip_motion, pool, target_id=target_id, strategy=strategy),
                    best_by_mood(named, clip_moods, pool, target_id=target_id, strategy=strategy), k=k, target_id=target_id)
    answers = asked.join(found.withColumnRenamed(target_id, "_first"), "_first").drop("_first")
    same = F.lit(True)
    for c in alike:
        same = same & targets[c].eqNullSafe(answers[c])
    return targets.join(answers, same).select(targets[target_id], "clip_id", "score", "rank")


def match_curve(curve: DataFrame, clip_motion: DataFrame, clip_moods: DataFrame, k: int = 3, sample_id: str = "target_id",
                energy: str = "energy", strategy: str = "similar") -> DataFrame:
    """Best clips per curve sample: energy gives the wanted motion and mood."""
    e = F.col(energy)
    targets = curve.select(sample_id, e.alias("energy"), e.alias("level"), moods.motion_for_energy(e).alias("motion"),
                           moods.plain_mood(e).alias("mood"))
    return best_combined(targets, clip_motion, clip_moods, k, k, sample_id, strategy)


def best_clip(targets: DataFrame, clip_motion: DataFrame, clip_moods: DataFrame, clips: DataFrame, pool: int = 20,
              min_duration: float = 0.5, max_duration: float | None = None, target_id: str = "target_id", keys: Sequence[str] = ("track_id",),
              order: Sequence[str] = ("seg_idx",), avoid_recent: int = 5, strategy: str = "similar") -> DataFrame:
    """One clip per target: the best of the two pools by equal weights; only clips of suitable length enter a pool.

    Targets of a list (`keys`) are answered in `order`, and the clips of its
    last `avoid_recent` answers enter no pool. Each side brings as many more
    candidates, so the pools are exact. Targets without candidates drop out.
    """
    fits = clips.filter(F.coalesce("duration", F.lit(0.0)) >= min_duration)
    if max_duration is not None:
        fits = fits.filter(F.col("duration") <= max_duration)
    ids = fits.select("clip_id")
    by_motion = best_by_motion(targets, clip_motion.join(ids, "clip_id", "left_semi"), pool + avoid_recent, target_id=target_id, strategy=strategy)
    by_mood = best_by_mood(targets, clip_moods.join(ids, "clip_id", "left_semi"), pool + avoid_recent, target_id=target_id, strategy=strategy)
    if not avoid_recent:
        return combine(by_motion, by_mood, 0.5, 0.5, 1, target_id)
    sides = by_motion.select(target_id, "clip_id", "rank", "score", F.lit(0).alias("side")).unionByName(
        by_mood.select(target_id, "clip_id", "rank", "score", F.lit(1).alias("side")))
    lists = sides.groupBy(target_id).agg(F.sort_array(F.collect_list(F.struct("side", "rank", F.col("clip_id").cast("long").alias("clip_id"), "score"))).alias("candidates"))
    cuts = targets.select(target_id, *keys, *order).join(lists, target_id)
    picks = select_unrecent(cuts, keys, order, pool, avoid_recent, [target_id])
    return picks.filter("picked IS NOT NULL").select(target_id, F.col("picked").alias("clip_id"), "score", F.lit(1).alias("rank"))


def nearest_by_vector(targets: DataFrame, clip_vectors: DataFrame, k: int = 1, target_id: str = "target_id", max_distance: float | None = None) -> DataFrame:
    """(target_id, clip_id, distance, rank): the k nearest clips of each target's query vector, none beyond `max_distance`.

    Targets have energy, level, motion and mood, as for the other matchers.
    Distances that differ by rounding noise only count as equal, and the lower
    id wins. Equal query vectors are searched once.
    """
    wanted = targets.select(target_id, F.col("level").alias("motion_score"), "energy", F.col("motion").alias("motion_type"), F.array("mood").alias("moods"))
    found = knn.search(vectorops.query_vectors(wanted, target_id), clip_vectors.select("clip_id", "embedding"), k, target_id, "clip_id", metric=knn.ROUNDED_L2)
    if max_distance is not None:
        found = found.filter(F.col("distance") <= max_distance)
    return found.select(target_id, "clip_id", "distance", "rank")


def clip_emotion(moods_col: Column, energy: Column) -> tuple[Column, Column]:
    """(valence, arousal) of a clip: mean of its known moods, else from energy."""
    points = F.array_compact(F.transform(moods_col, moods.mood_point))
    n = F.size(points)

    def mean(field: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[field]) / n

    known = F.coalesce(n > 0, F.lit(False))
    fallback = clamp((F.coalesce(energy, F.lit(0.5)) - 0.5) * 2, -1.0, 1.0)
    return F.when(known, clamp(mean("v"), -1.0, 1.0)).otherwise(F.lit(0.0)), F.when(known, clamp(mean("a"), -1.0, 1.0)).otherwise(fallback)


def emotion_terms(tv: Column, ta: Column, cv: Column, ca: Column, target_motion: Column, motion: Column,
                  target_energy: Column, energy: Column) -> tuple[Column, Column]:
    """(emotion, relevance) parts of the emotion score."""
    gap = F.sqrt((tv - cv) * (tv - cv) + (ta - ca) * (ta - ca))
    return F.greatest(F.lit(0.0), 1 - gap / 2.0), 1 - (F.abs(target_motion - motion) + F.abs(target_energy - energy)) / 2


def cross_modal_score(bpm: Column, tags: Column, quality: Column, stability: Column) -> Column:
    """Fit of a track's tempo to a clip's tags, nudged by quality, in [0, 1]."""
    lively = F.coalesce(F.arrays_overlap(tags, moods.words(ENERGETIC_TAGS)), F.lit(False))
    calm = F.coalesce(F.arrays_overlap(tags, moods.words(CALM_TAGS)), F.lit(False))
    b = F.coalesce(bpm, F.lit(120.0))
    base = (F.when(b > 130, F.when(lively, 0.3).when(calm, -0.2).otherwise(0.0))
            .when(b < 100, F.when(calm, 0.3).when(lively, -0.2).otherwise(0.0)).otherwise(0.0))
    factor = (F.coalesce(quality, F.lit(0.5)) + F.coalesce(stability, F.lit(0.5))) / 2
    return clamp(0.5 + base + (factor - 0.5) * 0.2)


# fixed values: tag words of the cross-modal rules
ENERGETIC_TAGS = ["party", "dancing", "energetic", "dynamic", "action"]
CALM_TAGS = ["peaceful", "calm", "nature", "sunset", "relaxing"]
ALIGN_ENERGETIC = ["party", "dancing", "energetic", "dynamic", "action", "crowd"]
ALIGN_CALM = ["peaceful", "calm", "nature", "sunset", "beach", "relaxing"]


def mood_alignment(bpm: Column, tags: Column) -> Column:
    b = F.coalesce(bpm, F.lit(120.0))
    lively = F.coalesce(F.arrays_overlap(tags, moods.words(ALIGN_ENERGETIC)), F.lit(False))
    calm = F.coalesce(F.arrays_overlap(tags, moods.words(ALIGN_CALM)), F.lit(False))
    return (F.when((b > 130) & lively, "high_energy").when((b < 100) & calm, "calm")
            .when((b >= 100) & (b <= 130), "dynamic").otherwise("mismatch"))


def content_quality(bpm: Column, quality: Column, confidence: Column, sync: Column, stability: Column, stems: Column) -> Column:
    """Mean of the parts that are present."""
    parts = F.array_compact(F.array(
        F.when(F.coalesce(bpm, F.lit(0.0)) != 0, F.lit(0.8)), F.coalesce(stability, F.lit(0.5)), F.coalesce(quality, F.lit(0.5)),
        F.coalesce(confidence, F.lit(0.0)), sync, F.when(F.coalesce(stems, F.lit(False)), F.lit(0.9))))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / F.size(parts)


def recommended_pacing(bpm: Column, alignment: Column) -> Column:
    b = F.coalesce(bpm, F.lit(120.0))
    return (F.when(alignment == "high_energy", "fast").when(alignment == "calm", "slow").when(alignment == "mismatch", "adaptive")
            .when(b > 140, "fast").when(b > 110, "medium").otherwise("slow"))


def cut_suggestions(bpm: Column, stems: Column, energy: Column, confidence: Column, sync: Column) -> Column:
    found = F.array_compact(F.array(
        F.when(bpm > 80, "beat_sync"), F.when(stems, "stem_triggers"), F.when(F.coalesce(energy, F.lit(0.0)) != 0, "energy_peaks"),
        F.when(confidence > 0.6, "scene_changes"), F.when(sync > 0.7, "audio_video_sync")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("beat_sync")))


def multi_modal_tags(tags: Column, bpm: Column, stems: Column, limit: int = 5) -> Column:
    """First distinct tags: three of the clip, then tempo words."""
    b = F.coalesce(bpm, F.lit(120.0))
    tempo = (F.when(b > 130, moods.words(["high_energy", "fast_tempo"])).when(b < 100, moods.words(["slow_tempo", "chill"]))
             .otherwise(moods.words(["medium_tempo"])))
    extra = F.when(F.coalesce(stems, F.lit(False)), moods.words(["stems_enhanced"])).otherwise(moods.words([]))
    return F.slice(F.array_distinct(F.concat(F.slice(tags, 1, 3), tempo, extra)), 1, limit)


def pacing_confidence(cross_modal: Column, quality: Column, n_suggestions: Column, min_quality: float = 0.5) -> Column:
    base = (cross_modal + quality) / 2 + F.least(n_suggestions / 5.0, F.lit(0.2))
    return clamp(base - F.when(quality >= min_quality, 0.0).otherwise(0.3))


def energy_correlation(bpm: Column, confidence: Column) -> Column:
    tempo = F.least(F.coalesce(bpm, F.lit(120.0)) / 140.0, F.lit(1.0))
    return clamp((tempo + F.coalesce(confidence, F.lit(0.5))) / 2)


def quality_zone(cross_modal: Column, confidence: Column, min_quality: float = 0.5) -> Column:
    """struct(start_t, end_t, quality) of the opening zone, null below the bar."""
    q = (cross_modal + F.coalesce(confidence, F.lit(0.5))) / 2
    return F.when(q > min_quality, F.struct(F.lit(0.0).alias("start_t"), F.lit(30.0).alias("end_t"), q.alias("quality")))


def suggested_points(bpm: Column, transitions: Column, n_beats: Column, limit: int | None = None) -> Column:
    """Every fourth of `n_beats` beats and the scene changes: distinct, sorted, all or the first `limit`."""
    wanted = (bpm > 60) & (n_beats > 0)
    beats = F.when(wanted, F.transform(F.sequence(F.lit(0), F.greatest(n_beats, F.lit(1)).cast("int") - 1, F.lit(4)), lambda i: i * (F.lit(60.0) / bpm)))
    empty = F.array().cast("array<double>")
    points = F.array_sort(F.array_distinct(F.concat(F.coalesce(beats, empty), F.coalesce(transitions, empty))))
    return points if limit is None else F.slice(points, 1, limit)
