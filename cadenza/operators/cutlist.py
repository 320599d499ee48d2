"""Assembly of cut lists: targets, durations, layout, filling, walks along beats and energy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import moods
from cadenza.functions.moods import clamp
from cadenza.operators.chain import KEPT, WalkRule, walk
from cadenza.operators.intervals import with_next_start
from cadenza.operators.ordered import Running, row_index, running
from cadenza.operators.rules import Moments, PacingConfig, zone_of
from cadenza.operators.timewalk import walk_time

MIN_PART = 0.5
LEAST_CUT = 0.1


def lay_out(cuts: DataFrame, keys: Sequence[str], order: Sequence[str], duration: str, target: str, width: float | None = None) -> DataFrame:
    """start_t and end_t of cuts in a row: running sum of the durations, up to the target."""
    placed = running(cuts, keys, order, [Running("start_t", "sum", F.col(duration))], width)
    # rounding keeps a sum that meets the target from slipping below it
    placed = placed.withColumn("start_t", F.round(F.coalesce("start_t", F.lit(0.0)), 9))
    inside = placed.filter(F.col("start_t") < F.col(target))
    return inside.withColumn("end_t", F.least(F.col("start_t") + F.col(duration), F.col(target))).filter("end_t > start_t")


def round_robin(cuts: DataFrame, clips: DataFrame, n_clips: int, keys: Sequence[str] = ("track_id",), order: Sequence[str] = ("t", "seq"),
                width: float | None = None) -> DataFrame:
    """Cuts of at least half a second with the clip whose rank is their number modulo the count.

    `clips` has clip_rank; cuts that meet a clip without a path are dropped
    after the assignment.
    """
    numbered = row_index(cuts.filter(F.col("duration") >= MIN_PART), keys, order, "_i", width)
    ranked = numbered.withColumn("clip_rank", F.pmod("_i", F.lit(n_clips)))
    return ranked.join(clips.filter(F.col("file_path").isNotNull() & (F.col("file_path") != "")), "clip_rank").drop("_i", "clip_rank")


def fill_tail(lists: DataFrame, interval: float, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Rows (keys, fill, start_t, end_t) of fixed length from `position` to `target`; a rest under half a second stays empty."""
    rest = F.col("target") - F.col("position")
    count = F.floor((rest - MIN_PART) / interval) + 1
    rows = lists.filter(rest >= MIN_PART).withColumn("fill", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    start = F.col("position") + F.col("fill") * F.lit(float(interval))
    return rows.select(*keys, "fill", start.alias("start_t"), F.least(start + interval, F.col("target")).alias("end_t"))


def align_to_beats(beats: DataFrame, keys: Sequence[str], clips: DataFrame | None = None, min_duration: float = 2.0, max_duration: float = 10.0,
                   width: float | None = None) -> DataFrame:
    """(keys, clip_index, start_t, duration): each clip starts at the first beat after the last one's end.

    A clip lasts to the next beat, within the bounds. `clips` is a sequence per
    list: (keys, clip_index) from 0, with clip_id and what else belongs to the
    clip, such as its start_offset; the list ends with it and the columns are
    joined. Without it all aligned beats are returned.
    """
    ahead = with_next_start(beats, keys, "t", ["seq"], None, width)
    gap = F.greatest(F.least(F.col("next_t") - F.col("t"), F.lit(max_duration)), F.lit(min_duration))
    rows = ahead.withColumns({"_hold": F.coalesce(gap, F.lit(max_duration)), "_zero": F.lit(0.0)})
    kept = walk(rows, keys, ["t", "seq"], "_zero", "_hold", WalkRule("first", max(max_duration, min_duration)), width).filter(KEPT)
    numbered = row_index(kept, keys, ["t", "seq"], "clip_index", width)
    aligned = numbered.select(*keys, "seq", "clip_index", F.col("t").alias("start_t"), F.col("_hold").alias("duration"))
    return aligned if clips is None else aligned.join(clips, [*keys, "clip_index"])


@dataclass(frozen=True)
class EnergyWalk:
    """Cuts whose length follows the zone of the energy at their start, with `snap` from beat to beat.

    Where a snapped end is not after the start, the shortest length is taken,
    and the walk ends if that passes the track. Cuts under `LEAST_CUT` seconds
    are left out.
    """

    short: float
    long: float
    snap: bool
    limits: tuple[float, float]

    def step(self, t, value, bpm, offset, duration):
        wanted = np.where(np.isnan(value), self.long, np.array([self.long, (self.short + self.long) / 2, self.short])[zone_of(value, self.limits)])
        beat = Moments(t, value, bpm, offset).beat

        def on_beat(x):
            return np.maximum(0.0, np.rint((x - offset) / beat) * beat + offset)

        start = on_beat(t) if self.snap else t
        end = np.minimum(on_beat(start + wanted) if self.snap else start + wanted, duration)
        stuck = end <= start
        end = np.where(stuck, start + self.short, end)
        over = stuck & (end > duration)
        emit = ~over & (end - start >= LEAST_CUT)
        return np.where(emit, 0, -1), start, end, np.where(over, duration, end)


def energy_driven(tracks: DataFrame, energy: DataFrame, min_duration: float = 0.5, max_duration: float = 4.0, snap: bool = True,
                  low: float = 0.33, high: float = 0.66, max_cuts: int | None = None, width: float | None = None) -> DataFrame:
    """(track_id, cut_index, start_t, end_t): short cuts where the energy is high, long where it is low.

    The walk goes on from the end of each cut, whatever the lengths; with
    `snap` starts and ends are beats. All cuts are returned unless the caller
    sets `max_cuts`.
    """
    walk = EnergyWalk(float(min_duration), float(max_duration), snap, (low, high))
    cuts = walk_time(tracks, energy, walk, width=width)
    numbered = row_index(cuts.drop("label"), ["track_id"], ["t"], "cut_index", width)
    if max_cuts is not None:
        numbered = numbered.filter(F.col("cut_index") < max_cuts)
    return numbered.select("track_id", "cut_index", "start_t", "end_t")


def step_cuts(steps: DataFrame, keys: Sequence[str], step: Column, offset: Column, cut_duration: float | None = None,
              extend: bool = True, width: float | None = None) -> DataFrame:
    """Active steps (step_index) as intervals: fixed length, to the next step, or one step."""
    placed = steps.withColumns({"_step": step, "start_t": F.col("step_index") * step + offset})
    if cut_duration is not None:
        return placed.withColumn("end_t", F.col("start_t") + cut_duration).drop("_step")
    if not extend:
        return placed.withColumn("end_t", F.col("start_t") + F.col("_step")).drop("_step")
    ahead = with_next_start(placed, keys, "start_t", ["step_index"], None, width, "_next")
    return ahead.withColumn("end_t", F.coalesce("_next", F.col("start_t") + F.col("_step"))).drop("_next", "_step")


def varied_levels(index: Column, energy: Column, config: PacingConfig = PacingConfig()) -> tuple[Column, Column]:
    """(motion level, energy level) moved along a sine over the cut index."""
    import math

    wave = F.sin(index / float(config.variation_cycle) * 2 * math.pi) * config.variation_step
    return clamp(energy + wave - config.motion_offset), clamp(energy + wave + config.energy_offset)


def target_properties(index: Column, energy: Column, segment: Column) -> dict[str, Column]:
    """Energy, motion level, motion class and mood wanted for a cut."""
    saw = F.pmod(index, F.lit(10)) * 0.05
    motions, mood_list = moods.pick_words(segment, moods.SEGMENT_MOTIONS), moods.pick_words(segment, moods.SEGMENT_MOODS)

    def has(name: str) -> Column:
        return F.array_contains(motions, name)

    def turn(items: Column) -> Column:
        return F.element_at(items, (F.pmod(index, F.size(items)) + 1).cast("int"))

    by_segment = (
        F.when((energy > 0.7) & has("FAST"), "FAST").when((energy > 0.7) & has("EXTREME"), "EXTREME").when((energy > 0.5) & has("MEDIUM"), "MEDIUM")
        .when((energy < 0.3) & has("STATIC"), "STATIC").otherwise(turn(motions)))
    return {
        "varied_energy": clamp(energy + saw - 0.025), "varied_motion": clamp(energy - saw + 0.025),
        "target_motion": F.when(motions.isNotNull(), by_segment).otherwise(moods.motion_for_energy(energy)),
        "target_mood": F.when(mood_list.isNotNull(), turn(mood_list)).otherwise(moods.cycled_mood(energy, index))}


def keep_best(cuts: DataFrame, keys: Sequence[str], quality: str, most: int = 50, when_zero: int = 25, confidence: float | None = None) -> DataFrame:
    """The strongest cuts of a list, as many as its quality allows (at most `most`)."""
    rows = cuts.filter(F.col("confidence") >= confidence) if confidence is not None else cuts
    q = F.least(F.col(quality), F.lit(1.0))
    allowed = F.when(q > 0, (q * most).cast("int")).otherwise(when_zero)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("intensity").desc(), F.col("t").desc(), F.col("seq").desc()))
    # the constant bound lets every task keep its best `most` rows before the shuffle
    return rows.withColumn("_p", place).filter(F.col("_p") <= max(most, when_zero)).filter(F.col("_p") <= allowed).drop("_p")


def summary(cuts: DataFrame, keys: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """Number, mean, least and greatest length of cuts, and percent of the target covered."""
    d = F.col("end_t") - F.col("start_t")
    aggs = [F.count(F.lit(1)).alias("n_cuts"), F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.sum(d).alias("covered")]
    if target is not None:
        aggs.append(F.max(target).alias("_target"))
    out = cuts.groupBy(*keys).agg(*aggs)
    if target is None:
        return out
    return out.withColumn("coverage_percent", F.when(F.col("_target") > 0, F.col("covered") / F.col("_target") * 100).otherwise(0.0)).drop("_target")


def diversity(selections: DataFrame, keys: Sequence[str], clip: str = "clip_id", approximate: bool = False) -> DataFrame:
    """Selections, distinct clips and their ratio per list."""
    distinct = F.approx_count_distinct(clip) if approximate else F.count_distinct(clip)
    out = selections.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_selections"), distinct.alias("unique_clips"))
    return out.withColumn("diversity_ratio", F.col("unique_clips") / F.greatest(F.col("total_selections"), F.lit(1)))


def structure_summary(segments: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """One line per track: its segments in order. A track has a handful of segments."""
    text = F.format_string("%s (%.1fs-%.1fs, %.1fs)", F.upper("segment_type"), F.col("start_t"), F.col("end_t"), F.col("end_t") - F.col("start_t"))
    parts = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_t", text.alias("text")))).alias("_p"))
    return parts.select(*keys, F.array_join(F.transform("_p", lambda p: p["text"]), " → ").alias("summary"))
