"""Length of cuts and the part of a clip they show."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.vectors import uniform

FULL_CLIP_QUALITY, SNAP_STRENGTH, SNAP_REACH = 0.85, 0.7, 1.2
# fixed values: seconds before the end of a clip that stay unused, length bounds of a part
SAFETY, MIN_PART, MAX_PART = 0.3, 1.5, 15.0


@dataclass(frozen=True)
class Limits:
    min_duration: float = 2.0
    max_duration: float = 16.0
    phrase_beats: int = 4
    allow_full_clip: bool = True
    max_full_clip: float = 20.0


def phrase_beats(segment: Column, energy: Column, default: int) -> Column:
    return (F.when(segment.isin("intro", "outro"), F.when(energy < 0.4, 16).otherwise(8)).when(segment.isin("drop", "chorus"), 4)
            .when(segment == "verse", 8).when(segment == "bridge", F.when(energy < 0.5, 8).otherwise(4)).otherwise(default))


def energy_factor(energy: Column) -> Column:
    return F.when(energy > 0.8, 0.5).when(energy > 0.6, 0.75).when(energy < 0.3, 1.5).when(energy < 0.5, 1.25).otherwise(1.0)


def dynamic_duration(energy: Column, strength: Column, segment: Column, quality: Column, clip_duration: Column, next_gap: Column,
                     bpm: Column, limits: Limits = Limits()) -> Column:
    """Phrase length by segment and energy, drawn to the next strong trigger; a whole clip on a strong match."""
    tempo = F.greatest(F.lit(30.0), F.least(F.lit(300.0), F.coalesce(bpm, F.lit(120.0))))
    phrase = F.lit(60.0) / tempo * phrase_beats(segment, energy, limits.phrase_beats) * energy_factor(energy)
    drawn = F.when((strength >= SNAP_STRENGTH) & (next_gap < phrase * SNAP_REACH), next_gap).otherwise(phrase)
    bounded = F.greatest(F.lit(limits.min_duration), F.least(drawn, F.lit(limits.max_duration)))
    if not limits.allow_full_clip:
        return bounded
    whole = F.least(clip_duration, F.lit(limits.max_full_clip))
    return F.when((F.coalesce(quality, F.lit(0.5)) >= FULL_CLIP_QUALITY) & (whole >= limits.min_duration), whole).otherwise(bounded)


def adaptive_duration(kind: Column, energy: Column, bpm: Column, kick_base: float = 6.0, other_base: float = 8.0, minimum: float = 2.0) -> Column:
    """Base length by trigger type, shorter with energy, rounded to whole beats (ties to even)."""
    beat = F.when(bpm > 0, F.lit(60.0) / bpm).otherwise(0.5)
    base = F.when(kind == "kick", kick_base).otherwise(other_base) * (1.0 - energy * 0.5)
    return F.greatest(F.lit(minimum), F.rint(base / beat) * beat)


def sub_segment(clip_duration: Column, wanted: Column, strength: Column, key: Column) -> tuple[Column, Column]:
    """(start, duration) of the part of a clip to show.

    The length varies by up to 20 % and the start falls into the first, middle
    or last third with 60, 30 and 10 %; both depend on the key only.
    """
    usable = F.greatest(F.lit(0.5), clip_duration - SAFETY)
    varied = wanted * (0.5 + strength * 0.5) * (0.8 + 0.4 * uniform(key, "length"))
    length = F.greatest(F.lit(MIN_PART), F.least(F.least(F.lit(MAX_PART), usable), varied))
    length = F.least(length, usable)
    room = usable - length
    where = F.concat_ws("|", key, wanted.cast("string"))
    roll, place = uniform(where, "third"), uniform(where, "place")
    lo = F.when(roll < 0.6, 0.0).when(roll < 0.9, 0.33).otherwise(0.66)
    hi = F.when(roll < 0.6, 0.33).when(roll < 0.9, 0.66).otherwise(1.0)
    start = F.when(room > 0.5, F.round(room * (lo + (hi - lo) * place), 2)).otherwise(0.0)
    fits = usable > wanted
    return F.when(fits, start).otherwise(0.0), F.when(fits, F.round(length, 2)).otherwise(usable)
