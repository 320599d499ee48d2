"""Beat-grid arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEATS_PER_BAR = 4
# fixed values: grid steps per beat by division name
DIVISIONS = {"1/1": 1.0, "1/2": 2.0, "1/4": 4.0, "1/8": 8.0, "1/16": 16.0}
DOWNBEAT_SHARE = 0.15


def beat_seconds(bpm: Column, default: float = 0.5) -> Column:
    return F.when(bpm > 0, F.lit(60.0) / bpm).otherwise(F.lit(default))


def snap(t: Column, beat: Column, offset: Column, mode: str = "beat", division: str = "1/1",
         beats_per_bar: int = BEATS_PER_BAR) -> Column:
    """Nearest grid time, not below 0; ties go to the even grid line."""
    if mode == "none":
        return t
    if mode not in ("beat", "downbeat", "subdivision"):
        return F.greatest(F.lit(0.0), t)
    step = {"beat": beat, "downbeat": beat * beats_per_bar, "subdivision": beat / DIVISIONS.get(division, 1.0)}[mode]
    return F.greatest(F.lit(0.0), F.rint((t - offset) / step) * step + offset)


def beat_position(t: Column, beat: Column, offset: Column) -> tuple[Column, Column]:
    """(beat number, seconds into the beat)."""
    rel = t - offset
    return (rel / beat).cast("bigint"), F.pmod(rel, beat)


def bar_position(t: Column, beat: Column, offset: Column, beats_per_bar: int = BEATS_PER_BAR) -> tuple[Column, Column, Column]:
    """(bar number, beat in bar, seconds into the beat)."""
    rel, bar = t - offset, beat * beats_per_bar
    in_bar = F.pmod(rel, bar)
    return (rel / bar).cast("bigint"), (in_bar / beat).cast("bigint"), F.pmod(in_bar, beat)


def near_downbeat(t: Column, beat: Column, offset: Column) -> Column:
    """Within 15 % of a beat of a bar line, on either side."""
    bar, tolerance = beat * BEATS_PER_BAR, beat * DOWNBEAT_SHARE
    dist = F.pmod(t - offset, bar)
    return (dist < tolerance) | (dist > bar - tolerance)


def step_seconds(beat: Column, steps_per_beat: int = 4) -> Column:
    return beat / steps_per_beat
