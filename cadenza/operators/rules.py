"""Pacing rules: conditions as Columns, first match by priority, walks along a time grid.

A condition is anything with `column()`, which returns a boolean Column over
the grid columns t, energy, bpm and offset. Own conditions, scorers and
strategies plug in the same way: they return Columns or DataFrames. Walks visit
times that no grid foresees; a condition in a walk also has `holds()`, the same
test on numpy arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.beats import BEATS_PER_BAR, bar_position, beat_position, beat_seconds
from cadenza.operators.curves import zone
from cadenza.operators.ordered import neighbours
from cadenza.operators.timejoin import lerp
from cadenza.operators.timewalk import walk_time

DOWNBEAT_TOLERANCE = 0.05
# fixed values: the energy zones and their lower limits
ZONE_NAMES = ("low", "medium", "high")
ZONE_LIMITS = (0.33, 0.66)


def zone_of(energy: np.ndarray, limits: Sequence[float] = ZONE_LIMITS) -> np.ndarray:
    """Place of the zone in ZONE_NAMES."""
    return (energy >= limits[0]).astype(int) + (energy >= limits[1])


@dataclass(frozen=True)
class Moments:
    """Visited times of tracks with the energy there; arrays of equal length, nan for null."""

    t: np.ndarray
    energy: np.ndarray
    bpm: np.ndarray
    offset: np.ndarray

    @property
    def beat(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.bpm > 0, 60.0 / self.bpm, 0.5)


class Condition(Protocol):
    def column(self) -> Column: ...

    def holds(self, m: Moments) -> np.ndarray: ...


@dataclass(frozen=True)
class EnergyIs:
    """Energy zone, or bounds of the energy; false without an energy."""

    zone: str | None = None
    low: float | None = None
    high: float | None = None

    def column(self) -> Column:
        e = F.col("energy")
        if self.zone:
            return F.coalesce(zone(e) == self.zone, F.lit(False))
        ok = e.isNotNull()
        if self.low is not None:
            ok = ok & (e >= self.low)
        if self.high is not None:
            ok = ok & (e <= self.high)
        return F.coalesce(ok, F.lit(False))

    def holds(self, m: Moments) -> np.ndarray:
        if self.zone:
            return ~np.isnan(m.energy) & (zone_of(m.energy) == ZONE_NAMES.index(self.zone))
        ok = ~np.isnan(m.energy)
        if self.low is not None:
            ok &= m.energy >= self.low
        if self.high is not None:
            ok &= m.energy <= self.high
        return ok


@dataclass(frozen=True)
class BeatIs:
    """On a downbeat, or on a given beat of the bar; false without a tempo."""

    downbeat: bool = False
    beat_in_bar: int | None = None
    tolerance: float = DOWNBEAT_TOLERANCE

    def column(self) -> Column:
        beat = beat_seconds(F.col("bpm"))
        t, o = F.col("t"), F.col("offset")
        _, in_bar, _ = bar_position(t, beat, o)
        _, into = beat_position(t, beat, o)
        if self.downbeat:
            ok = (in_bar == 0) & (F.abs(into) < self.tolerance)
        elif self.beat_in_bar is not None:
            ok = in_bar == self.beat_in_bar
        else:
            ok = F.lit(True)
        return F.coalesce(ok & F.col("bpm").isNotNull(), F.lit(False))

    def holds(self, m: Moments) -> np.ndarray:
        beat, rel = m.beat, m.t - m.offset
        in_bar = np.trunc(np.mod(rel, beat * BEATS_PER_BAR) / beat)
        ok = ~np.isnan(m.bpm)
        if self.downbeat:
            return ok & (in_bar == 0) & (np.abs(np.mod(rel, beat)) < self.tolerance)
        return ok if self.beat_in_bar is None else ok & (in_bar == self.beat_in_bar)


@dataclass(frozen=True)
class TimeIn:
    start: float = 0.0
    end: float | None = None

    def column(self) -> Column:
        ok = F.col("t") >= self.start
        return ok if self.end is None else ok & (F.col("t") < self.end)

    def holds(self, m: Moments) -> np.ndarray:
        ok = m.t >= self.start
        return ok if self.end is None else ok & (m.t < self.end)


@dataclass(frozen=True)
class Combined:
    """`and`, `or` or `not` (of the first); empty is true."""

    operator: str
    conditions: tuple[Condition, ...] = ()

    def column(self) -> Column:
        parts = [c.column() for c in self.conditions]
        if not parts:
            return F.lit(True)
        if self.operator == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if self.operator == "and" else (out | p)
        return out

    def holds(self, m: Moments) -> np.ndarray:
        parts = [c.holds(m) for c in self.conditions]
        if not parts:
            return np.ones(len(m.t), dtype=bool)
        if self.operator == "not":
            return ~parts[0]
        return np.logical_and.reduce(parts) if self.operator == "and" else np.logical_or.reduce(parts)


@dataclass(frozen=True)
class CutLength:
    """Mean of the bounds, or by energy: the higher, the shorter."""

    low: float = 1.0
    high: float = 3.0
    by_energy: bool = False
    snap: bool = True

    def seconds(self) -> Column:
        if self.by_energy:
            return F.lit(self.high) - F.col("energy") * (self.high - self.low)
        return F.lit((self.low + self.high) / 2)

    def length_of(self, m: Moments) -> np.ndarray:
        if self.by_energy:
            return self.high - m.energy * (self.high - self.low)
        return np.full(len(m.t), (self.low + self.high) / 2)


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Condition
    action: CutLength = field(default_factory=CutLength)
    priority: int = 0


# fixed values: the rule presets
PRESETS = {
    "Beat Synchronization": Rule("Beat Synchronization", BeatIs(downbeat=True), CutLength(), 10),
    "Energy Following": Rule("Energy Following", EnergyIs(zone="high"), CutLength(0.5, 2.0, by_energy=True), 8),
    "Phrase Alignment": Rule("Phrase Alignment", BeatIs(downbeat=True, beat_in_bar=0), CutLength(2.0, 4.0), 7),
    "Duration Constraints": Rule("Duration Constraints", TimeIn(0.0), CutLength(1.0, 4.0), 5),
    "Variety Enforcement": Rule("Variety Enforcement", TimeIn(0.0), CutLength(0.5, 3.0), 6),
}


def scaled(rule: Rule, factor: float) -> Rule:
    """The rule on a time axis that is `factor` times as long: times, tolerances and cut lengths grow, energies stay."""

    def stretch(c: Condition) -> Condition:
        if isinstance(c, BeatIs):
            return replace(c, tolerance=c.tolerance * factor)
        if isinstance(c, TimeIn):
            return replace(c, start=c.start * factor, end=None if c.end is None else c.end * factor)
        if isinstance(c, Combined):
            return replace(c, conditions=tuple(stretch(x) for x in c.conditions))
        return c

    return replace(rule, condition=stretch(rule.condition), action=replace(rule.action, low=rule.action.low * factor, high=rule.action.high * factor))


@dataclass(frozen=True)
class PacingConfig:
    """Settings of the cut pacing, with the presets `fast_cuts` and `smooth_flow`."""

    min_cut_interval: float = 2.0
    diversity_reset: float = 0.75
    continuity_weight: float = 0.6
    variation_cycle: int = 20
    variation_step: float = 0.12
    motion_offset: float = 0.3
    energy_offset: float = 0.2
    adaptive_min_duration: float = 2.0

    @classmethod
    def fast_cuts(cls) -> PacingConfig:
        return cls(min_cut_interval=0.5, variation_cycle=10)

    @classmethod
    def smooth_flow(cls) -> PacingConfig:
        return cls(min_cut_interval=4.0, variation_step=0.05, adaptive_min_duration=4.0)


def evaluate_rules(grid: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Grid with `rule` and `length` of the matching rule of highest priority, null without a match.

    Equal priorities go by the order of the list.
    """
    ordered = sorted(rules, key=lambda r: -r.priority)
    name, length, snap = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(False)
    for r in reversed(ordered):
        hit = r.condition.column()
        name = F.when(hit, r.name).otherwise(name)
        length = F.when(hit, r.action.seconds()).otherwise(length)
        snap = F.when(hit, r.action.snap).otherwise(snap)
    return grid.withColumn("rule", name).withColumn("length", length).withColumn("snap", snap)


def time_grid(tracks: DataFrame, step: float, energy: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """(track_id, i, t, energy, bpm, offset) every `step` seconds of each track.

    Outside the curve the energy is that of its first or last sample. Each
    piece of the curve brings the grid points that lie on it, so the curve is
    put in order and joined, never the grid. Samples without a time are left out.
    """
    size = F.greatest(F.ceil(F.col("duration") / step), F.lit(0)).cast("bigint")
    offset = F.col("offset") if "offset" in tracks.columns else F.lit(0.0).alias("offset")
    rows = tracks.select("track_id", "bpm", offset, "duration", size.alias("_n")).filter("_n > 0")
    grid = ["track_id", "i", "t", "bpm", "offset", "duration"]

    def points(df: DataFrame, low: Column, high: Column) -> DataFrame:
        return df.withColumn("i", F.explode(F.sequence(low, high))).withColumn("t", F.col("i") * F.lit(float(step)))

    first, last = F.lit(0).cast("bigint"), F.col("_n") - 1
    if energy is None:
        return points(rows, first, last).select(*grid).withColumn("energy", F.lit(None).cast("double"))
    curve = energy.filter("t IS NOT NULL").select(F.col("track_id").alias("_track"), F.col("t").cast("double").alias("t"), F.col("energy").cast("double").alias("energy"))
    linked = neighbours(curve, ["_track"], ["t"], ["t", "energy"], width)
    # each sample begins a piece; the first one also ends the piece before the curve
    here = F.struct("t", "energy")
    none = F.lit(None).cast(curve.select(here.alias("_s")).schema["_s"].dataType)
    piece = lambda before, after: F.struct(before.alias("before"), after.alias("after"))
    own = piece(here, F.col("following"))
    pieces = linked.select("_track", F.explode(F.when(F.col("prev").isNull(), F.array(piece(none, here), own)).otherwise(F.array(own))).alias("_p"))
    pieces = pieces.select("_track", F.col("_p.before").alias("before"), F.col("_p.after").alias("after"))
    on = rows.join(pieces, rows["track_id"].eqNullSafe(pieces["_track"]), "left")
    # a place more on each side, as a quotient is rounded; the times themselves decide
    begin, end = F.col("before")["t"], F.col("after")["t"]
    low = F.greatest(first, F.coalesce(F.floor(begin / step) - 1, first))
    high = F.least(last, F.coalesce(F.ceil(end / step) + 1, last))
    spread = points(on.withColumns({"_low": low, "_high": high}).filter("_low <= _high"), F.col("_low"), F.col("_high"))
    inside = spread.filter((begin.isNull() | (begin <= F.col("t"))) & (end.isNull() | (F.col("t") < end)))
    return inside.select(*grid, lerp("t", "energy", True).alias("energy"))


@dataclass(frozen=True)
class RuleWalk:
    """A match emits a cut and goes on at the cut's end, else one `step` later.

    A cut starts at the time of the match or at the next beat, and ends with
    the track at the latest. Labels are places in `rules`.
    """

    rules: tuple[Rule, ...]
    time_step: float

    def step(self, t, value, bpm, offset, duration):
        m = Moments(t, value, bpm, offset)
        label = np.full(len(t), -1)
        for i in sorted(range(len(self.rules)), key=lambda i: -self.rules[i].priority):
            open_ = np.flatnonzero(label < 0)
            if len(open_):
                hit = self.rules[i].condition.holds(Moments(t[open_], value[open_], bpm[open_], offset[open_]))
                label[open_[hit]] = i
        start, length = t.copy(), np.zeros(len(t))
        n = np.trunc(t / m.beat)
        on_beat = np.where(n * m.beat + offset < t, (n + 1) * m.beat + offset, n * m.beat + offset)
        for i, r in enumerate(self.rules):
            mine = np.flatnonzero(label == i)
            length[mine] = r.action.length_of(m)[mine]
            if r.action.snap:
                start[mine] = on_beat[mine]
        end = np.minimum(start + length, duration)
        return label, start, end, np.where(label >= 0, np.maximum(end, np.nextafter(t, np.inf)), t + self.time_step)


def walk_rules(tracks: DataFrame, energy: DataFrame, rules: Sequence[Rule], step: float, width: float | None = None) -> DataFrame:
    """(track_id, t, rule, start_t, end_t): cuts of a walk from the start of each track, first matching rule by priority.

    The walk goes on from the end of each cut, wherever that lies, and `step`
    later where no rule matches. Equal priorities go by the order of the list;
    a rule whose length follows the energy needs one (an energy condition).
    """
    cuts = walk_time(tracks, energy, RuleWalk(tuple(rules), float(step)), width=width)
    names = F.array(*[F.lit(r.name) for r in rules])
    return cuts.select("track_id", "t", F.get(names, F.col("label")).alias("rule"), "start_t", "end_t")
