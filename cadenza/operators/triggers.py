"""Triggers: gate, union, thinning, suppression and counts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.beats import beat_seconds, near_downbeat
from cadenza.operators.chain import ANCHOR, KEPT, WalkRule, walk
from cadenza.operators.ordered import Running, row_index, running


@dataclass(frozen=True)
class Gate:
    """Settings of one trigger type; intensity and threshold in percent."""

    intensity: int = 80
    threshold: int = 30
    weight: float = 1.0
    enabled: bool = True


# fixed values: default gate per trigger type, in the order that breaks time ties
GATES: dict[str, Gate] = {
    "beat": Gate(80, 30, 1.0),
    "onset": Gate(60, 40, 0.5),
    "kick": Gate(85, 35, 1.2),
    "snare": Gate(85, 35, 1.0),
    "hihat": Gate(50, 45, 0.3),
    "energy": Gate(100, 50, 1.5),
}
# fixed values: base strength per trigger type, 0.6 for others
BASE_STRENGTHS = {"beat": 0.8, "onset": 0.6, "kick": 0.7, "snare": 0.7, "hihat": 0.5, "energy": 1.0, "bass": 0.65}
MIN_CUT_INTERVAL = 2.0
LONG_TRACK_SECONDS = 1800.0
LONG_TRACK_KEEP_EVERY = 4
MIN_BEAT_SECONDS = 0.01


def _by_type(kind: Column, gates: Mapping[str, Gate], field: str) -> Column:
    out = F.lit(getattr(Gate(), field))
    for name, gate in gates.items():
        out = F.when(kind == name, F.lit(getattr(gate, field))).otherwise(out)
    return out


def base_strength(kind: Column) -> Column:
    out = F.lit(0.6)
    for name, value in BASE_STRENGTHS.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def gate(df: DataFrame, strength: str = "base_strength", gates: Mapping[str, Gate] = GATES) -> DataFrame:
    """Rows that pass their type's threshold, with `strength` scaled and `raw_strength`.

    A value that is not finite passes and counts as 0.5.
    """
    raw = F.col(strength)
    kind = F.col("trigger_type")
    threshold = _clamp(_by_type(kind, gates, "threshold") / 100.0)
    passes = F.when(F.isnan(raw), F.lit(True)).otherwise(_clamp(raw) >= threshold)
    exponent = 2.0 - _clamp(_by_type(kind, gates, "intensity") / 100.0)
    base = F.when(_finite(raw), _clamp(raw)).otherwise(F.lit(0.5))
    scaled = F.pow(base, exponent) * _by_type(kind, gates, "weight")
    kept = df.filter(_by_type(kind, gates, "enabled") & passes & raw.isNotNull())
    return kept.withColumn("raw_strength", raw).withColumn("strength", scaled)


def type_rank(kind: Column) -> Column:
    out = F.lit(len(GATES))
    for i, name in enumerate(GATES):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def in_window(df: DataFrame, start: float | None, end: float | None, time: str = "t") -> DataFrame:
    """start <= t < end; an open side is None."""
    if start is not None:
        df = df.filter(F.col(time) >= start)
    if end is not None:
        df = df.filter(F.col(time) < end)
    return df


def on_downbeat(df: DataFrame, time: str = "t", bpm: str = "bpm", offset: str = "offset") -> DataFrame:
    return df.filter(near_downbeat(F.col(time), beat_seconds(F.col(bpm)), F.col(offset)))


def suppress_close(df: DataFrame, min_interval: float | None = None, width: float | None = None,
                   keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """First cut of each stretch, replaced by a stronger one that follows within the interval."""
    interval = min_interval or MIN_CUT_INTERVAL
    ranked = df.withColumn("_rank", type_rank(F.col("trigger_type")))
    walked = walk(ranked, keys, ["t", "_rank", "seq"], "strength", interval, WalkRule("stronger", interval), width)
    return walked.filter(KEPT).drop(KEPT, ANCHOR, "_rank")


def merge_hits(df: DataFrame, tolerance: float = 0.05, width: float | None = None,
               keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(keys, t, strength): hits within the tolerance of the first one become one, with the greatest strength."""
    walked = walk(df, keys, ["t", "seq"], "strength", tolerance, WalkRule("first", tolerance, strict=True), width)
    return walked.groupBy(*keys, F.col(ANCHOR).alias("t")).agg(F.max("strength").alias("strength"))


def keep_spaced(df: DataFrame, min_gap: float, order: tuple[str, ...] = ("t", "seq"), width: float | None = None,
                keys: tuple[str, ...] = ("track_id",), strict: bool = False) -> DataFrame:
    """Greedy from the start: keep a row at least `min_gap` after the last kept one."""
    with_zero = df.withColumn("_zero", F.lit(0.0))
    walked = walk(with_zero, keys, list(order), "_zero", min_gap, WalkRule("first", min_gap, strict=strict), width)
    return walked.filter(KEPT).drop(KEPT, ANCHOR, "_zero")


def decimate_long(df: DataFrame, tracks: DataFrame, width: float | None = None) -> DataFrame:
    """Every 4th trigger per type on tracks longer than 30 minutes."""
    numbered = row_index(df, ["track_id", "trigger_type"], ["t", "seq"], "_i", width)
    joined = numbered.join(tracks.select("track_id", F.col("duration").alias("_duration")), "track_id", "left")
    long_track = F.coalesce(F.col("_duration") > LONG_TRACK_SECONDS, F.lit(False))
    return joined.filter(~long_track | (F.col("_i") % LONG_TRACK_KEEP_EVERY == 0)).drop("_i", "_duration")


def extrapolate_beats(beats: DataFrame, tracks: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Grid beats from the last known beat to the end of the track, end excluded; as many as fit."""
    last = beats.groupBy(*keys).agg(F.max("t").alias("last_beat"))
    step = F.lit(60.0) / F.col("bpm")
    joined = last.join(tracks, list(keys)).filter(
        (F.col("bpm") > 0) & _finite(F.col("bpm")) & (step >= MIN_BEAT_SECONDS) & (F.col("duration") > F.col("last_beat")))
    room = F.col("duration") - F.col("last_beat")
    count = (F.floor(room / step) + 1).cast("bigint")
    steps = joined.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), count)))
    out = steps.withColumn("t", F.col("last_beat") + F.col("k") * step).filter(F.col("t") < F.col("duration"))
    return out.select(*keys, F.col("k").cast("bigint").alias("k"), "t")


def counts_by_type(cuts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count and percent of the total per trigger type."""
    counts = cuts.groupBy(*keys, "trigger_type").agg(F.count(F.lit(1)).alias("n"))
    # one row per type and group is left here, so the window stays small
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def tempo(beats: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """60 / mean interval. The intervals telescope, so no ordering is needed."""
    span = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_beats"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    mean = (F.col("_b") - F.col("_a")) / (F.col("n_beats") - 1)
    bpm = F.when((F.col("n_beats") >= 2) & (F.col("_b") > F.col("_a")), F.lit(60.0) / mean)
    return span.select(*keys, "n_beats", bpm.alias("bpm"))


def union_typed(lists: Mapping[str, DataFrame], boost: Mapping[str, float] | None = None) -> DataFrame:
    """(track_id, t, trigger_type, strength) of several lists; boosted strengths stay in [0, 1]."""
    out = None
    for kind, df in lists.items():
        s = F.col("strength")
        if boost and kind in boost:
            s = _clamp(s * boost[kind])
        part = df.select("track_id", "t", F.lit(kind).alias("trigger_type"), s.alias("strength"))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_times(df: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    return df.select(*keys, "t").distinct()


def cuts_from_lists(tracks: DataFrame, lists: Mapping[str, str], gates: Mapping[str, Gate] = GATES,
                    base: Mapping[str, float] | None = None) -> DataFrame:
    """One gated row per entry of the time arrays named in `lists` (type -> array column)."""
    stacked = F.array(*[
        F.struct(F.lit(kind).alias("trigger_type"), F.lit((base or {}).get(kind, 1.0)).alias("base_strength"),
                 F.col(column).alias("times")) for kind, column in lists.items()
    ])
    typed = tracks.select("track_id", F.inline(stacked))
    rows = typed.select("track_id", "trigger_type", "base_strength", F.posexplode("times").alias("seq", "t"))
    return gate(rows, gates=gates)


def drops_of(curve: DataFrame, percentile: DataFrame, value: str, min_gap: int, keys: tuple[str, ...] = ("track_id",),
             width: float | None = None) -> DataFrame:
    """Rises of a series above a per-group threshold, spaced by `min_gap` rows.

    `curve` has `diff` and `idx`; `percentile` has `threshold` per group. The
    strength is the rise relative to the greatest rise.
    """
    joined = curve.join(percentile, list(keys), "left")
    top = curve.groupBy(*keys).agg(F.max("diff").alias("_top"))
    limit = F.coalesce(F.col("threshold"), F.lit(0.1))
    hits = joined.filter(F.col("diff") > limit)
    kept = keep_spaced(hits, float(min_gap), ("idx",), width, keys)
    return kept.join(top, list(keys)).withColumn("strength", F.col("diff") / (F.col("_top") + 1e-10)).drop("_top", "threshold")


def rises(curve: DataFrame, value: str, keys: tuple[str, ...] = ("track_id",), time: str = "t",
          width: float | None = None) -> DataFrame:
    """`idx` and `diff` to the previous value, 0 for the first."""
    seen = running(curve, keys, [time], [Running("_before", "last", F.col(value)), Running("idx", "count", F.lit(1))], width)
    return seen.withColumn("diff", F.coalesce(F.col(value) - F.col("_before"), F.lit(0.0))).drop("_before")
