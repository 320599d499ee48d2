"""Walks along continuous time: from each visited moment, a curve value there decides where the walk goes on.

A track's time is cut into chunks. All chunks are walked at once, each from a
guessed entry (its start); where a chunk's predecessor then leaves at another
time, the chunk is walked again from there, until no entry changes. The first
chunks of a track are right after the first round, and walks that meet (as
those that snap to beats soon do) agree from then on, so few rounds are needed;
a walk that never meets its guesses takes one round a chunk. The result is that
of the sequential loop, to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize, ship_package


class Stepper(Protocol):
    """What a walk does at times `t` of tracks with these values (arrays of equal length; null numbers are nan)."""

    def step(self, t: np.ndarray, value: np.ndarray, bpm: np.ndarray, offset: np.ndarray, duration: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(label, start, end, next): label -1 emits nothing; next must lie after t."""
        ...


def value_at(t: np.ndarray, before: np.ndarray, times: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Linear interpolation at t, end values outside; `before` is the place of the last sample at or before t, or first - 1."""
    out = np.full(len(t), np.nan)
    some = last > first
    lo, hi = np.clip(before, first, last - 1), np.clip(before + 1, first, last - 1)
    lo, hi = np.where(some, lo, 0), np.where(some, hi, 0)
    if not len(times):
        return out
    t0, t1, v0, v1 = times[lo], times[hi], values[lo], values[hi]
    span = t1 - t0
    inside = some & (before >= first) & (before + 1 < last) & (t0 != t) & (span >= 1e-9)
    flat = np.where(before < first, values[np.where(some, first, 0)], v0)
    with np.errstate(divide="ignore", invalid="ignore"):
        sloped = v0 + (t - t0) / span * (v1 - v0)
    return np.where(some, np.where(inside, sloped, flat), out)


def walk_chunks(stepper: Stepper, entry: np.ndarray, stop: np.ndarray, duration: np.ndarray, bpm: np.ndarray, offset: np.ndarray,
                times: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(exit of each chunk, emitted (chunk, t, label, start, end) in order of time), all chunks a step at a time.

    `times` and `values` hold the samples of all chunks, those of chunk i from
    bounds[i] to bounds[i + 1].
    """
    at, out = entry.copy(), []
    before = bounds[:-1] - 1
    live = np.flatnonzero(at < stop)
    while len(live):
        t, last = at[live], bounds[live + 1]
        while True:
            ahead = before[live] + 1
            move = np.flatnonzero((ahead < last) & (times[np.minimum(ahead, len(times) - 1)] <= t)) if len(times) else ()
            if not len(move):
                break
            before[live[move]] += 1
        value = value_at(t, before[live], times, values, bounds[live], last)
        label, start, end, after = stepper.step(t, value, bpm[live], offset[live], duration[live])
        hit = np.flatnonzero(label >= 0)
        if len(hit):
            out.append((live[hit], t[hit], label[hit], start[hit], end[hit]))
        at[live] = after
        live = live[after < stop[live]]
    return at, out


def _rounds(stepper: Stepper, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            num = lambda c: b.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            lists = b.column("samples")
            bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))])
            flat = lists.flatten()
            times, values = (np.asarray(flat.field(i).fill_null(float("nan")), np.float64) for i in (0, 1))
            left, out = walk_chunks(stepper, num("entry"), num("stop"), num("duration"), num("bpm"), num("offset"), times, values, bounds)
            chunk, t, label, start, end = ([np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0)])
            order = np.argsort(chunk, kind="stable")
            cells = pa.StructArray.from_arrays([pa.array(t[order]), pa.array(label[order].astype(np.int32)), pa.array(start[order]), pa.array(end[order])], names=["t", "label", "start_t", "end_t"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("_chunk"), b.column("entry"), pa.array(left), pa.ListArray.from_arrays(pa.array(ends), cells)],
                                             names=[*keys, "_chunk", "entry", "exit", "cuts"])

    return run


def _chunks(tracks: DataFrame, curve: DataFrame, keys: list[str], value: str, width: float | None) -> DataFrame:
    """(keys, _chunk, start, stop, duration, bpm, offset, samples): each chunk with its samples, the last one before it and the first one after."""
    w = F.lit(float(width)) if width else F.col("duration")
    n = F.greatest(F.ceil(F.col("duration") / w), F.lit(1)).cast("bigint")
    base = tracks.filter(F.col("duration") > 0).select(
        *keys, F.col("duration").cast("double").alias("duration"), F.col("bpm").cast("double").alias("bpm"),
        (F.coalesce(F.col("offset"), F.lit(0.0)) if "offset" in tracks.columns else F.lit(0.0)).cast("double").alias("offset"), n.alias("_n"))
    last = F.col("_n") - 1
    chunk = F.floor(F.col("t") / w).cast("bigint")
    placed = curve.select(*keys, F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("v")).join(base.select(*keys, "duration", "_n"), keys)
    placed = placed.withColumn("_chunk", F.greatest(F.lit(0), F.least(chunk, last)).cast("bigint"))
    own = placed.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("own"), F.min(F.struct("t", "v")).alias("low"), F.max(F.struct("t", "v")).alias("high"))
    cells = base.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    edges = cells.select(*keys, "_chunk").join(own.select(*keys, "_chunk", "low", "high"), [*keys, "_chunk"], "left")
    by = Window.partitionBy(*keys).orderBy("_chunk")  # one row per chunk
    edges = edges.select(*keys, "_chunk", F.last("high", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
                         F.first("low", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<struct<t:double,v:double>>"))
    full = cells.join(edges, [*keys, "_chunk"]).join(own.select(*keys, "_chunk", "own"), [*keys, "_chunk"], "left")
    samples = F.concat(some("prev"), F.coalesce("own", F.array().cast("array<struct<t:double,v:double>>")), some("next"))
    start = F.col("_chunk") * w
    stop = F.when(F.col("_chunk") == last, F.col("duration")).otherwise(start + w)
    return full.select(*keys, "_chunk", start.alias("start"), stop.alias("stop"), "duration", "bpm", "offset", samples.alias("samples"))


def walk_time(tracks: DataFrame, curve: DataFrame, stepper: Stepper, keys: Sequence[str] = ("track_id",), value: str = "energy",
              width: float | None = None, most_rounds: int | None = None) -> DataFrame:
    """(keys, t, label, start_t, end_t) that a walk from 0 to each track's duration emits.

    `tracks`: (keys, duration, bpm, optional offset); `curve`: (keys, t,
    value), interpolated between samples and held outside them (nan without
    any). `width` is the length of a chunk; None walks each track in one. A
    task holds the samples of some chunks, never a track. A stepper may jump
    over whole chunks. `most_rounds` raises where a walk takes more rounds.
    """
    keys = list(keys)
    spark = tracks.sparkSession
    ship_package(spark)
    data = materialize(_chunks(tracks, curve, keys, value, width), "chunks")
    at = [*keys, "_chunk"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*at).schema)
    schema = f"{types}, entry double, exit double, cuts array<struct<t:double,label:int,start_t:double,end_t:double>>"
    pending, latest, rounds = data.select(*at, F.col("start").alias("entry")), None, 0
    while True:
        walked = data.join(pending, at).mapInArrow(_rounds(stepper, keys), schema)
        walked = materialize(walked, "walked")
        if latest is None:
            latest = walked
        else:
            kept = latest.join(walked.select(*at), at, "left_anti")
            latest = materialize(kept.unionByName(walked), "latest")
        if not width:
            break
        handed = latest.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("exit").alias("_new"))
        pending = materialize(latest.select(*at, "entry").join(handed, at).filter("_new <> entry").select(*at, F.col("_new").alias("entry")), "pending")
        rounds += 1
        if not pending.limit(1).count():
            break
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError(f"a walk did not settle in {most_rounds} rounds")
    cuts = latest.select(*keys, F.explode("cuts").alias("c"))
    return cuts.select(*keys, "c.t", "c.label", "c.start_t", "c.end_t")
