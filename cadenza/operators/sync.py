"""Agreement of cuts, beats and motion peaks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.local import resolve
from cadenza.operators.timejoin import band, nearest, with_factor
from cadenza.operators.triggers import keep_spaced

TOLERANCE_MS = 200.0
TIMING_WEIGHT, STRENGTH_WEIGHT = 0.7, 0.3
# fixed values: upper bounds in ms per sync quality class
QUALITY_LIMITS = {"PERFECT": 50.0, "EXCELLENT": 100.0, "GOOD": 200.0, "ACCEPTABLE": 500.0}
HOOK_BOOST = 1.5


def sync_score(cuts: DataFrame, beats: DataFrame, keys: Sequence[str] = ("track_id",), time: str = "t",
               tolerance_ms: float = TOLERANCE_MS, width: float | None = None) -> DataFrame:
    """Per track: share of cuts near a beat and mean offset, combined 0.6 to 0.4."""
    close = nearest(cuts, beats, keys, time, "t", width=width)
    off = F.col("distance") * 1000.0
    stats = close.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cuts"), F.count_if(F.col("distance") <= tolerance_ms / 1000.0).alias("matched_cuts"),
        F.avg(off).alias("average_offset_ms"), F.max(off).alias("max_offset_ms"))
    ratio = F.col("matched_cuts") / F.col("total_cuts")
    timing = F.greatest(F.lit(0.0), 1.0 - F.col("average_offset_ms") / (tolerance_ms * 2))
    scored = stats.withColumn("match_ratio", ratio).withColumn("timing_score", F.coalesce(timing, F.lit(0.0)))
    score = F.when(F.col("average_offset_ms").isNull(), F.lit(0.0)).otherwise(0.6 * F.col("match_ratio") + 0.4 * F.col("timing_score"))
    return scored.withColumn("score", score).withColumn(
        "quality", F.when(score >= 0.9, "EXCELLENT").when(score >= 0.7, "GOOD").otherwise("ACCEPTABLE"))


def boost_at_hooks(triggers: DataFrame, hooks: DataFrame, radius: float = 0.5, factor: float = HOOK_BOOST,
                   keys: Sequence[str] = ("track_id",), width: float | None = None) -> DataFrame:
    """Strength raised by closeness to the nearest hook, kept in [0, 1]."""
    close = nearest(triggers, hooks, keys, "t", "t", width=width)
    boost = 1.0 + (factor - 1.0) * (1.0 - F.col("distance") / radius)
    raised = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength") * boost))
    boosted = F.when(F.col("distance") < radius, raised).otherwise(F.col("strength"))
    return close.withColumn("strength", boosted).drop("near", "distance")


def merge_without_close(primary: DataFrame, *others: tuple[DataFrame, float], keys: Sequence[str] = ("track_id",),
                        width: float | None = None) -> DataFrame:
    """Primary rows, then rows of each further list that are not within its
    tolerance of anything kept so far, its own rows included."""
    kept = primary
    for rows, tolerance in others:
        near = nearest(rows, kept.select(*keys, "t"), keys, "t", "t", width=width)
        free = near.filter(F.col("distance").isNull() | (F.col("distance") >= tolerance)).select(*rows.columns)
        kept = kept.unionByName(keep_spaced(free, tolerance, width=width, keys=tuple(keys)))
    return kept


def snap_to_suggestions(cuts: DataFrame, points: DataFrame, zones: DataFrame, keys: Sequence[str] = ("track_id",),
                        within: float = 2.0, boost: float = 1.2, width: float = 60.0, chunk: float | None = None) -> DataFrame:
    """Cuts moved to a suggested point closer than `within`, boosted there and
    in every quality zone (start_t, end_t, quality; ends included)."""
    close = nearest(cuts, points, keys, "t", "t", width=chunk)
    marked = with_factor(close, zones, keys, "t", "start_t", "end_t", 1.0 + F.col("quality") * 0.5, width, closed_end=True, name="_factor", count="_zones")
    near = F.coalesce(F.col("distance") < within, F.lit(False))
    kind = F.when(F.col("_zones") > 0, F.lit("quality_zone")).when(near, F.lit("ai_enhanced")).otherwise(F.col("trigger_type"))
    return marked.select(
        *[c for c in cuts.columns if c not in ("t", "intensity", "trigger_type")],
        F.when(near, F.col("near")["t"]).otherwise(F.col("t")).alias("t"),
        (F.col("intensity") * F.when(near, F.lit(boost)).otherwise(F.lit(1.0)) * F.col("_factor")).alias("intensity"),
        kind.alias("trigger_type"))


def sync_quality(offset_ms: Column) -> Column:
    out = F.lit("POOR")
    for name, limit in reversed(QUALITY_LIMITS.items()):
        out = F.when(F.abs(offset_ms) < limit, F.lit(name)).otherwise(out)
    return out


def match_beats(beats: DataFrame, peaks: DataFrame, tolerance_ms: float = TOLERANCE_MS, global_offset: float = 0.0,
                key: str = "track_id", block: float = 3600.0) -> DataFrame:
    """One-to-one beat to motion-peak pairs: strongest beat first, best score wins.

    Input rows are (key, seq, t, strength). Ties of strength go to the earlier
    beat, ties of score to the earlier peak.
    """
    tol = tolerance_ms / 1000.0
    both = beats.select(key, F.lit(0).alias("side"), "seq", "t", F.col("strength").cast("double").alias("strength"), F.col("t").alias("at"))
    both = both.unionByName(peaks.select(key, F.lit(1).alias("side"), "seq", "t", F.col("strength").cast("double").alias("strength"),
                                         (F.col("t") - global_offset).alias("at")))
    fields = {f.name: f for f in both.schema.fields}
    names = ["audio_time", "video_time", "offset_ms", "confidence", "beat_strength", "motion_strength"]
    schema = T.StructType([fields[key], T.StructField("beat_seq", fields["seq"].dataType), T.StructField("peak_seq", fields["seq"].dataType),
                           *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("certain", T.BooleanType())])

    def kernel(table: pa.Table, lo: float, hi: float, known_lo: float, known_hi: float) -> pa.Table:
        side, seq, t, s, at = (table.column(c).to_pylist() for c in ("side", "seq", "t", "strength", "at"))
        b = [i for i in range(len(side)) if side[i] == 0]
        m = [i for i in range(len(side)) if side[i] == 1]
        bt, mt = [at[i] for i in b], [at[i] for i in m]
        used = np.zeros(len(m), bool)
        open_times: list[float] = []
        rows: list[tuple] = []
        for k in sorted(range(len(b)), key=lambda k: (-s[b[k]], k)):
            i = b[k]
            sure = at[i] - 2 * tol >= known_lo and at[i] + 2 * tol < known_hi
            sure = sure and not any(abs(o - at[i]) <= 2 * tol for o in open_times)
            if not sure:
                open_times.append(at[i])
            best, pick = -1.0, -1
            for q in range(bisect_left(mt, at[i] - tol * 1.0000001), bisect_right(mt, at[i] + tol * 1.0000001)):
                off = (mt[q] - at[i]) * 1000.0
                if used[q] or abs(off) > tolerance_ms:
                    continue
                score = TIMING_WEIGHT * (1.0 - abs(off) / tolerance_ms) + STRENGTH_WEIGHT * min(s[i], s[m[q]])
                if score > best:
                    best, pick = score, q
            if pick >= 0:
                used[pick] = True
            home = lo <= at[i] < hi
            if home and (pick >= 0 or not sure):
                j = m[pick] if pick >= 0 else None
                rows.append((table.column(key)[i].as_py(), seq[i], seq[j] if j is not None else None, t[i],
                             t[j] if j is not None else None, (at[j] - at[i]) * 1000.0 if j is not None else None, best, s[i],
                             s[j] if j is not None else None, bool(sure)))
        return pa.Table.from_pydict(
            {f.name: [r[k] for r in rows] for k, f in enumerate(schema.fields)},
            schema=pa.schema([(f.name, table.schema.field(key).type if f.name == key else
                               table.schema.field("seq").type if f.name.endswith("_seq") else
                               pa.bool_() if f.name == "certain" else pa.float64()) for f in schema.fields]))

    return resolve(both, [key], "at", ["at", "side", "seq"], max(block, 8 * tol), 8 * tol, kernel, schema)


def sync_summary(points: DataFrame, beats: DataFrame, key: str = "track_id") -> DataFrame:
    """Per track: offsets, score, coverage and the count of each quality class."""
    kinds = [*QUALITY_LIMITS, "POOR"]
    marked = points.withColumn("_q", sync_quality(F.col("offset_ms")))
    stats = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sync"), F.avg(F.abs("offset_ms")).alias("average_offset_ms"),
        F.max(F.abs("offset_ms")).alias("max_offset_ms"),
        *[F.count_if(F.col("_q") == k).alias(f"n_{k.lower()}") for k in kinds])
    counts = beats.groupBy(key).agg(F.count(F.lit(1)).alias("n_beats"))
    joined = counts.join(stats, key, "left").fillna(0, ["n_sync", *[f"n_{k.lower()}" for k in kinds]])
    good = F.col("n_perfect") + F.col("n_excellent") + F.col("n_good")
    return joined.withColumn("sync_score", good / F.col("n_beats")).withColumn("beat_coverage", F.col("n_sync") / F.col("n_beats"))


def global_offset(beats: DataFrame, peaks: DataFrame, resolution: float = 0.01, max_offset: float = 0.5,
                  key: str = "track_id") -> DataFrame:
    """Per track the lag (seconds) that lines up most beat and motion bins.

    Bins are distinct per side; the lowest lag wins a tie; 0 where nothing
    meets or a side has fewer than two events.
    """
    reach = int(round(max_offset / resolution))

    def bins(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, (F.col("t") / resolution).cast("bigint").alias(name)).distinct()

    pairs = band(bins(beats, "a"), bins(peaks, "b"), [key], "a", "b", float(reach))
    lags = pairs.groupBy(key, (F.col("b") - F.col("a")).alias("lag")).agg(F.count(F.lit(1)).alias("n"))
    best = lags.groupBy(key).agg(F.max_by("lag", F.struct(F.col("n"), -F.col("lag"))).alias("lag"))
    sizes = beats.groupBy(key).agg(F.count(F.lit(1)).alias("_nb")).join(
        peaks.groupBy(key).agg(F.count(F.lit(1)).alias("_np")), key, "left")
    enough = (F.col("_nb") >= 2) & (F.coalesce("_np", F.lit(0)) >= 2)
    lag = F.when(enough, F.coalesce("lag", F.lit(0))).otherwise(F.lit(0))
    return sizes.join(best, key, "left").select(key, (lag * resolution).alias("offset"))


def best_clip_start(motion: DataFrame, duration: str, keys: Sequence[str] = ("clip_id",), prefer_strong: bool = True) -> DataFrame:
    """Per clip the motion peak that suits a start: strong and near 15 % of the clip."""
    place = F.greatest(F.lit(0.0), 1.0 - F.abs(2 * F.col("t") / F.col(duration) - 0.3))
    a, b = (0.6, 0.4) if prefer_strong else (0.3, 0.7)
    scored = motion.withColumn("_score", a * F.col("strength") + b * place)
    best = F.max_by(F.struct("t", "_score"), F.struct("_score", -F.col("t")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b")["t"].alias("start_offset"), F.col("_b")["_score"].alias("alignment_score"))
