"""Processing state, usage statistics and their merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordered import row_index

# fixed values: analyses with their flag, in report order
FLAGS = {
    "colors": "colors_analyzed", "motion": "motion_analyzed", "scene": "scene_analyzed", "mood": "mood_analyzed",
    "objects": "objects_analyzed", "style": "style_analyzed", "fingerprint": "fingerprint_created", "vector": "vector_extracted",
}
# fixed values: current version per versioned analysis
CURRENT_VERSIONS = {"colors": 1, "motion": 1, "scene": 1, "mood": 1, "objects": 1, "style": 1}
ALL = tuple(FLAGS)
STATISTICS_SET = ("colors", "motion", "scene", "mood", "style", "fingerprint")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(FLAGS[name]), F.lit(False))


def missing_analyses(required: Sequence[str] = ALL) -> Column:
    return F.array_compact(F.array(*[F.when(~_flag(n), F.lit(n)) for n in required]))


def fully_analyzed(required: Sequence[str] = ALL) -> Column:
    return F.size(missing_analyses(required)) == 0


def outdated_analyses(current: Mapping[str, int] = CURRENT_VERSIONS) -> Column:
    """Names of analyses whose stored version is behind; a missing version is 0."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(f"{n}_version"), F.lit(0)) < v, F.lit(n)) for n, v in current.items()]))


def unanalyzed(clips: DataFrame, status: DataFrame, required: Sequence[str] = STATISTICS_SET) -> DataFrame:
    """Clips marked for analysis, and available ones whose status is absent or incomplete."""
    flags = [FLAGS[n] for n in required]
    joined = clips.join(status.select("clip_id", *flags, F.lit(True).alias("_has")), "clip_id", "left")
    open_work = F.col("_has").isNull()
    for f in flags:
        open_work = open_work | ~F.coalesce(F.col(f), F.lit(True))
    pick = F.coalesce(F.col("needs_reanalysis"), F.lit(False)) | (F.coalesce(F.col("is_available"), F.lit(False)) & open_work)
    return joined.filter(pick).select(*clips.columns)


def statistics(clips: DataFrame, status: DataFrame, required: Sequence[str] = STATISTICS_SET,
               counted: Sequence[str] = ("colors", "motion", "scene", "mood", "objects", "style")) -> DataFrame:
    """One row: available clips, fully analysed, pending, percent, and a count per analysis."""
    done = F.lit(True)
    for n in required:
        done = done & _flag(n)
    parts = clips.select(F.when(F.col("is_available"), 1).alias("_clip"), F.lit(None).cast("int").alias("_full"),
                         *[F.lit(None).cast("int").alias(f"_{n}") for n in counted])
    parts = parts.unionByName(status.select(F.lit(None).cast("int").alias("_clip"), F.when(done, 1).alias("_full"),
                                            *[F.when(_flag(n), 1).alias(f"_{n}") for n in counted]))
    out = parts.agg(F.count("_clip").alias("total_clips"), F.count("_full").alias("fully_analyzed"),
                    *[F.count(f"_{n}").alias(f"{n}_count") for n in counted])
    total, full = F.col("total_clips"), F.col("fully_analyzed")
    return out.withColumn("pending", total - full).withColumn(
        "percentage", F.when(total > 0, F.round(full * 100.0 / total, 1)).otherwise(F.lit(0.0)))


def catalog_counts(clips: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    analyzed = F.count_if(F.col("needs_reanalysis") == F.lit(False))
    available = F.count_if("is_available")
    return clips.agg(total.alias("total_clips"), analyzed.alias("analyzed"), (total - analyzed).alias("unanalyzed"),
                     available.alias("available"), (total - available).alias("unavailable"))


def needs_analysis_count(clips: DataFrame) -> DataFrame:
    return clips.agg(F.count_if(F.coalesce(F.col("needs_reanalysis"), F.lit(True))).alias("n"))


def breakdown(clips: DataFrame, status: DataFrame, required: Sequence[str] = ALL) -> DataFrame:
    """(level, n, percent): flagged clips, and all clips by state of analysis."""
    state = status.select("clip_id", fully_analyzed(required).alias("_full"))
    joined = clips.join(state, "clip_id", "left")
    level = F.when(F.col("_full").isNull(), "no_record").when(F.col("_full"), "full").otherwise("partial")
    levels = F.array_compact(F.array(level, F.when(F.col("needs_reanalysis"), "flagged"), F.lit("total")))
    return joined.select(F.explode(levels).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, level: str) -> DataFrame:
    """(level, n, percent of the total)."""
    from pyspark.sql import Window

    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    # one row per level is left here
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def apply_status_events(status: DataFrame, events: DataFrame, current: Mapping[str, int] = CURRENT_VERSIONS) -> DataFrame:
    """State after a batch of (clip_id, analysis, success, happened): the last event per analysis counts.

    Clips without a row are added; versioned analyses get the current version.
    """
    known = events.filter(F.col("analysis").isin(list(FLAGS)))
    last = known.groupBy("clip_id").agg(*[
        F.max_by(F.when(F.col("analysis") == n, F.col("success")), F.when(F.col("analysis") == n, F.col("happened"))).alias(f"_{n}") for n in FLAGS])
    joined = status.join(last, "clip_id", "full")
    new: dict[str, Column] = {}
    for n, flag in FLAGS.items():
        old = F.col(flag) if flag in status.columns else F.lit(None).cast("boolean")
        new[flag] = F.coalesce(f"_{n}", old, F.lit(False))
    for n, v in current.items():
        if f"{n}_version" in status.columns:
            new[f"{n}_version"] = F.when(F.col(f"_{n}").isNotNull(), F.lit(v)).otherwise(F.coalesce(f"{n}_version", F.lit(0)))
    return joined.withColumns(new).drop(*[f"_{n}" for n in FLAGS])


def reset(status: DataFrame, clips: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(status, clips) with flags and versions cleared and re-analysis wanted; all rows without ids."""
    def marked(df: DataFrame) -> DataFrame:
        if ids is None:
            return df.withColumn("_reset", F.lit(True))
        return df.join(ids.select("clip_id").distinct().withColumn("_reset", F.lit(True)), "clip_id", "left")

    hit = F.coalesce(F.col("_reset"), F.lit(False))
    cleared = marked(status).withColumns({
        **{f: F.col(f) & ~hit for f in FLAGS.values() if f in status.columns},
        **{c: F.when(hit, 0).otherwise(F.col(c)) for c in status.columns if c.endswith("_version")},
        **({"last_full_analysis": F.when(~hit, F.col("last_full_analysis"))} if "last_full_analysis" in status.columns else {})})
    wanted = marked(clips).withColumn("needs_reanalysis", F.col("needs_reanalysis") | hit)
    return cleared.drop("_reset"), wanted.drop("_reset")


def mark_complete(status: DataFrame, clips: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(status, clips) after a full analysis of the given clips."""
    done = ids.select("clip_id").distinct().withColumn("_done", F.lit(True))
    s = status.join(done, "clip_id", "left").withColumn("last_full_analysis", F.when(F.col("_done"), now).otherwise(
        F.col("last_full_analysis") if "last_full_analysis" in status.columns else F.lit(None).cast("timestamp"))).drop("_done")
    c = clips.join(done, "clip_id", "left").withColumn("needs_reanalysis", F.col("needs_reanalysis") & F.col("_done").isNull()).drop("_done")
    return s, c


def repair_status(status: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Status with flags that stored hashes or vectors imply, and `repaired`."""
    facts = fingerprints.groupBy("clip_id").agg(
        F.bool_or(F.col("phash").isNotNull() | F.col("dhash").isNotNull()).alias("_hash"), F.bool_or(F.col("vector_file").isNotNull()).alias("_vec"))
    joined = status.join(facts, "clip_id", "left")
    h, x = F.coalesce("_hash", F.lit(False)), F.coalesce("_vec", F.lit(False))
    repaired = (h & ~F.col("fingerprint_created")) | (x & ~F.col("vector_extracted"))
    return joined.withColumns({"repaired": repaired, "fingerprint_created": F.col("fingerprint_created") | h,
                               "vector_extracted": F.col("vector_extracted") | x}).drop("_hash", "_vec")


def merge_usage(stats: DataFrame | None, batch: DataFrame, order: Sequence[str], halving: bool = False, width: float | None = None,
                key: str = "clip_id") -> DataFrame:
    """(key, usage_count, avg_duration, last_used) after a batch of (key, duration, used_at).

    avg_duration is the mean over all uses. With `halving` it follows the rule
    avg := (avg + x) / 2 per use: use number r from the end weighs 2^-(r+1),
    the very first value of a key twice that.
    """
    if halving:
        numbered = row_index(batch, [key], order, "_i", width)
        size = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        rows = numbered.join(size, key)
        from_end = F.col("_n") - 1 - F.col("_i")
        weight = F.pow(F.lit(2.0), -(from_end + 1).cast("double"))
        if stats is None:
            weight = F.when(F.col("_i") == 0, weight * 2).otherwise(weight)
        else:
            rows = rows.join(stats.select(key, F.lit(True).alias("_old")), key, "left")
            weight = F.when((F.col("_i") == 0) & F.col("_old").isNull(), weight * 2).otherwise(weight)
        rows = rows.withColumn("_x", F.col("duration") * weight)
    else:
        rows = batch.withColumn("_x", F.col("duration"))
    new = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"), F.sum("_x").alias("_sum"), F.max("used_at").alias("_last"))
    if stats is None:
        mean = F.col("_sum") if halving else F.col("_sum") / F.col("_uses")
        return new.select(key, F.col("_uses").alias("usage_count"), mean.alias("avg_duration"), F.col("_last").alias("last_used"))
    both = stats.join(new, key, "full")
    n0, n1 = F.coalesce("usage_count", F.lit(0)), F.coalesce("_uses", F.lit(0))
    if halving:
        old = F.coalesce(F.col("avg_duration") * F.pow(F.lit(2.0), -n1.cast("double")), F.lit(0.0))
        mean = old + F.coalesce("_sum", F.lit(0.0))
    else:
        mean = (F.coalesce("avg_duration", F.lit(0.0)) * n0 + F.coalesce("_sum", F.lit(0.0))) / (n0 + n1)
    return both.select(key, (n0 + n1).alias("usage_count"), mean.alias("avg_duration"), F.coalesce("_last", "last_used").alias("last_used"))


def last_write_wins(stored: DataFrame | None, writes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Latest values per key; stored rows stay where nothing was written."""
    rest = [c for c in writes.columns if c not in keys]
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(*keys, "_r.*")
    if stored is None:
        return last
    return stored.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def run_sql(tables: Mapping[str, DataFrame], text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """SQL over the given tables with named parameters (`:name`)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=dict(args or {}))
