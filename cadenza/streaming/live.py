"""Keyed stream forms of suppression, new-content detection, energy windows and usage statistics.

All take a streaming DataFrame with an event-time column and return a
streaming DataFrame (or a `foreachBatch` writer), so the caller picks trigger,
sink and checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.curves import zone
from cadenza.operators.state import merge_usage

CUT_SCHEMA = "track_id bigint, seq bigint, t double, trigger_type string, strength double"
_STATE = "t double, s double, seq bigint, kind string, wait_t array<double>, wait_s array<double>, wait_seq array<bigint>, wait_kind array<string>, wait_rank array<int>"


def throttle(triggers: DataFrame, interval: float, delay: str = "0 seconds", time: str = "ts") -> DataFrame:
    """Close-cut suppression of a gated trigger stream, per track, in append mode.

    Input: track_id, seq, ts (event time), t (the same instant in seconds), rank
    (tie order), trigger_type, strength. Rows wait until the watermark has
    passed them, so disorder within `delay` does not matter; a cut is returned
    when no later row can replace it. State per track: one open cut and the
    rows ahead of the watermark.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            ct, cs, cseq, ckind, *lists = state.get
            waiting = list(zip(*[list(x) for x in lists]))
        else:
            ct, cs, cseq, ckind, waiting = None, None, None, None, []
        waiting = [(t, s, q, k, r) for t, s, q, k, r in waiting]
        for f in frames:
            waiting.extend(zip(f["t"].tolist(), f["strength"].tolist(), f["seq"].tolist(), f["trigger_type"].tolist(), f["rank"].tolist()))
        mark = state.getCurrentWatermarkMs() / 1000.0
        waiting.sort(key=lambda w: (w[0], w[4], w[2]))
        done: list[tuple] = []
        ready = [w for w in waiting if w[0] + shift <= mark]
        waiting = waiting[len(ready):]
        for t, s, q, k, _ in ready:
            if ct is None or t - ct >= interval:
                if ct is not None:
                    done.append((key[0], cseq, ct, ckind, cs))
                ct, cs, cseq, ckind = t, s, q, k
            elif s > cs:
                ct, cs, cseq, ckind = t, s, q, k
        if ct is not None and ct + interval + shift <= mark:
            done.append((key[0], cseq, ct, ckind, cs))
            ct = cs = cseq = ckind = None
        if ct is None and not waiting:
            state.remove()
        else:
            cols = list(zip(*waiting)) if waiting else [[], [], [], [], []]
            state.update((ct, cs, cseq, ckind, list(cols[0]), list(cols[1]), list(cols[2]), list(cols[3]), list(cols[4])))
            due = [w[0] for w in waiting[:1]] + ([ct + interval] if ct is not None else [])
            state.setTimeoutTimestamp(max(int((min(due) + shift) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["track_id", "seq", "t", "trigger_type", "strength"])

    # t counts from an epoch of its own; the watermark counts from 1970
    shift = EPOCH
    keyed = triggers.withWatermark(time, delay).groupBy("track_id")
    return keyed.applyInPandasWithState(step, CUT_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


# fixed value: start of the time axis t in unix seconds (2024-01-01)
EPOCH = 1_704_067_200.0


def new_arrivals(arrivals: DataFrame, catalog: DataFrame, fingerprint: str, delay: str, time: str = "ts") -> DataFrame:
    """Arriving content that the static catalog does not have, once within the delay."""
    once = arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([fingerprint])
    return once.join(catalog.select(fingerprint).distinct(), fingerprint, "left_anti")


def energy_windows(samples: DataFrame, window: str, hop: str, delay: str = "0 seconds", time: str = "ts", value: str = "value",
                   key: str = "track_id") -> DataFrame:
    """RMS level per key and hopping window, with its zone; a window is returned when it has closed."""
    framed = samples.withWatermark(time, delay).groupBy(key, F.window(time, window, hop))
    rms = framed.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return rms.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rms", "n", zone(F.col("rms")).alias("zone"))


def session_ranges(uses: DataFrame, gap: str, delay: str = "0 seconds", time: str = "ts", key: str = "clip_id") -> DataFrame:
    """Stretches of use without a pause of `gap`, returned when they have closed."""
    sessions = uses.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("n_uses"), F.sum("duration").alias("duration")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_uses", "duration")


USAGE = T.StructType([T.StructField("clip_id", T.LongType()), T.StructField("usage_count", T.LongType()),
                      T.StructField("avg_duration", T.DoubleType()), T.StructField("last_used", T.TimestampType())])


def usage_writer(spark: SparkSession, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that keeps usage statistics in buckets of clips, as Parquet below `path`.

    A batch reads and writes the buckets of its clips only, under its own
    version; a manifest of at most `buckets` rows names the version of each
    bucket. Version n + 1 is version n merged with batch n, so a repeated batch
    gives the same files. Files that neither this nor the previous version
    names are dropped. `read_usage` returns the last version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session, version = batch.sparkSession, batch_id + 1
        bucket = F.pmod(F.xxhash64("clip_id"), F.lit(buckets)).cast("int")
        known = _manifest(session, path, batch_id) if batch_id else {}
        rows = batch.persist()  # the source is read once
        touched = [r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect()]
        if touched:
            stored = _stored(session, path, {k: v for k, v in known.items() if k in set(touched)})
            merged = merge_usage(stored, rows, []).withColumn("bucket", bucket)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
        rows.unpersist()
        now = known | {k: version for k in touched}
        table = session.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
        table.write.mode("overwrite").parquet(f"{path}/manifest/v={version}")
        _drop_unnamed(session, path, version, set(known.items()) | set(now.items()))

    return write


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/v={version}").collect()}


def _stored(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    paths = [f"{path}/data/v={v}/bucket={k}" for k, v in sorted(versions.items())]
    return spark.read.schema(USAGE).parquet(*paths) if paths else spark.createDataFrame([], USAGE)


def _folders(spark: SparkSession, folder: str):
    """(file system, number, path) of the folders `name=number` in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in system.listStatus(where) if system.exists(where) else []:
        name = entry.getPath().getName()
        if "=" in name:
            yield system, int(name.split("=")[1]), entry.getPath()


def _drop_unnamed(spark: SparkSession, path: str, version: int, named: set[tuple[int, int]]) -> None:
    for system, v, folder in list(_folders(spark, f"{path}/data")):
        if v > version:
            continue
        kept = 0
        for _, k, bucket in list(_folders(spark, folder.toString())):
            if (k, v) in named:
                kept += 1
            else:
                system.delete(bucket, True)
        if not kept:
            system.delete(folder, True)
    for system, v, folder in list(_folders(spark, f"{path}/manifest")):
        if v < version - 1:
            system.delete(folder, True)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of the latest version."""
    versions = [v for _, v, _ in _folders(spark, f"{path}/manifest")]
    return _stored(spark, path, _manifest(spark, path, max(versions)) if versions else {})


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available into Parquet and returns the result as a table."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
