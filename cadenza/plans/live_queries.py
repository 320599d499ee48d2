"""Streams over the events table, read as a file stream, and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import triggers
from cadenza.plans.registry import query
from cadenza.plans.walks_queries import GAP, SUPPRESSED
from cadenza.session import scratch_path
from cadenza.streaming import live

KINDS = "CASE event_type WHEN 'click' THEN 'beat' WHEN 'view' THEN 'onset' WHEN 'purchase' THEN 'kick' WHEN 'signup' THEN 'snare' ELSE 'hihat' END"


def events(v):
    """The events table as a stream of files."""
    schema = v.table("events").schema
    raw = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def trigger_stream(v):
    rows = events(v).select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), "ts", (F.unix_micros("ts") / 1e6 - 1704067200.0).alias("t"),
        F.expr(KINDS).alias("trigger_type"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("base_strength"))
    return triggers.gate(rows).withColumn("rank", triggers.type_rank(F.col("trigger_type")))


MARK = "(SELECT epoch_ms(max(ts)) / 1000e0 - 1704067200e0 FROM events)"


@query("r01_throttled_triggers", f"""
WITH RECURSIVE {SUPPRESSED}, m AS (SELECT max(t) AS mark FROM gated)
SELECT track_id, seq, round(t, 6) AS t, trigger_type, round(strength, 6) AS strength FROM cuts, m WHERE t + {GAP} <= floor(mark * 1000) / 1000""")
def _(v):
    out = live.run_to_end(live.throttle(trigger_stream(v), GAP), scratch_path(v.spark, "throttle"))
    return out.select("track_id", "seq", F.round("t", 6).alias("t"), "trigger_type", F.round("strength", 6).alias("strength"))


@query("r02_new_content_on_arrival", """
SELECT DISTINCT CAST(floor(value) AS BIGINT) AS content FROM events WHERE floor(value) NOT IN (SELECT p_size FROM part)""")
def _(v):
    arrivals = events(v).select(F.floor("value").alias("content"), "ts")
    known = v.table("part").select(F.col("p_size").cast("bigint").alias("content"))
    out = live.run_to_end(live.new_arrivals(arrivals, known, "content", "40 days"), scratch_path(v.spark, "arrivals"))
    return out.select("content")


@query("r03_energy_windows", """
WITH s AS (SELECT user_id AS track_id, ts, least(value / 100e0, 1e0) AS x FROM events),
w AS (SELECT track_id, x, to_timestamp((CAST(floor(epoch_ms(ts) / 21600000) AS BIGINT) - k) * 21600)::TIMESTAMP AS start FROM s, (VALUES (0), (1)) h(k)),
g AS (SELECT track_id, start, sqrt(avg(x * x)) AS rms, count(*) AS n FROM w GROUP BY track_id, start)
SELECT track_id, CAST(epoch(start) AS BIGINT) AS start_s, round(rms, 6) AS rms, n, CASE WHEN rms < 0.33e0 THEN 'low' WHEN rms < 0.66e0 THEN 'medium' ELSE 'high' END AS zone FROM g
WHERE start + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)""")
def _(v):
    samples = events(v).select(F.col("user_id").alias("track_id"), "ts", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("value"))
    out = live.run_to_end(live.energy_windows(samples, "12 hours", "6 hours"), scratch_path(v.spark, "windows"))
    return out.select("track_id", F.unix_seconds("start").alias("start_s"), F.round("rms", 6).alias("rms"), "n", "zone")


@query("r04_session_ranges", """
WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id AS clip_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n_uses, round(sum(value), 4) AS duration FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def _(v):
    uses = events(v).select(F.col("user_id").alias("clip_id"), "ts", F.col("value").alias("duration"))
    out = live.run_to_end(live.session_ranges(uses, "6 hours"), scratch_path(v.spark, "sessions"))
    return out.select("clip_id", F.unix_seconds("start").alias("start_s"), "n_uses", F.round("duration", 4).alias("duration"))


@query("r04_usage_statistics", """
SELECT user_id AS clip_id, count(*) AS usage_count, round(avg(value), 6) AS avg_duration, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_used FROM events GROUP BY user_id""")
def _(v):
    path = scratch_path(v.spark, "usage")
    uses = events(v).select(F.col("user_id").alias("clip_id"), F.col("value").alias("duration"), F.col("ts").alias("used_at"))
    stream = (uses.writeStream.foreachBatch(live.usage_writer(v.spark, f"{path}/stats")).option("checkpointLocation", f"{path}/checkpoint")
              .trigger(availableNow=True).start())
    stream.awaitTermination()
    out = live.read_usage(v.spark, f"{path}/stats")
    return out.select("clip_id", "usage_count", F.round("avg_duration", 6).alias("avg_duration"), F.unix_seconds("last_used").alias("last_used"))
