"""Interval lists: merging, layout, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordered import Running, running
from cadenza.session import materialize

MERGE_SLACK = 0.5
DURATION_TOLERANCE = 0.01
MAX_CUTS = 10_000
MAX_DURATION = 86_400.0


def merge_ranges(df: DataFrame, keys: Sequence[str], start: str = "start_t", end: str = "end_t",
                 slack: float = MERGE_SLACK, width: float | None = None) -> DataFrame:
    """Union of overlapping or nearly touching intervals per key.

    Equal intervals collapse first, so copies of one range cost one row.
    """
    keys = list(keys)
    ranges = df.groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("_n"))
    reach = running(ranges, keys, [start, end], [Running("_reach", "max", F.col(end))], width)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + slack)
    marked = reach.withColumn("_open", F.when(opens, F.col(start)))
    marked = materialize(marked, "islands") if width else marked
    island = running(marked, keys, [start, end], [Running("_island", "last", F.col("_open"), inclusive=True)], width)
    merged = island.groupBy(*keys, "_island").agg(F.max(end).alias(end), F.sum("_n").alias("n_ranges"))
    return merged.select(*keys, F.col("_island").alias(start), end, "n_ranges")


def with_next_start(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str] = (), total: str | float | None = None,
                    width: float | None = None, name: str = "next_t") -> DataFrame:
    """Time of the next row of the group, or `total` after the last one."""
    out = running(df, keys, [time, *order], [Running(name, "next", F.col(time))], width)
    if total is not None:
        end = F.col(total) if isinstance(total, str) else F.lit(float(total))
        out = out.withColumn(name, F.coalesce(F.col(name), end))
    return out


def violations(cuts: DataFrame, keys: Sequence[str], start: str = "start_t", end: str = "end_t",
               order: Sequence[str] = ("seq",), width: float | None = None) -> DataFrame:
    """Cuts that start before the previous one in `order` ends or starts."""
    row = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    near = running(cuts, keys, list(order), [Running("_prev", "last", row)], width)
    overlap = F.col("_prev")["e"] > F.col(start)
    unordered = F.col("_prev")["s"] > F.col(start)
    bad = near.withColumn("overlaps", overlap).withColumn("out_of_order", unordered).filter("overlaps OR out_of_order")
    return bad.drop("_prev")


def summary_checks(cuts: DataFrame, totals: DataFrame, keys: Sequence[str], end: str = "end_t", total: str = "total") -> DataFrame:
    """Per list: span and count against the declared total and the limits."""
    keys = list(keys)
    span = cuts.groupBy(*keys).agg(F.max(end).alias("span"), F.count(F.lit(1)).alias("n_cuts"))
    joined = totals.select(*keys, total).join(span, keys, "left").withColumn("n_cuts", F.coalesce("n_cuts", F.lit(0)))
    span_ok = F.when(F.col("n_cuts") == 0, F.col(total) == 0).otherwise(F.abs(F.col("span") - F.col(total)) <= DURATION_TOLERANCE)
    return joined.withColumns({"span_ok": span_ok, "count_ok": F.col("n_cuts") <= MAX_CUTS,
                               "duration_ok": F.col(total) <= MAX_DURATION})


def conflicts(new: DataFrame, existing: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Pairs of a new and an existing cut that overlap, through shared time bins.

    A pair is reported from the bin where the later of both starts.
    """
    keys = list(keys)

    def spread(df: DataFrame, prefix: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start_t") / width), F.floor(F.col("end_t") / width))
        return df.select(*keys, F.explode(bins).alias("_bin"),
                         *[F.col(c).alias(prefix + c) for c in ("seq", "start_t", "end_t")])

    pairs = spread(new, "new_").join(spread(existing, "old_"), [*keys, "_bin"])
    clash = (F.col("new_start_t") < F.col("old_end_t")) & (F.col("new_end_t") > F.col("old_start_t"))
    first_bin = F.floor(F.greatest("new_start_t", "old_start_t") / width) == F.col("_bin")
    return pairs.filter(clash & first_bin).drop("_bin")


def conflict_counts(new: DataFrame, existing: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """`new` with n_conflicts, the existing cuts that overlap each: those that start before its end, less those that end by its start.

    Two running counts over chunks of time; no pair of cuts is made. Cuts have a positive length.
    """
    keys = list(keys)

    def counted(asked: DataFrame, at: str, edge: str, inclusive: bool, name: str) -> DataFrame:
        marks = existing.select(*keys, F.col(edge).cast("double").alias("_t"), F.lit(0 if inclusive else 1).alias("_side"), F.lit(1).alias("_one"))
        points = asked.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), F.struct("*").alias("_row"))
        both = running(points.unionByName(marks, allowMissingColumns=True), keys, ["_t", "_side"], [Running(name, "count", F.col("_one"))], width)
        return both.filter(F.col("_row").isNotNull()).select("_row.*", name)

    both = counted(counted(new, "end_t", "start_t", False, "_before"), "start_t", "end_t", True, "_after")
    return both.withColumn("n_conflicts", F.col("_before") - F.col("_after")).drop("_before", "_after")
