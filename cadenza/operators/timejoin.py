"""As-of, nearest, interval and band joins on a time axis inside a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.chain import map_groups
from cadenza.operators.ordered import CHUNK, Borders, Running, add_chunk, running
from cadenza.session import materialize


def asof(
    events: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    event_time: str,
    sample_time: str,
    values: Sequence[str],
    width: float | Borders | None = None,
) -> DataFrame:
    """Each event with `before` (last sample at or before) and `after` (next one).

    Both are structs (t, *values). One union and one chunked window serve both
    directions; no row of either side is paired with more than two of the other.
    """
    keys = list(keys)
    sample = F.struct(F.col(sample_time).cast("double").alias("t"), *[F.col(c) for c in values])
    left = events.select(
        *keys, F.col(event_time).cast("double").alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in events.columns]).alias("_row"),
    )
    right = samples.select(
        *keys, F.col(sample_time).cast("double").alias("_t"), F.lit(0).alias("_side"), sample.alias("_sample")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    filled = running(
        both, keys, ["_t", "_side"],
        [Running("before", "last", F.col("_sample")), Running("after", "next", F.col("_sample"))], width,
    )
    return filled.filter("_side = 1").select("_row.*", "before", "after")


def lerp(time: str, value: str, clamp: bool = False) -> Column:
    """Linear interpolation between `before` and `after`.

    Outside the curve: null, or the end value with `clamp`.
    """
    t, b, a = F.col(time), F.col("before"), F.col("after")
    span = a["t"] - b["t"]
    inside = b[value] + (t - b["t"]) / span * (a[value] - b[value])
    on_sample = b["t"] == t
    edge = F.coalesce(b[value], a[value]) if clamp else F.lit(None).cast("double")
    return (
        F.when(on_sample, b[value])
        .when(b.isNull() | a.isNull(), edge)
        .when(span < 1e-9, b[value])
        .otherwise(inside)
    )


def curve_value(
    events: DataFrame, curve: DataFrame, keys: Sequence[str], event_time: str, curve_time: str,
    values: Sequence[str], clamp: bool = False, width: float | Borders | None = None,
) -> DataFrame:
    """Events with the interpolated curve values, under the curve's column names."""
    found = asof(events, curve, keys, event_time, curve_time, values, width)
    return found.select(*events.columns, *[lerp(event_time, v, clamp).alias(v) for v in values])


def nearest(
    events: DataFrame, points: DataFrame, keys: Sequence[str], event_time: str, point_time: str,
    values: Sequence[str] = (), width: float | Borders | None = None,
) -> DataFrame:
    """Each event with `near` (struct t, *values) of the closest point and `distance`.

    The earlier point wins a tie.
    """
    found = asof(events, points, keys, event_time, point_time, values, width)
    t = F.col(event_time)
    db, da = F.abs(t - F.col("before")["t"]), F.abs(F.col("after")["t"] - t)
    earlier = F.col("after").isNull() | (db <= da)
    return found.select(
        *events.columns,
        F.when(earlier, F.col("before")).otherwise(F.col("after")).alias("near"),
        F.when(earlier, db).otherwise(da).alias("distance"),
    )


def cover(first: Column, last: Column) -> Column:
    """(level, node) pairs that cover the chunk numbers first .. last: node n of level l stands for chunks n * 2^l up to (n + 1) * 2^l - 1."""
    a, b = first.cast("bigint"), last.cast("bigint")
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    levels = F.sequence(F.lit(0), F.ceil(F.log2((b - a + 2).cast("double"))).cast("int"))

    def step(s: Column, level: Column) -> Column:
        odd = (s["a"] <= s["b"]) & (s["a"].bitwiseAND(F.lit(1).cast("bigint")) == 1)
        even = (s["a"] <= s["b"]) & (s["b"].bitwiseAND(F.lit(1).cast("bigint")) == 0)
        one = lambda n: F.array(F.struct(level.alias("level"), n.alias("node")))
        low = F.when(odd, one(s["a"])).otherwise(none)
        high = F.when(even & ~(odd & (s["a"] == s["b"])), one(s["b"])).otherwise(none)
        left, right = F.when(odd, s["a"] + 1).otherwise(s["a"]), F.when(even, s["b"] - 1).otherwise(s["b"])
        done = s["a"] > s["b"]
        return F.struct(F.when(done, s["a"]).otherwise(F.shiftright(left, 1)).alias("a"), F.when(done, s["b"]).otherwise(F.shiftright(right, 1)).alias("b"),
                        F.concat(s["out"], low, high).alias("out"))

    return F.aggregate(levels, F.struct(a.alias("a"), b.alias("b"), none.alias("out")), step, lambda s: s["out"])


def covering_rows(group: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, times: np.ndarray, factors: np.ndarray,
                  closed: np.ndarray, weights: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, product, number) per event: the first (or last) interval of its group that holds its time, by place, -1 where none does;
    the product of the factors of all that do, and the sum of their weights.

    Times of a group become ranks; an interval is a range of ranks and leaves
    its mark on the few nodes of a segment tree that make it up, and an event
    gathers the marks on the way from its rank to the root.
    """
    at, who = np.concatenate([starts, ends, times]), np.concatenate([group, group, of])
    order = np.lexsort((at, who))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[order][1:] != at[order][:-1]) | (who[order][1:] != who[order][:-1])
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new) - 1
    n, size = len(starts), int(new.sum())
    nobody = -1 if last else n
    best, product, number = np.full(2 * size, nobody, np.int64), np.ones(2 * size), np.zeros(2 * size, np.int64)
    place = np.flatnonzero(rank[:n] < rank[n:2 * n] + closed)
    lo, hi = rank[:n][place] + size, (rank[n:2 * n] + closed)[place] + size
    reach = np.maximum if last else np.minimum

    def mark(nodes: np.ndarray, of: np.ndarray) -> None:
        reach.at(best, nodes, of)
        np.multiply.at(product, nodes, factors[of])
        np.add.at(number, nodes, weights[of])

    while len(place):
        odd = (lo & 1).astype(bool)
        mark(lo[odd], place[odd])
        lo = lo + odd
        odd = (hi & 1).astype(bool)
        mark(hi[odd] - 1, place[odd])
        lo, hi = lo >> 1, (hi - odd) >> 1
        open_ = lo < hi
        place, lo, hi = place[open_], lo[open_], hi[open_]
    node = rank[2 * n:] + size
    found, all_, many = np.full(len(times), nobody, np.int64), np.ones(len(times)), np.zeros(len(times), np.int64)
    while len(node) and node.max() > 0:
        found = reach(found, best[node])
        all_ *= product[node]
        many += number[node]
        node = node >> 1
    found[found == n] = -1
    return found, all_, many


def _sweep(event_columns: list[str], values: list[str], keys: list[str], last: bool, schema: T.StructType):
    def build(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        number = lambda c, none: table.column(c).cast(pa.float64()).fill_null(none).to_numpy()
        is_event = table.column("_side").to_numpy() == 1
        group = np.repeat(np.arange(len(bounds)), [b - a for a, b in bounds])
        iv, ev = np.flatnonzero(~is_event), np.flatnonzero(is_event)
        found, product, many = covering_rows(group[iv], number("_s", -np.inf)[iv], number("_e", np.inf)[iv], group[ev], number("_t", np.nan)[ev],
                                             number("_f", 1.0)[iv], table.column("_closed").to_numpy()[iv].astype(np.int64), number("_m", 1)[iv].astype(np.int64), last)
        row = table.column("_row").combine_chunks().take(pa.array(ev))
        hit = pa.array(np.where(found < 0, 0, iv[found] if len(iv) else 0), mask=found < 0)
        told = table.column("_v").combine_chunks().take(hit)
        arrays = [row.field(c) for c in event_columns] + [pc.struct_field(told, v) for v in values] + [pa.array(product), pa.array(many)]
        return pa.table(arrays, names=[f.name for f in schema.fields])

    return build


def _stabbed(events: DataFrame, intervals: DataFrame, keys: list[str], event_time: str, start: str, end: str, order: Sequence[str], values: Sequence[str],
             width: float | Borders | None, closed_end: bool, last: bool, factor: Column | None) -> DataFrame:
    """Events with `values` of the first (or last) covering interval, `_product` of the factors of all and their number `_number`.

    Time is cut into chunks. An interval is a row in the chunks of its start
    and of its end. For the chunks that it spans whole it leaves a mark on a
    few nodes of a tree over the chunk numbers; marks are combined per node,
    and a chunk gathers those above it as one more row. So an interval over a
    whole track costs two rows and some nodes, and a chunk sees its own events,
    the intervals that start or end in it and one row besides.
    """
    rows = intervals.filter(F.col(start) <= F.col(end)).select(
        *keys, F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*order, start, end, *values])]).alias("_o"),
        (F.struct(*values) if values else F.struct(F.lit(True).alias("_"))).alias("_v"), (F.lit(1.0) if factor is None else factor.cast("double")).alias("_f"))
    rows = add_chunk(add_chunk(rows, "_s", width, "_c1"), "_e", width, "_c2")
    partial = rows.withColumn(CHUNK, F.explode(F.array_distinct(F.array("_c1", "_c2")))).select(
        *keys, CHUNK, F.lit(0).alias("_side"), "_s", "_e", "_o", "_v", "_f", F.lit(closed_end).alias("_closed"), F.lit(1).cast("bigint").alias("_m"))
    asked = add_chunk(events.withColumn("_t", F.col(event_time).cast("double")), "_t", width).select(*keys, CHUNK, F.lit(1).alias("_side"), "_t",
                          F.struct(*[F.col(c) for c in events.columns]).alias("_row"), F.lit(False).alias("_closed"))
    both = partial.unionByName(asked, allowMissingColumns=True)

    spans = rows.filter("_c2 > _c1 + 1").withColumn("_n", F.explode(cover(F.col("_c1") + 1, F.col("_c2") - 1)))
    best = (F.max if last else F.min)(F.struct("_o", "_v"))
    marks = materialize(spans.groupBy(*keys, "_n.level", "_n.node").agg(best.alias("_b"), F.product("_f").alias("_f"), F.count("*").alias("_m")), "marks")
    top = marks.agg(F.max("level")).first()[0]
    if top is not None:
        chunks = asked.select(*keys, CHUNK).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(int(top)))))
        chunks = chunks.withColumn("node", F.expr(f"shiftright({CHUNK}, level)"))
        above = chunks.join(marks, [*keys, "level", "node"]).groupBy(*keys, CHUNK).agg((F.max if last else F.min)("_b").alias("_b"), F.product("_f").alias("_f"), F.sum("_m").alias("_m"))
        both = both.unionByName(above.select(
            *keys, CHUNK, F.lit(0).alias("_side"), F.lit(float("-inf")).alias("_s"), F.lit(float("inf")).alias("_e"), F.col("_b._o").alias("_o"), F.col("_b._v").alias("_v"), "_f",
            F.lit(True).alias("_closed"), "_m"), allowMissingColumns=True)
    fields = [*events.schema.fields, *[T.StructField(v, rows.schema["_v"].dataType[v].dataType) for v in values], T.StructField("_product", T.DoubleType()), T.StructField("_number", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    dealt = both.repartition(*keys, CHUNK)
    return map_groups(dealt, [*keys, CHUNK], ["_side", "_o"], schema, _sweep(events.columns, list(values), keys, last, schema))


def containing(
    events: DataFrame, intervals: DataFrame, keys: Sequence[str], event_time: str, start: str, end: str,
    order: Sequence[str], values: Sequence[str], width: float | Borders | None, closed_end: bool = False, last: bool = False,
) -> DataFrame:
    """Left join to the first (or last) interval that contains the event time; nulls where none does."""
    found = _stabbed(events, intervals, list(keys), event_time, start, end, order, values, width, closed_end, last, None)
    return found.drop("_product", "_number")


def with_factor(
    events: DataFrame, intervals: DataFrame, keys: Sequence[str], event_time: str, start: str, end: str,
    factor: Column, width: float | Borders | None, closed_end: bool = False, name: str = "factor", count: str = "covered",
) -> DataFrame:
    """Events with the product of `factor` (a Column over the intervals) and the number of all intervals that contain their time; 1 and 0 where none does."""
    found = _stabbed(events, intervals, list(keys), event_time, start, end, [start], [], width, closed_end, False, factor)
    return found.withColumnRenamed("_product", name).withColumnRenamed("_number", count)


def first_within(
    events: DataFrame, points: DataFrame, keys: Sequence[str], event_time: str, point_time: str, tolerance: float,
    values: Sequence[str], width: float | Borders | None = None,
) -> DataFrame:
    """Each event that has a point from `tolerance` before it to `tolerance` after it, with the values of the earliest such point (of several at one time, the least values)."""
    single = points.groupBy(*keys, point_time).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, F.col(point_time).alias("_pt"), "_v")
    early = events.withColumn("_from", F.col(event_time) - tolerance)
    found = asof(early, single, keys, "_from", "_pt", ["_v"], width)
    hit = F.when(F.col("before")["t"] == F.col("_from"), F.col("before")).otherwise(F.col("after"))
    near = found.withColumn("_hit", hit).filter(F.col("_hit")["t"] <= F.col(event_time) + tolerance)
    return near.select(*events.columns, *[F.col("_hit")["_v"][v].alias(v) for v in values])


def band(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tolerance: float,
    how: str = "inner", strict: bool = False,
) -> DataFrame:
    """Join rows whose times differ by at most `tolerance` (below it if `strict`).

    Time bins as wide as the tolerance turn the condition into an equi join.
    `how` may also be left_semi or left_anti.
    """
    keys = list(keys)
    a = left.withColumn("_bin", F.floor(F.col(left_time) / tolerance))
    home = F.floor(F.col(right_time) / tolerance)
    b = right.withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_bin").alias("_r_bin"),
                 *[c for c in right.columns if c not in keys])
    gap = F.abs(a[left_time] - b[right_time])
    on = (gap < tolerance) if strict else (gap <= tolerance)
    on = on & (a["_bin"] == b["_r_bin"])
    for k in keys:
        on = on & (a[k] == b[f"_r_{k}"])
    return a.join(b, on, how).drop("_bin", "_r_bin", *[f"_r_{k}" for k in keys])
