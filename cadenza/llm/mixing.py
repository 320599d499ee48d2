"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize

#: white space between words, as a regular expression
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], max_epochs: int, total: int | None = None) -> list[float]:
    """Targets that share `total` (default: all sizes) by weight, none above max_epochs times its size.

    Sources above their limit are clamped to it and what they leave is shared
    again by weight, until none is above. If all are clamped, the targets sum
    to less than `total`.
    """
    total = sum(sizes) if total is None else total
    clamped: set[int] = set()
    while True:
        rest = total - sum(max_epochs * sizes[i] for i in clamped)
        weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        target = [float(max_epochs * s) if i in clamped else weights[i] * rest / weight if weight else 0.0 for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if i not in clamped and t > max_epochs * sizes[i]}
        if not over:
            return target
        clamped |= over


def _draw(id_: Column, seed: int) -> Column:
    """52 bits that follow from the id and the seed alone."""
    name = F.coalesce(id_.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, size: Column, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, bucket_bits: int = 12,
        small_table: int = 100_000) -> DataFrame:
    """(row, size, source_size, target, epochs, taken): `row` is the struct of all columns of `docs` (doc_id, source, ..), epochs how often it is taken.

    Sources in code point order, null last, weigh `weights`, repeating. A
    source with target T and size S takes every row floor(T / S) times and
    once more the rows that come first in a seeded order, up to the rest of T:
    a row is in if half of it fits. So a source misses its target by at most
    half a row. The choice depends on id, size and seed alone: rows that agree
    in id and size are in or out together. A null id is an id of its own. A
    source of empty texts has target 0 and takes nothing; an empty table gives
    no rows.

    Sizes are summed by source and range of the seeded number. Running sums
    over the ranges name the one in which a source's rest ends, and only that
    range is put in order row by row; it gives the last row that is in. With
    that row the choice is a map over `docs`, which are never shuffled. One
    row per source reaches the driver and comes back as a broadcast, or by a
    shuffle beyond `small_table` sources.
    """
    spark = docs.sparkSession
    shift = 52 - bucket_bits
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("_source"), size.cast("long").alias("size"),
                       _draw(F.col("doc_id"), seed).alias("_draw")).withColumn("_bucket", F.shiftright("_draw", shift))
    sums = materialize(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum")), "sums")
    sources = sums.groupBy("_source").agg(F.sum("_sum").alias("s")).orderBy(F.col("_source").asc_nulls_last()).collect()
    weigh = [weights[i % len(weights)] for i in range(len(sources))]
    plan = []
    for r, t in zip(sources, water_fill([r["s"] for r in sources], weigh, max_epochs), strict=True):
        whole = min(max_epochs, int(t // r["s"])) if r["s"] else 0
        plan.append((r["_source"], r["s"], t, whole, max(0.0, t - whole * r["s"])))
    few = len(plan) <= small_table
    near = F.broadcast if few else (lambda df: df)

    def table(fields: str, values: list[tuple]) -> DataFrame:
        return near(spark.createDataFrame(values, fields))

    needs = table("_of string, _rest double", [(p[0], p[4]) for p in plan])
    upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket"))
    ends = sums.withColumn("_upto", upto).join(needs, F.col("_source").eqNullSafe(F.col("_of")))
    ends = ends.filter("_rest > 0 AND _upto > _rest AND _upto - _sum <= _rest").select(
        F.col("_of").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_upto") - F.col("_sum")).alias("_before"), F.col("_rest").alias("_left"))
    last = ends.collect()
    ends = table("_s string, _b long, _before long, _left double", [tuple(r) for r in last])
    inside = rows.drop("row").join(ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    peers = inside.groupBy("_s", "_b", "_before", "_left", "_draw", "size").agg(F.sum("size").alias("_peers"))
    run = F.sum("_peers").over(Window.partitionBy("_s", "_b").orderBy("_draw", "size"))
    fits = peers.withColumn("_run", run).filter(F.col("_before") + F.col("_run") - F.col("_peers") / 2 <= F.col("_left"))
    final = {r["_s"]: (r["m"]["_draw"], r["m"]["size"]) for r in fits.groupBy("_s").agg(F.max(F.struct("_draw", "size")).alias("m")).collect()}
    begin = {r["_s"]: (r["_b"] << shift) - 1 for r in last}
    # without an end every row is in (the rest is the whole source) or none (no rest)
    cut = [(n, s, t, w, *(final.get(n) or (begin.get(n, (1 << 52) if rest > 0 else -1), -1))) for n, s, t, w, rest in plan]
    chosen = rows.join(table("_of string, source_size long, target double, _whole int, _last long, _last_size long", cut),
                       F.col("_source").eqNullSafe(F.col("_of")))
    more = (F.col("_draw") < F.col("_last")) | ((F.col("_draw") == F.col("_last")) & (F.col("size") <= F.col("_last_size")))
    out = chosen.withColumn("epochs", F.col("_whole") + F.when(more & (F.col("_whole") < max_epochs), 1).otherwise(0))
    return out.select("row", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` (doc_id, source, text, ..) as often as it is taken."""
    chosen = mix(docs, n_words(F.col("text")), **options)
    return chosen.filter("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), "epochs"))).select("row.*")


#: DuckDB's form of `mix` with the default options over `documents`
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT AS draw
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
lim AS (
  SELECT *, coalesce(sum(3 * s) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight, sum(s) OVER () AS total
  FROM src WINDOW before AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamp AS (SELECT *, w * (total - capped) > 3 * s * weight AS over FROM lim),
tgt AS (
  SELECT source, s, CASE WHEN over THEN (3 * s)::DOUBLE ELSE
         (w * (total - coalesce(sum(3 * s) FILTER (over) OVER (), 0)))::DOUBLE / (sum(w) FILTER (NOT over) OVER ())::DOUBLE END AS t
  FROM clamp),
parts AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE least(3, floor(t / s)) END AS whole FROM tgt),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, size) AS upto, sum(size) OVER (PARTITION BY source, draw, size) AS peers FROM sized)
SELECT r.doc_id, r.size, p.s AS source_size, p.t AS target,
       (r.size * (p.whole + CASE WHEN p.t - p.whole * p.s > 0 AND r.upto - r.peers / 2 <= p.t - p.whole * p.s THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
"""
