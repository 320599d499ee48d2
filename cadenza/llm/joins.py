"""Joins of many rows with a table of fewer: broadcast behind a count; beyond it, only hot keys are salted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize


def join_table(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int, spread_by: Sequence[str], how: str = "inner",
               small: int = 100_000, hot: int = 200_000, salts: int = 32) -> DataFrame:
    """`left` joined with `right` on `keys`, which hold no nulls; a hot key of `left` does not end in one task.

    `rows` is the counted number of rows of `right`. Up to `small` of them are
    broadcast. Beyond, keys with over `hot` rows in `left` (at most a
    `hot`-th of its rows, so their list is short) are copied `salts` times in
    `right`, and their rows in `left` choose a copy by a hash of their columns
    `spread_by`. All forms give the same rows for inner, left and semi joins.
    """
    keys = list(keys)
    if rows <= small:
        return left.join(F.broadcast(right), keys, how)
    many = materialize(left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(*keys), "hot")
    if not many.limit(1).count():
        return left.join(right, keys, how)
    marked = many.withColumn("_hot", F.lit(True))
    mine = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit(11), *spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(F.broadcast(marked), keys, "left").withColumn("_salt", mine).drop("_hot")
    copied = right.join(F.broadcast(marked), keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
