"""Decisions that depend on a neighbourhood of unknown reach.

A greedy choice (highest first, strongest first) depends on better ones nearby,
and these on theirs. Blocks of the axis are decided with a margin on both
sides; every decision also says whether the margin was wide enough. While some
are not, the margin grows. The result equals the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.chain import map_groups
from cadenza.session import materialize

BLOCK = "_block"
Kernel = Callable[[pa.Table, float, float, float, float], pa.Table]


def resolve(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    order: Sequence[str],
    block: float,
    margin: float,
    kernel: Kernel,
    schema: T.StructType,
) -> DataFrame:
    """Rows of `kernel(rows, home_lo, home_hi, known_lo, known_hi)` per block.

    The kernel gets all rows with known_lo <= position < known_hi and returns
    rows for home_lo <= position < home_hi with a boolean column `certain`.
    """
    keys = list(keys)
    while True:
        size, reach = float(max(block, margin)), float(margin)
        p = F.col(position)
        spots = F.sequence(F.floor((p - reach) / size), F.floor((p + reach) / size))
        spread = df.withColumn(BLOCK, F.explode(spots))
        # a margin row belongs to a block only inside [lo - reach, hi + reach)
        lo = F.col(BLOCK) * F.lit(size)
        spread = spread.filter((p >= lo - reach) & (p < lo + size + reach))

        def build(table: pa.Table, bounds: list[tuple[int, int]], size=size, reach=reach) -> pa.Table:
            blocks = table.column(BLOCK).to_pylist()
            parts = []
            for a, b in bounds:
                start = blocks[a] * size
                parts.append(kernel(table.slice(a, b - a), start, start + size, start - reach, start + size + reach))
            return pa.concat_tables(parts)

        group = [*keys, BLOCK]
        done = materialize(map_groups(spread.repartition(*group), group, list(order), schema, build), "resolved")
        if done.filter(~F.col("certain")).limit(1).count() == 0:
            return done.drop("certain")
        margin *= 4
