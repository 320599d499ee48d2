"""Peak picking on a sampled series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.local import resolve
from cadenza.operators.ordered import neighbours, with_group


def local_maxima(df: DataFrame, keys: Sequence[str], time: str, value: str, width: float | None = None) -> DataFrame:
    """Rows above both neighbours; a flat top counts once, at its first row."""
    near = neighbours(df, keys, [time], [value], width)
    changes = near.filter(F.col("prev").isNull() | (F.col("prev")[value] != F.col(value)))
    runs = neighbours(changes.select(*df.columns), keys, [time], [value], width)
    v = F.col(value)
    return runs.filter((F.col("prev")[value] < v) & (F.col("following")[value] < v)).select(*df.columns)


def threshold_peaks(df: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float,
                    width: float | None = None) -> DataFrame:
    """Rows at or above the threshold that are not below a neighbour."""
    near = neighbours(df, keys, [time], [value], width)
    v = F.col(value)
    ok = (v >= threshold) & ~F.coalesce(F.col("prev")[value] > v, F.lit(False))
    return near.filter(ok & ~F.coalesce(F.col("following")[value] > v, F.lit(False))).select(*df.columns)


def _pick(x: np.ndarray, first: bool, last: bool, distance: int, prominence: float | None, height: np.ndarray | None):
    """(position, certain) of the peaks of one stretch.

    `first`/`last`: the stretch starts/ends where the series does.
    """
    n = len(x)
    tops: list[tuple[int, bool]] = []
    i = 0
    while i < n:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        left = bool(x[i - 1] < x[i]) if i > 0 else (False if first else None)
        right = bool(x[j + 1] < x[i]) if j + 1 < n else (False if last else None)
        if left is not False and right is not False:
            tops.append(((i + j) // 2, left is not None and right is not None))
        i = j + 1
    if height is not None:
        tops = [(p, c) for p, c in tops if x[p] >= height[p]]
    keep: dict[int, bool] = {}
    if distance > 1:
        pos = np.array([p for p, _ in tops], dtype=int)
        state = np.zeros(len(tops), int)  # 1 kept, 2 dropped, 3 open
        for k in sorted(range(len(tops)), key=lambda k: (-x[tops[k][0]], -tops[k][0])):
            p, sure = tops[k]
            near = range(int(np.searchsorted(pos, p - distance + 1)), int(np.searchsorted(pos, p + distance)))
            seen = {int(state[m]) for m in near if m != k}
            if 1 in seen:
                state[k] = 2
                continue
            edge = (p - distance < 0 and not first) or (p + distance > n and not last)
            state[k] = 3 if (3 in seen or edge or not sure) else 1
        tops = [(tops[k][0], bool(state[k] == 1)) for k in range(len(tops)) if state[k] != 2]
    for p, sure in tops:
        ok = True
        if prominence:
            floor = x[p] - prominence
            for step, border in ((-1, first), (1, last)):
                q = p + step
                side = None
                while 0 <= q < n:
                    if x[q] > x[p]:
                        side = False
                        break
                    if x[q] <= floor:
                        side = True
                        break
                    q += step
                if side is None:
                    if border:
                        side = False
                    else:
                        sure = False
                        continue
                if not side:
                    ok = False
                    break
        if ok:
            keep[p] = sure
    return keep


def find_peaks(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    value: str,
    distance: int = 1,
    prominence: float | None = None,
    height: str | None = None,
    block: int = 50_000,
    margin: int | None = None,
) -> DataFrame:
    """Local maxima of at least `height`, thinned to `distance` rows (highest
    first, the later of equals), then filtered by prominence.

    `index` is the position in the group (see `row_index`). Returns keys, index
    and value.
    """
    keys = list(keys)
    sized = with_group(df.select(*keys, index, value, *([height] if height else [])), keys, F.max(index).alias("_last"))
    fields = {f.name: f for f in sized.schema.fields}
    schema = T.StructType([*[fields[k] for k in keys], fields[index], T.StructField(value, T.DoubleType()),
                           T.StructField("certain", T.BooleanType())])

    def kernel(table: pa.Table, lo: float, hi: float, known_lo: float, known_hi: float) -> pa.Table:
        i = table.column(index).to_numpy()
        x = table.column(value).to_numpy().astype(float)
        h = table.column(height).to_numpy().astype(float) if height else None
        first, last = bool(i[0] == 0), bool(i[-1] == table.column("_last")[0].as_py())
        found = _pick(x, first, last, distance, prominence, h)
        home = [(p, c) for p, c in sorted(found.items()) if lo <= i[p] < hi]
        take = pa.array([p for p, _ in home], pa.int64())
        out = table.select([*keys, index]).take(take)
        out = out.append_column(value, pa.array(x[[p for p, _ in home]] if home else [], pa.float64()))
        return out.append_column("certain", pa.array([c for _, c in home], pa.bool_()))

    return resolve(sized, keys, index, [index], block, margin or max(4 * distance, 64), kernel, schema)
