"""Best-two-fit packing of documents into sequences of a fixed token length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.encoding import encoder
from cadenza.llm.text import slices
from cadenza.session import materialize


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False, keep: int = 500_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut where longer than `length`.

    Only the first piece of a cut document may be shorter. Null text is the
    empty text: a piece of one token. A text row that occurs twice gives its
    pieces twice. Other columns are not read. `keep` bounds the chunks a worker
    remembers: memory against time, never the ids.
    """

    def cut(batches):
        enc = encoder(tokenizer, keep)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch, _, _ in slices(batches, "_text"):
            ids = batch.column("_id").to_pylist()
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            lists = []
            for doc, raw in zip(ids, enc.encode(batch.column("_text")), strict=True):
                tokens = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                first = len(tokens) % length or min(length, len(tokens))
                borders = [0, *range(first, len(tokens) + 1, length)]
                for k, (lo, hi) in enumerate(zip(borders, borders[1:], strict=False)):
                    for name, v in zip(rows, (doc, k, lo, hi - lo, zlib.crc32(tokens[lo:hi])), strict=True):
                        rows[name].append(v)
                    if with_ids:
                        lists.append(tokens[lo:hi].astype(np.int64))
            types = {"piece": pa.int32()}
            arrays = {n: pa.array(v, types.get(n, pa.int64())) for n, v in rows.items()}
            if with_ids:
                arrays["ids"] = pa.array(lists, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(arrays)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, schema)


def plan(counts: np.ndarray, length: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for `counts[l]` pieces of each length l: ([(length, pieces)], number of such bins).

    A bin is filled greedily with the longest piece that fits. If a gap stays,
    its smallest piece gives way to the two unpacked pieces that fill the wider
    gap best, where that is tighter. A bin is repeated as long as its pieces
    last, so the work follows the number of lengths, not of pieces.
    """
    left = np.array(counts, dtype=np.int64)
    bins: list[tuple[list[tuple[int, int]], int]] = []
    sizes = np.arange(length + 1)
    while True:
        open_lengths = np.flatnonzero(left)
        if not len(open_lengths):
            return bins
        use: dict[int, int] = {}
        gap = length
        while gap:
            fit = open_lengths[:np.searchsorted(open_lengths, gap, "right")]
            fit = next((int(v) for v in fit[::-1] if left[v] > use.get(int(v), 0)), 0)
            if not fit:
                break
            take = min(gap // fit, int(left[fit]) - use.get(fit, 0))
            use[fit] = use.get(fit, 0) + take
            gap -= take * fit
        if gap and sum(use.values()) > 1:
            small = min(use)
            free = left.copy()
            for v, n in use.items():
                free[v] -= n
            wide = gap + small
            lower = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = np.flatnonzero(free[:wide + 1])
            if len(a):
                b = lower[wide - a]
                single = (b == a) & (free[a] < 2)
                b[single] = lower[np.maximum(b[single] - 1, 0)]
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    use[small] -= 1
                    if not use[small]:
                        del use[small]
                    for v in (int(a[best]), int(b[best])):
                        use[v] = use.get(v, 0) + 1
        times = min(int(left[v]) // n for v, n in use.items())
        for v, n in use.items():
            left[v] -= n * times
        bins.append((sorted(use.items(), reverse=True), times))


def pack(pieces: DataFrame, length: int, rows_per_group: int = 200_000) -> DataFrame:
    """`pieces` with sequence_id and offset: best-two-fit over all pieces.

    Pieces of one length are interchangeable, so the driver sees one count for
    each length (at most `length` numbers) and makes the bins from them. Each
    piece then gets its number among the pieces of its length: a row number
    within salted groups of `rows_per_group` rows plus a prefix sum over the
    groups, so that a length with a third of all pieces is many tasks. Bin and
    place follow from that number. An empty table gives no rows.
    """
    per_length = pieces.groupBy("length").count().collect()
    counts = np.zeros(length + 1, np.int64)
    for r in per_length:
        counts[r["length"]] = r["count"]
    salts = int(counts.max()) // rows_per_group + 1
    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    given, sequence = np.zeros(length + 1, np.int64), 0
    for use, times in plan(counts, length):
        offset = 0
        for v, n in use:
            starts.setdefault(v, []).append((int(given[v]), sequence, n, offset))
            given[v] += n * times
            offset += v * n
        sequence += times
    table = np.array([(v, *row) for v in sorted(starts) for row in starts[v]], np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt")
    numbered = salted.withColumn("_n", F.row_number().over(group.orderBy("doc_id", "piece")) - 1)
    sums = salted.groupBy("length", "_salt").count().withColumn(
        "_base", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = numbered.join(sums, ["length", "_salt"]).withColumn("_rank", (F.col("_n") + F.col("_base")).cast("long")).drop("_n", "_base", "_salt")
    names = [*pieces.columns, "_rank"]

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, (size << 48) + rank, "right") - 1]
            past = rank - row[:, 1]
            arrays = {c: batch.column(c) for c in names[:-1]}
            arrays["sequence_id"] = pa.array(row[:, 2] + past // row[:, 3])
            arrays["offset"] = pa.array(row[:, 4] + past % row[:, 3] * size)
            yield pa.RecordBatch.from_pydict(arrays)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names).mapInArrow(place, fields + ", sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, keep: int = 500_000) -> DataFrame:
    """Encode, cut and pack `documents`; one row per piece."""
    return pack(materialize(cut_pieces(docs, tokenizer, end_id, length, keep=keep), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for pieces cut with their ids; a sequence is bounded by its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
