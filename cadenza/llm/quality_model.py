"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.text import slices, word_hashes

#: byte classes counted in a text
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?",
           b"|", b"#*$%&", b"<>", b"\"'`", b"()[]{}", b"-_/\\=+~^", b":;@")
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _set in enumerate(CLASSES):
    _CLASS[list(_set)] = _i
_CLASS[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
_PUNCT = np.ones(256, bool)
_PUNCT[128:] = False
_PUNCT[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r\x0b\x0c")] = False
_UPPER = _CLASS == 1
_SOLID = np.ones(256, bool)
_SOLID[list(b" \n\t\r\x0b\x0c")] = False


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per text: shares of byte classes, word, line and repetition figures."""
    n, size = len(off) - 1, np.diff(off)
    text = np.repeat(np.arange(n), size)
    counts = np.bincount(text * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    bytes_ = np.maximum(size, 1).astype(np.float64)
    solid = _SOLID[data]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    border = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    start[border] = solid[border]
    stop[border - 1] = solid[border - 1]
    words = np.bincount(text[start], minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    ends_odd = np.bincount(text[stop & _PUNCT[data]], minlength=n)
    starts_upper = np.bincount(text[start & _UPPER[data]], minlength=n)
    hashes, first = word_hashes(data, off)
    owner = np.repeat(np.arange(n), np.diff(first))

    def repeated(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, of))
        same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
        return np.bincount(of[order][1:][same], minlength=n).astype(np.float64)

    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    joined = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    newline = data == 10
    lines = counts[:, 4] + 1
    line_no = np.concatenate([[0], np.cumsum(newline)])
    word_at = np.flatnonzero(start)
    upper_in_line = np.zeros(n)
    if len(word_at):
        # share of words that are all capitals in bytes of the Latin alphabet
        lower_sum = np.concatenate([[0], np.cumsum(_CLASS[data] == 0)])
        upper_sum = np.concatenate([[0], np.cumsum(_UPPER[data])])
        end_at = np.flatnonzero(stop)
        lowers = lower_sum[end_at + 1] - lower_sum[word_at]
        uppers = upper_sum[end_at + 1] - upper_sum[word_at]
        upper_in_line = np.bincount(text[word_at], weights=(lowers == 0) & (uppers > 0), minlength=n)
        word_bytes = end_at + 1 - word_at
        long_words = np.bincount(text[word_at], weights=word_bytes > 14, minlength=n)
        short_words = np.bincount(text[word_at], weights=word_bytes <= 2, minlength=n)
        line_start = np.concatenate([[True], line_no[word_at][1:] != line_no[word_at][:-1]]) if len(word_at) else np.zeros(0, bool)
        line_start[first[:-1][first[:-1] < len(word_at)]] = True
        used_lines = np.bincount(text[word_at], weights=line_start, minlength=n)
        heads = np.flatnonzero(line_start)
        same_lines = repeated(np.add.reduceat(hashes, heads), text[word_at][heads])  # a line is the sum of its words
    else:
        long_words = short_words = used_lines = same_lines = np.zeros(n)
    figures = [
        counts / bytes_[:, None],
        np.stack([
            np.log1p(size), np.log1p(words), (size - counts[:, 3] - counts[:, 4] - counts[:, 5]) / some, words / lines, np.log1p(lines),
            ends_odd / some, starts_upper / some, upper_in_line / some, long_words / some, short_words / some,
            repeated(hashes, owner) / some, repeated(pairs[joined], owner[1:][joined]) / some if len(owner) > 1 else np.zeros(n),
            same_lines / np.maximum(used_lines, 1), counts[:, 11] / some, counts[:, 10] / some, counts[:, 8] / some,
        ], axis=1),
    ]
    return np.concatenate(figures, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Flattened trees: node i of a tree tests feature[i] <= threshold[i], its children are left[i] and left[i] + 1; a leaf points to itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows walk one level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                child = self.left[node] + (x[rows, self.feature[node]] > self.threshold[node])
                node = np.where(self.left[node] == node, node, child)
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; split candidates are `bins` quantiles of each feature, sums per bin are counted histograms.

    With one class only, or no rows, the score is the smoothed share of label 1.
    """
    n, m = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
        shift = np.arange(m) * bins
        flat = binned + shift
        raw = np.full(n, start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(feature))
            node_of = np.zeros(n, np.int64)
            level = [len(feature)]
            feature.append(0), threshold.append(0.0), left.append(len(left)), value.append(0.0)
            for d in range(depth + 1):
                k = len(level)
                g = np.bincount(node_of[node_of >= 0], grad[node_of >= 0], minlength=k)
                h = np.bincount(node_of[node_of >= 0], hess[node_of >= 0], minlength=k)
                for i, at in enumerate(level):
                    value[at] = float(-rate * g[i] / (h[i] + ridge))
                if d == depth:
                    break
                live = np.flatnonzero(node_of >= 0)
                cell = (node_of[live][:, None] * (m * bins) + flat[live]).ravel()
                shape = (k, m, bins)
                hg = np.bincount(cell, np.repeat(grad[live], m), minlength=k * m * bins).reshape(shape).cumsum(2)
                hh = np.bincount(cell, np.repeat(hess[live], m), minlength=k * m * bins).reshape(shape).cumsum(2)
                hc = np.bincount(cell, minlength=k * m * bins).reshape(shape).cumsum(2)
                gr, hr, cr = hg[:, :, -1:] - hg, hh[:, :, -1:] - hh, hc[:, :, -1:] - hc
                gain = hg**2 / (hh + ridge) + gr**2 / (hr + ridge) - (hg[:, :, -1:] ** 2) / (hh[:, :, -1:] + ridge)
                gain[(hc < least) | (cr < least)] = -1
                best = gain.reshape(k, -1).argmax(1)
                fresh, nxt = [], np.full(n, -1, np.int64)
                for i, at in enumerate(level):
                    j, b = divmod(int(best[i]), bins)
                    if gain[i, j, b] <= 1e-9 or b >= len(edges[j]):
                        continue
                    feature[at], threshold[at], left[at] = j, float(edges[j][b]), len(feature)
                    here = np.flatnonzero(node_of == i)
                    nxt[here] = len(fresh) + (binned[here, j] > b)
                    for _ in range(2):
                        fresh.append(len(feature))
                        feature.append(0), threshold.append(0.0), left.append(len(left)), value.append(0.0)
                value_now = np.array(value)
                stay = (node_of >= 0) & (nxt < 0)
                raw[stay] += value_now[np.array(level)[node_of[stay]]]
                node_of, level = nxt, fresh
                if not level:
                    break
            done = node_of >= 0
            if level:
                raw[done] += np.array(value)[np.array(level)[node_of[done]]]
    return Trees(start, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, np.float32), np.array(left, np.int64), np.array(value), depth)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 60_000, **options) -> Trees:
    """Fit on at most `max_rows` labelled documents, those first in a hashed order of the id.

    The bound keeps the label table that is broadcast and the statistics that
    reach the driver small, whatever the size of the corpus. Labels of
    documents that aren't there, null labels and held-out ids are not used; a
    document with several labels counts with each.
    """
    known = labels.select(F.col("doc_id").alias("_doc"), F.col("quality").cast("double").alias("_y")).filter(
        ~held_out(F.col("_doc")) & F.col("_doc").isNotNull() & F.col("_y").isin(0.0, 1.0))
    sample = known.orderBy(F.xxhash64("_doc"), "_doc", "_y").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_doc"))

    def figures(batches):
        for batch, data, off in slices(batches, limit=1 << 20):
            x = statistics(data, off)
            yield pa.RecordBatch.from_pydict({"d": batch.column("doc_id"), "y": batch.column("_y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.select("doc_id", "text", "_y").mapInArrow(figures, "d long, y double, x binary").toPandas().sort_values(["d", "y", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32)
    width = statistics(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    return fit(x.reshape(-1, width), got["y"].to_numpy(dtype=np.float64), **options)


def score(docs: DataFrame, model: Trees, keep: list[str] | None = None, only_accepted: bool = False) -> DataFrame:
    """Columns `keep` (default: all but older ones of these names) of `docs` with score and predicted.

    A map over the rows; null text is the empty text, which has a score, too.

    `only_accepted` leaves out rows with predicted 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    text = "_text"
    while text in names:
        text += "_"

    def apply(batches):
        for batch, data, off in slices(batches, text, limit=1 << 20):
            p = shared.value.scores(statistics(data, off))
            arrays = {c: batch.column(i) for i, c in enumerate(names)}
            arrays["score"] = pa.array(p)
            arrays["predicted"] = pa.array((p >= 0.5).astype(np.int32))
            out = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
            yield out.filter(pa.array(p >= 0.5)) if only_accepted else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    source = docs.select(*names, F.col("text").alias(text))
    return source.mapInArrow(apply, schema + ", score double, predicted int")


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of `docs` with a score of 0.5 or more, with all their columns."""
    return score(docs.select(F.struct("*").alias("row"), "text"), model, keep=["row"], only_accepted=True).select("row.*")
