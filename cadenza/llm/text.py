"""Texts as numpy buffers: batches of bounded size, prefix hashes, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes worked on at a time: the temporaries of eight bytes a byte stay in the cache
UNIT = 1 << 18

_U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most `limit` bytes of text (or one row), with their buffers."""
    for batch in batches:
        data, off = buffer_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[off[at]:off[end]], off[at:end + 1] - off[at]
            at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n-1, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (BASE, _INVERSE):
            p = np.full(max(n, 1 << 19), base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] the polynomial hash of bytes i .. j-1, times BASE^i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits, in place (finalizer of splitmix64)."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes, equal for equal bytes."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    h = prefix_hashes(data)
    return mix((h[k:] - h[:-k]) * powers(len(data) - k + 1)[1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span:w - span + n])


def _cuts(data: np.ndarray, off: np.ndarray, limit: int) -> np.ndarray:
    """Text borders, and inside long texts further cuts at white space."""
    cuts = [off]
    for d in np.flatnonzero(np.diff(off) > limit):
        at, end, extra = int(off[d]), int(off[d + 1]), []
        while end - at > limit:
            back = np.flatnonzero(SPACES[data[at:at + limit]])
            if len(back):
                at += int(back[-1]) + 1
            else:  # one very long word stays whole
                ahead = np.flatnonzero(SPACES[data[at + limit:end]])
                if not len(ahead):
                    break
                at += limit + int(ahead[0]) + 1
            extra.append(at)
        cuts.append(np.array(extra, dtype=np.int64))
    return np.unique(np.concatenate(cuts))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text); words are runs without ASCII white space."""
    cuts = _cuts(data, off, UNIT)
    hashes, begins, i = [], [], 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + UNIT, "right")) - 1)
        lo, part = int(cuts[i]), data[cuts[i]:cuts[j]]
        inner = cuts[i:j] - lo
        solid = ~SPACES[part]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        border = inner[inner < len(part)]
        start[border] = solid[border]
        stop = np.zeros(len(part) + 1, dtype=bool)
        stop[1:] = solid
        stop[:-1][solid] = False
        stop[border] |= start[border] & (border > 0) & solid[np.maximum(border - 1, 0)]
        b, e = np.flatnonzero(start), np.flatnonzero(stop)
        h = prefix_hashes(part)
        hashes.append(mix((h[e] - h[b]) * powers(len(part) + 1)[1][b]))
        begins.append(b + lo)
        i = j
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), off, "left")


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, first run of each text).

    A text with fewer than n words, but one, is a single run; a text without
    words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(counts)), runs)
    at = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        w = padded[at + j]
        short = counts[text] <= j
        if short.any():
            w[short] = j + 1
        out = out * _U(BASE) + w
    return mix(out), begin
