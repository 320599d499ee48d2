"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the last symbol is the unique smallest."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return small


def _spread(sa: np.ndarray, t: np.ndarray, found: np.ndarray, place: np.ndarray, down: bool) -> None:
    """Put `found` suffixes, in order, into the open ends of their buckets."""
    order = np.argsort(t[found], kind="stable")
    sorted_ = found[order]
    symbols, first, counts = np.unique(t[sorted_], return_index=True, return_counts=True)
    for c, f, k in zip(symbols.tolist(), first.tolist(), counts.tolist(), strict=True):
        if down:
            sa[place[c] - k:place[c]] = sorted_[f:f + k][::-1]
            place[c] -= k
        else:
            sa[place[c]:place[c] + k] = sorted_[f:f + k]
            place[c] += k


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the order of the leftmost-smaller ones `lms` induces, bucket by bucket."""
    n, k = len(t), len(bounds) - 1
    sa = np.full(n, -1, np.int64)
    heads, tails = bounds[:-1].copy(), bounds[1:].copy()
    seeds = [np.empty(0, np.int64)] * k
    symbols = t[lms]
    order = np.argsort(symbols, kind="stable")
    grouped = lms[order]
    marks = np.searchsorted(symbols[order], np.arange(k + 1))
    used = np.flatnonzero(np.diff(bounds)).tolist()
    for c in used:
        seeds[c] = grouped[marks[c]:marks[c + 1]]
    for c in used:  # larger types, smallest bucket first
        parts, cur = [], sa[bounds[c]:heads[c]]
        while len(cur):
            parts.append(cur)
            before = cur[cur > 0] - 1
            cur = before[(t[before] == c) & ~small[before]]
            sa[heads[c]:heads[c] + len(cur)] = cur
            heads[c] += len(cur)
        parts.append(seeds[c])
        every = np.concatenate(parts)
        before = every[every > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            _spread(sa, t, before, heads, False)
    for c in reversed(used):  # smaller types, largest bucket and last suffix first
        parts, cur = [], sa[tails[c]:bounds[c + 1]][::-1]
        while len(cur):
            parts.append(cur)
            before = cur[cur > 0] - 1
            cur = before[(t[before] == c) & small[before]]
            sa[tails[c] - len(cur):tails[c]] = cur[::-1]
            tails[c] -= len(cur)
        parts.append(sa[bounds[c]:heads[c]][::-1])
        every = np.concatenate(parts)
        before = every[every > 0] - 1
        before = before[small[before] & (t[before] < c)]
        if len(before):
            _spread(sa, t, before, tails, True)
    if bounds[1] - bounds[0] == 1:
        sa[0] = n - 1
    return sa


def _induce_listwise(t: list[int], small: list[bool], lms: list[int], bounds: list[int]) -> list[int]:
    """As `_induce`, symbol by symbol: for alphabets about as large as the text."""
    sa = [-1] * len(t)
    tails = bounds[1:]
    for i in reversed(lms):
        tails[t[i]] -= 1
        sa[tails[t[i]]] = i
    heads = bounds[:-1]
    for i in sa:
        if i > 0 and not small[i - 1]:
            c = t[i - 1]
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = bounds[1:]
    for at in range(len(sa) - 1, -1, -1):
        i = sa[at]
        if i > 0 and small[i - 1]:
            c = t[i - 1]
            tails[c] -= 1
            sa[tails[c]] = i - 1
    return sa


def _names(t: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-smaller substring of `ordered`, equal for equal substrings."""
    n = len(t)
    length_at = np.zeros(n, np.int64)
    length_at[lms[:-1]] = np.diff(lms)
    a, b = ordered[:-1], ordered[1:]
    differs = length_at[a] != length_at[b]
    open_ = np.flatnonzero(~differs)
    step = 0
    while len(open_):
        i, j = a[open_] + step, b[open_] + step
        unequal = t[i] != t[j]
        differs[open_[unequal]] = True
        open_ = open_[~unequal & (length_at[a[open_]] > step)]
        step += 1
    return np.concatenate([[0], np.cumsum(differs)])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start of each suffix in sorted order; t ends with a unique smallest 0.

    Suffixes are classified, the leftmost-smaller substrings sorted by
    induction and named, the string of names sorted by recursion where names
    repeat, and all suffixes induced from that order.
    """
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].astype(np.int64)
    k = int(t.max()) + 1
    small = _types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    if k * 64 <= n or k <= 512:
        induce = lambda order: _induce(t, small, order, bounds.copy())
    else:
        as_list, types, limits = t.tolist(), small.tolist(), bounds.tolist()
        induce = lambda order: np.array(_induce_listwise(as_list, types, order.tolist(), limits), np.int64)
    rough = induce(lms)
    ordered = rough[is_lms[rough]]
    names = _names(t, ordered, lms)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[ordered] = names
        ordered = lms[suffix_array(reduced[lms])]
    return induce(ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length it shares with the suffix before it in sorted order (permuted common prefixes).

    Where the symbols left of both suffixes agree, the length is one less than
    at the position before; only the other positions are compared.
    """
    n = len(t)
    prior = np.full(n, -1, np.int64)
    prior[sa[1:]] = sa[:-1]
    here = np.arange(n)
    left = np.where((here > 0) & (prior > 0), t[np.maximum(here - 1, 0)] == t[np.maximum(prior - 1, 0)], False)
    left &= np.concatenate([[False], prior[:-1] >= 0])
    left &= np.concatenate([[False], prior[1:] == prior[:-1] + 1])
    own = np.flatnonzero(~left & (prior >= 0))
    size = np.zeros(n, np.int64)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([t.astype(np.uint16), np.zeros(8, np.uint16)]), 4)
    # four symbols of two bytes as one number
    packed = np.zeros(len(words), np.uint64)
    for i in range(4):
        packed |= words[:, i].astype(np.uint64) << np.uint64(16 * i)
    live, at = own, 0
    while len(live):
        i, j = live + at, prior[live] + at
        same = (packed[np.minimum(i, n)] == packed[np.minimum(j, n)]) & (i + 4 <= n) & (j + 4 <= n)
        ended = live[~same]
        if len(ended):
            length = np.full(len(ended), at)
            going = np.ones(len(ended), bool)
            for s in range(4):
                x, y = ended + at + s, prior[ended] + at + s
                going &= (x < n) & (y < n)
                going[going] &= t[x[going]] == t[y[going]]
                length[going] += 1
            size[ended] = length
        live = live[same]
        at += 4
    known = np.zeros(n, np.int64)
    known[own] = own + size[own]
    known[prior < 0] = here[prior < 0]
    last = np.maximum.accumulate(np.where(~left, here, 0))
    out = known[last] - here
    return np.maximum(out, 0)
