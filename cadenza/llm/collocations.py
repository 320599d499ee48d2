"""Phrases of two or three words that keep together: counts from word suffixes, dealt to groups of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.joins import join_table
from cadenza.llm.text import BASE, mix, powers, slices
from cadenza.session import materialize

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SOLID = ~_BREAK
_SOLID[list(b" \t")] = False
#: words of more bytes are hashed by a digest: sums of powers modulo 2^64 have built collisions at such lengths
_LONG = 256
#: no word: the piece has ended
NONE = -1
#: codes of words without a place in the code table: their hash with this bit set
_OPEN = 1 << 62
_PLACES = 1 << 20


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng([20250607, seed]).integers(1, 1 << 63, 256, dtype=np.uint64)


def _units(data: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begin of each text or part, row of each) of about `limit` bytes each; a longer text is cut between its pieces, so that no phrase is.

    A single piece longer than that stays whole.
    """
    cuts, rows = [], []
    for d in range(len(off) - 1):
        at, end = int(off[d]), int(off[d + 1])
        cuts.append(at)
        rows.append(d)
        while end - at > limit:
            back = np.flatnonzero(_BREAK[data[at:at + limit]])
            ahead = back if len(back) else np.flatnonzero(_BREAK[data[at + limit:end]]) + limit
            if not len(ahead):
                break
            at += int(ahead[-1] if len(back) else ahead[0]) + 1
            cuts.append(at)
            rows.append(d)
    if not cuts:
        return
    cuts, rows, end, i = np.array(cuts), np.array(rows), int(off[-1]), 0
    while i < len(cuts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + limit, "right")) - 1)
        stop = int(cuts[j]) if j < len(cuts) else end
        yield data[cuts[i]:stop], cuts[i:j] - cuts[i], rows[i:j]
        i = j


class Words:
    """Words of a unit: place in the bytes, hash with the language, and whether the next word belongs to the same piece."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, lang: np.ndarray, seed: int):
        """lang: a hash for each text of the unit."""
        self.data = data = _LOWER[data]
        solid = _SOLID[data]
        start, stop = solid.copy(), np.zeros(len(data) + 1, dtype=bool)
        start[1:] &= ~solid[:-1]
        stop[1:] = solid
        stop[:-1][solid] = False
        border = begin[(begin > 0) & (begin < len(data))]
        start[border] = solid[border]
        stop[border] |= solid[border - 1]
        self.begin, self.end = b, e = np.flatnonzero(start), np.flatnonzero(stop)
        rising, falling = powers(len(data) + 1)
        h = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_table(seed)[data] * rising[:len(data)], out=h[1:])
        h = (h[e] - h[b]) * falling[b]
        for i in np.flatnonzero(e - b > _LONG):
            import hashlib

            h[i] = int.from_bytes(hashlib.blake2b(data[b[i]:e[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        self.text = np.searchsorted(begin, b, "right") - 1
        self.hash = mix(mix(h) ^ lang[self.text]) & _U(0xFFFFFFFFFFFFFFFC)  # 62 bits, which the codes of open words keep
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        follows = np.zeros(len(b), dtype=bool)
        if len(b):
            follows[:-1] = (breaks[b[1:]] == breaks[e[:-1]]) & (self.text[1:] == self.text[:-1])
        self.follows = follows


def _unit_words(batches: Iterator[pa.RecordBatch], seed: int, limit: int) -> Iterator[tuple[Words, list[str]]]:
    """Words of the units of all batches, with the language of each text."""
    hashes: dict[str, int] = {}
    for batch, data, off in slices(batches, "_text", limit):
        names = batch.column("_lang").to_pylist()
        for raw, begin, rows in _units(data, off, limit):
            lang = [names[r] for r in rows]
            for n in set(lang).difference(hashes):
                s = np.frombuffer(n.encode() + b"\0", np.uint8)
                with np.errstate(over="ignore"):
                    hashes[n] = int(mix(np.cumsum(_table(seed)[s] * powers(len(s))[0])[-1:])[0])
            yield Words(raw, begin, np.array([hashes[n] for n in lang], np.uint64), seed), lang


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - begin
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) + np.repeat(begin - off[:-1], size)
    return pa.Array.from_buffers(pa.large_utf8(), len(begin), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.string())


def _count_words(seed: int, limit: int):
    """Distinct words of each unit with their counts."""

    def run(batches):
        for w, lang in _unit_words(batches, seed, limit):
            h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            names = pa.array([lang[t] for t in w.text[first]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), names, _strings(w.data, w.begin[first], w.end[first]), pa.array(n)], names=["h", "lang", "word", "n"])

    return run


class Prefixes:
    """Which group of prefixes a suffix belongs to.

    A suffix counts for its first word; where that prefix has more occurrences
    than a group may hold, for its first two words, and where those do, for all
    three. `hot` holds the hashes of the prefixes that are split, of one and of
    two words; `cells` the group of each range of prefix hashes.
    """

    def __init__(self, hot: list[np.ndarray], cells: np.ndarray | None = None):
        self.hot, self.cells = [np.sort(h) for h in hot], cells

    def keys(self, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of words) of each suffix's prefix; h: hashes of its words, 0 where there is none."""
        key, size = h[0].copy(), np.ones(len(h[0]), np.int64)
        for depth, hot in enumerate(self.hot, 1):
            if len(hot) and len(key):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                more = np.flatnonzero((hot[at] == key) & (size == depth))
                key[more] = mix(key[more] * _U(BASE) + h[depth][more])
                size[more] = depth + 1
        return key, size

    def groups(self, key: np.ndarray) -> np.ndarray:
        bits = len(self.cells).bit_length() - 1
        return self.cells[(key >> _U(64 - bits)).astype(np.int64)] if bits else np.zeros(len(key), np.int64)


def _suffixes(w: Words, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(codes, hashes) of the three words from each word on; NONE and 0 behind the end of its piece."""
    n = len(w.hash)
    c, h, open_ = [codes], [w.hash], np.ones(n, dtype=bool)
    for j in (1, 2):
        open_ = open_.copy()
        open_[:max(0, n - j)] &= w.follows[j - 1:n - 1] if n > j else False
        open_[max(0, n - j):] = False
        cj, hj = np.full(n, NONE, np.int64), np.zeros(n, np.uint64)
        at = np.flatnonzero(open_)
        cj[at], hj[at] = codes[at + j], w.hash[at + j]
        c.append(cj)
        h.append(hj)
    return c, h


def _codes(hashes: np.ndarray, table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Place of each word in the code table, or its hash marked as open."""
    out = (hashes >> _U(2)).astype(np.int64) | _OPEN
    if len(table) and len(hashes):
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        known = table[at] == hashes
        out[known] = place[at[known]]
    return out


def _prefix_cells(prefixes: Prefixes, depth: int, bits: int, table, place, seed: int, limit: int):
    """How many suffixes of a task have a prefix of `depth` words, by range of the prefix's hash: a row for each range that occurs."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for w, _ in _unit_words(batches, seed, limit):
            key, size = prefixes.keys(_suffixes(w, _codes(w.hash, table.value, place.value))[1])
            counts += np.bincount((key[size == depth] >> _U(64 - bits)).astype(np.int64), minlength=len(counts))
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])

    return run


def _pair_counts(prefixes: Prefixes, wanted: np.ndarray, table, place, seed: int, limit: int):
    """Counts of the two-word prefixes in the `wanted` ranges."""
    bits = len(wanted).bit_length() - 1

    def run(batches):
        for w, _ in _unit_words(batches, seed, limit):
            c, h = _suffixes(w, _codes(w.hash, table.value, place.value))
            key, size = prefixes.keys(h)
            at = np.flatnonzero((size == 2) & wanted[(key >> _U(64 - bits)).astype(np.int64)])
            k, first, n = np.unique(key[at], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *[pa.array(c[j][at][first]) for j in (0, 1)], pa.array(n)], names=["key", "c1", "c2", "n"])

    return run


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Ordered suffixes with counts as planes of bytes, compressed: neighbours agree in most of them."""
    n = len(counts)
    open_, inverse = np.unique(np.concatenate([c[c >= _OPEN] for c in columns]), return_inverse=True)
    local, at = [], 0
    for c in columns:
        c, mine = c + 1, np.flatnonzero(c >= _OPEN)  # NONE is 0
        c[mine] = _PLACES + 1 + inverse[at:at + len(mine)]
        at += len(mine)
        local.append(c.astype("<u4"))
    planes = np.concatenate([np.ascontiguousarray(c.view(np.uint8).reshape(n, 4).T).ravel() for c in [*local, counts.astype("<u4")]])
    body = planes.tobytes() + open_.astype("<i8").tobytes()
    return np.array([n, len(open_)], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The three columns of codes and the counts of `pack`."""
    n, extra = map(int, np.frombuffer(blob, "<u4", 2))
    body = pa.decompress(memoryview(blob)[8:], 16 * n + 8 * extra, codec="zstd", asbytes=True)
    planes = np.frombuffer(body, np.uint8, 16 * n).reshape(4, 4, n)
    open_ = np.frombuffer(body, "<i8", extra, 16 * n)
    out = []
    for p in planes:
        c = np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64)
        out.append(c)
    for c in out[:3]:
        c -= 1
        mine = np.flatnonzero(c >= _PLACES)
        c[mine] = open_[c[mine] - _PLACES]
    return out


def _deal(prefixes: Prefixes, table, place, seed: int, limit: int, suffixes: int):
    """Suffixes of a task's words by group: rows of (group, packed suffixes), written for about `suffixes` at a time."""

    def flush(held):
        c = [np.concatenate([h[j] for h in held]) for j in range(3)]
        group = np.concatenate([h[3] for h in held])
        order = np.lexsort((c[2], c[1], c[0], group))
        c, group = [x[order] for x in c], group[order]
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
        at = np.flatnonzero(new)
        counts, c, group = np.diff(np.append(at, len(group))), [x[at] for x in c], group[at]
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        begins = np.concatenate([[0], ends[:-1]])
        for i in range(0, len(ends), 512):
            parts = list(zip(begins[i:i + 512], ends[i:i + 512], strict=True))
            blobs = [pack([x[a:b] for x in c], counts[a:b]) for a, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array(group[begins[i:i + 512]], pa.int64()), pa.array(blobs, pa.binary())], names=["group", "suffixes"])

    def run(batches):
        held, n = [], 0
        for w, _ in _unit_words(batches, seed, limit):
            c, h = _suffixes(w, _codes(w.hash, table.value, place.value))
            held.append([*c, prefixes.groups(prefixes.keys(h)[0])])
            n += len(w.hash)
            if n >= suffixes:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def subtree(columns: list[np.ndarray], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of the suffix tree cut off at three words: per depth, (first leaf, total of the leaves below) of each node, in order of the leaves.

    `columns` must be ordered; the leaves below a node are neighbours.
    """
    new, out = np.zeros(len(counts), dtype=bool), []
    if len(counts):
        new[0] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        out.append((at, np.add.reduceat(counts, at) if len(at) else counts[:0]))
    return out


def _build(least: int, split_words: dict[int, int], split_pairs: dict[tuple[int, int], int]):
    """Nodes of two and three words with `least` or more occurrences and the totals of the nodes above, from all suffixes of a group.

    A split prefix lies in several groups; its total is given.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack(b.as_buffer().to_pybytes()) for b in group.column("suffixes")]
        c = [np.concatenate([p.pop(0) for p in parts]) for _ in range(4)]
        order = np.lexsort((c[2], c[1], c[0]))
        for j in range(4):
            c[j] = c[j][order]
        nodes = subtree(c[:3], c[3])
        found, above = [], []
        for depth in (1, 2, 3):
            at, total = nodes[depth - 1]
            if depth > 1:
                keep = np.flatnonzero((total >= least) & (c[depth - 1][at] != NONE))
                if depth == 2 and split_pairs:
                    keep = np.array([i for i in keep if (int(c[0][at[i]]), int(c[1][at[i]])) not in split_pairs], np.int64)
                first = at[keep]
                totals = [t[np.searchsorted(b, first, "right") - 1] for b, t in above] + [np.zeros(len(first), np.int64)] * (3 - depth)
                found.append((c[0][first], c[1][first], c[2][first] if depth == 3 else np.full(len(first), NONE), total[keep], *totals))
            if depth < 3:
                total = total.copy()
                for i in np.flatnonzero(np.isin(c[0][at], list(split_words))) if split_words else ():
                    one, two = int(c[0][at[i]]), int(c[1][at[i]])
                    total[i] = split_words[one] if depth == 1 else split_pairs.get((one, two), total[i])
                above.append((at, total))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["c1", "c2", "c3", "a", "f1", "f2"])

    return run


def dictionary(texts: DataFrame, limit: int, seeds: int = 8) -> tuple[DataFrame, int]:
    """(h, lang, word, n) of all words with their counts, and the seed whose hashes tell all of them apart."""
    for seed in range(seeds):
        seen = texts.mapInArrow(_count_words(seed, limit), "h long, lang string, word string, n long")
        who = F.struct("lang", "word")
        words = materialize(seen.groupBy("h").agg(F.min(who).alias("low"), F.max(who).alias("high"), F.sum("n").alias("n")), "words")
        if not words.filter("low <> high").limit(1).count():
            return words.select("h", "low.lang", "low.word", "n"), seed
    raise ValueError("words collide under every seed")


def _code_table(words: DataFrame, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, place of each) of at most `codes` words, those most frequent: all with a count over a limit taken from counts by eighths of powers of two."""
    eighth = F.floor(F.log2("n") * 8).cast("int")
    many = sorted(((r["e"], r["m"]) for r in words.groupBy(eighth.alias("e")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, low = 0, None
    for e, m in many:
        if total + m > codes:
            break
        total, low = total + m, e
    if low is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = words.filter(eighth >= low).select("h", "n").toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    frequent = h[np.lexsort((h, -n))]
    order = np.argsort(frequent)
    return frequent[order], order.astype(np.int64)


def _cells(counts: np.ndarray, budget: int) -> np.ndarray:
    """Group of each range of prefix hashes: neighbouring ranges are put together up to about `budget` occurrences."""
    group, held, out = 0, 0, np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if held and held + n > budget:
            group, held = group + 1, 0
        out[i] = group
        held += n
    return out


def _counted(rows: DataFrame, bits: int) -> np.ndarray:
    """Sums of n by cell, as an array over all cells."""
    out = np.zeros(1 << bits, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def phrase_counts(docs: DataFrame, least: int = 10, budget: int = 1 << 20, codes: int = 1 << 19, suffixes: int = 1 << 19, limit: int = 1 << 20,
                  text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): all words (c, lang, word, n), and the phrases of two and three words (c1, c2, c3, a, f1, f2) found `least` times or more.

    c is a word's code within its language; c3 is NONE for two words; f1 and f2
    are the counts of the first word and, for three, of the first two. Counts
    cover all texts, and a phrase stays inside a piece between marks.

    Vertical partitioning: word counts come first. Prefixes are put into groups
    of about `budget` occurrences (in small tables, an even share of the
    shuffle partitions, but not under 2^16): one-word prefixes, and in place of
    one above the budget its two-word prefixes, then those of three. Every
    suffix, cut off after three words, goes to the group of its prefix, equal
    suffixes of a task together; a group sorts its suffixes into a subtree on
    its own and reads counts from the totals of its leaves. A prefix of three
    words above the budget is a single leaf, of which each task sends one row.

    The driver holds at most `codes` words (most frequent first, which get
    short codes; the others are sent as hashes), the split prefixes (fewer than
    occurrences / budget) and 16 cells a group. Tasks hold a unit of `limit`
    bytes of text or one longer piece without marks, `suffixes` suffixes, or a
    group.
    """
    if codes > _PLACES:
        raise ValueError(f"at most {_PLACES} codes")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    words, seed = dictionary(texts, limit)
    occurrences = words.agg(F.sum("n")).first()[0] or 0
    table, place = _code_table(words, codes)
    table, place = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(place)
    share = -(-occurrences // int(spark.conf.get("spark.sql.shuffle.partitions")))
    budget = min(budget, max(share, 1 << 16))

    bits = max(10, (16 * occurrences // budget).bit_length())
    cell = F.shiftrightunsigned(F.col("h"), 64 - bits).alias("cell")
    counts = _counted(words.filter(F.col("n") <= budget).select(cell, "n"), bits)
    above = words.filter(F.col("n") > budget).select("h", "n").collect()
    hashes = [np.array([r["h"] for r in above], np.int64).view(np.uint64), np.empty(0, np.uint64)]
    open_words = {int(c): r["n"] for c, r in zip(_codes(hashes[0], table.value, place.value).tolist(), above, strict=True)}
    pairs: dict[tuple[int, int], int] = {}

    def by_cell(depth: int) -> np.ndarray:
        return _counted(texts.mapInArrow(_prefix_cells(Prefixes(hashes), depth, bits, table, place, seed, limit), "cell long, n long"), bits)

    if open_words:
        second = by_cell(2)
        if (second > budget).any():
            seen = texts.mapInArrow(_pair_counts(Prefixes(hashes), second > budget, table, place, seed, limit), "key long, c1 long, c2 long, n long")
            large = seen.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n")).filter(F.col("n") > budget).collect()
            hashes[1] = np.array([r["key"] for r in large], np.int64).view(np.uint64)
            pairs = {(r["c1"], r["c2"]): r["n"] for r in large}
            np.subtract.at(second, (hashes[1] >> _U(64 - bits)).astype(np.int64), [r["n"] for r in large])
        counts += second
        if pairs:
            counts += by_cell(3)
    prefixes = Prefixes(hashes, _cells(counts, budget))
    dealt = texts.mapInArrow(_deal(prefixes, table, place, seed, limit, suffixes), "group long, suffixes binary")
    phrases = dealt.groupBy("group").applyInArrow(_build(least, open_words, pairs), "c1 long, c2 long, c3 long, a long, f1 long, f2 long")
    split = [(a, b, NONE, n, open_words[a], 0) for (a, b), n in pairs.items() if n >= least and b != NONE]
    if split:
        phrases = phrases.unionByName(spark.createDataFrame(split, phrases.schema))
    coded = words.select("h", "lang", "word", "n").mapInArrow(_with_codes(table, place), "c long, lang string, word string, n long")
    return coded, materialize(phrases, "phrases")


def _with_codes(table, place):
    def run(batches):
        for b in batches:
            h = np.asarray(b.column("h")).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_codes(h, table.value, place.value)), b.column("lang"), b.column("word"), b.column("n")], names=["c", "lang", "word", "n"])

    return run


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in decimals of 38 digits: exact for counts up to 3 * 10^15."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, below = F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), wide(l) * wide(r)
    return F.call_function("div", above, below).cast("long")


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, small_table: int = 200_000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    a: occurrences of the phrase (at least `least`); l and r: those of its
    first part and of the rest at the cut with the lowest score, the earliest
    on ties; n: all words of the language. A phrase of two words inside one of
    three that has `covered` percent of its occurrences or more is dropped.
    Order: score and a descending, then the words in UTF-8 order.

    A null language counts as `und`, a null text as empty; a text without
    words adds nothing, an empty table gives no rows. Repeated rows count each.
    Other columns are not read. `options` are those of `phrase_counts`.
    """
    words, phrases = phrase_counts(docs, least=least, **options)
    words = materialize(words, "coded")
    frequent = words.filter(F.col("n") >= least).select("c", "lang", F.col("n").alias("last"))
    n_frequent = frequent.count()
    phrases = join_table(phrases.withColumn("c", F.when(F.col("c3") == NONE, F.col("c2")).otherwise(F.col("c3"))), frequent, ["c"], n_frequent, ["c1", "c2"], small=small_table)
    phrases = materialize(phrases.drop("c"), "phrases")
    pairs, triples = phrases.filter(F.col("c3") == NONE), phrases.filter(F.col("c3") != NONE)

    inside = triples.select(F.explode(F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c3").alias("c2")))).alias("p"), "a")
    longest = inside.groupBy("p").agg(F.max("a").alias("longer")).select("p.c1", "p.c2", "longer")
    left = pairs.join(longest, ["c1", "c2"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    two = left.select("lang", "c1", "c2", "c3", "a", F.col("f1").alias("l"), F.col("last").alias("r"), score(F.col("a"), F.col("f1"), F.col("last")).alias("score"))
    rest = pairs.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("a").alias("rest"))
    three = join_table(triples, rest, ["c2", "c3"], pairs.count(), ["c1"], small=small_table)
    three = three.withColumns({"s1": score(F.col("a"), F.col("f1"), F.col("rest")), "s2": score(F.col("a"), F.col("f2"), F.col("last"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", "c1", "c2", "c3", "a", *[F.when(early, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("f1", "f2", "l"), ("rest", "last", "r"), ("s1", "s2", "score"))])

    near = materialize(_first(two.unionByName(three), top, ties=True), "near")
    best = _first(_named(near, words, small_table), top, ties=False)
    langs = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return join_table(best, langs, ["lang"], langs.count(), ["phrase"], small=small_table).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, top: int, ties: bool, shares: tuple[int, ...] = (512, 16, 1)) -> DataFrame:
    """Each language's first `top` rows by score and a (and then all that tie with the last, or by the phrase); shares of a language are cut first."""
    order = [F.desc("score"), F.desc("a"), *([] if ties else [F.asc("phrase")])]
    place = F.rank() if ties else F.row_number()
    for n in shares:
        share = F.pmod(F.xxhash64("c1", "c2", "c3"), F.lit(n))
        rows = rows.withColumn("rank", place.over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= top)
    return rows


def _named(rows: DataFrame, words: DataFrame, small_table: int) -> DataFrame:
    """`rows` with the phrase in words."""
    codes = materialize(rows.select(F.explode(F.array("c1", "c2", "c3")).alias("c")).distinct(), "codes")
    n = codes.count()
    names = words.select("c", "word").join(F.broadcast(codes) if n <= small_table else codes, "c").unionByName(
        words.sparkSession.createDataFrame([(NONE, None)], "c long, word string"))
    names = materialize(names, "names")
    for i in (1, 2, 3):
        rows = join_table(rows, names.select(F.col("c").alias(f"c{i}"), F.col("word").alias(f"w{i}")), [f"c{i}"], n + 1, ["c1", "c2", "c3"], small=small_table)
    return rows.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).drop("w1", "w2", "w3")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS MATERIALIZED (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM pieces)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*)::HUGEINT AS f FROM places GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM places WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM places WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
chosen AS (
  SELECT * FROM (SELECT *, 1000000::HUGEINT * a * a // (l * r) AS score FROM cuts) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
