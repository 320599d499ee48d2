"""Removal of byte strings that occur more than once, by suffix arrays over shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.suffix_array import common_prefixes, suffix_array
from cadenza.llm.text import UNIT, sliding_min, slices, window_hashes
from cadenza.session import materialize

#: most string starts in one segment
_RUN = 1024


def _key(raw: bytes) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a text."""
    d = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _runs(data: np.ndarray, off: np.ndarray, length: int, look_inside: bool = False):
    """Yields (text, first start, starts, key, again) of the runs of strings with one key.

    The key of a string of `length` bytes is the least hash of its runs of
    length / 2 bytes: equal strings have equal keys, and neighbouring strings
    mostly share theirs. again: the least hash occurs more than once in a run,
    so that two of its strings may be equal (None without `look_inside`).
    """
    gram = length // 2
    width = length - gram + 1
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + UNIT, "right")) - 1)
        # a long text goes in slabs of starts, several short ones together
        for lo in range(int(off[i]), max(int(off[j]) - length, int(off[i])) + 1, UNIT) if j == i + 1 else [int(off[i])]:
            hi = min(int(off[j]), lo + UNIT + length - 1) if j == i + 1 else int(off[j])
            hashes = window_hashes(data[lo:hi], gram)
            keys = sliding_min(hashes, width)
            if not len(keys):
                continue
            at = lo + np.arange(len(keys))
            text = np.searchsorted(off, at, "right") - 1
            valid = at + length <= off[text + 1]
            head = valid.copy()
            head[1:] &= (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
            begin = np.flatnonzero(head)
            if not len(begin):
                continue
            end = np.minimum(np.append(begin[1:], len(keys)), off[text[begin] + 1] - length - lo + 1)
            if (end - begin > _RUN).any():
                pieces = [(b, min(b + _RUN, e)) for s, t in zip(begin, end, strict=True) for b, e in [(x, t) for x in range(s, t, _RUN)]]
                begin, end = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
            again = None
            if look_inside:
                span = end - begin + width - 1
                first = np.cumsum(span) - span
                inside = np.repeat(begin - first, span) + np.arange(int(span.sum()))
                again = np.add.reduceat((hashes[inside] == np.repeat(keys[begin], span)).astype(np.int32), first) > 1
            yield text[begin], lo + begin - off[text[begin]], end - begin, keys[begin].view(np.int64), again
        i = j


def _profile(length: int):
    """Per text: size, keys, and which keys occur at more than one run."""

    def run(batches):
        for batch, data, off in slices(batches, "_text", limit=1 << 20):
            n = batch.num_rows
            keys: list[list[np.ndarray]] = [[] for _ in range(n)]
            for text, _, _, key, again in _runs(data, off, length, look_inside=True):
                if again.any():  # such a run counts twice
                    text, key = np.repeat(text, 1 + again), np.repeat(key, 1 + again)
                cut = np.flatnonzero(np.diff(text)) + 1
                for t, k in zip(text[np.concatenate([[0], cut])], np.split(key, cut), strict=True):
                    keys[t].append(k)
            rows = []
            for i in range(n):
                raw = data[off[i]:off[i + 1]].tobytes()
                a, b = _key(raw)
                every, times = np.unique(np.concatenate(keys[i]), return_counts=True) if keys[i] else (np.empty(0, np.int64), np.empty(0, np.int64))
                rows.append((len(raw), a, b, hashlib.sha256(raw).hexdigest(), every, every[times > 1]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]),
                 pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))],
                names=["_id", "n_bytes", "t1", "t2", "sha", "ks", "twice"])

    return run


def _segments(length: int):
    """Per run of strings with a shared key: its bytes and their hash."""

    def run(batches):
        for batch, data, off in slices(batches, "_text", limit=1 << 20):
            t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            wanted = [None if _key(data[off[i]:off[i + 1]].tobytes()) != (t1[i], t2[i]) else np.sort(np.array(v, np.int64))
                      for i, v in enumerate(batch.column("ks").to_pylist())]
            for text, start, count, key, _ in _runs(data, off, length):
                out = []
                for t, s, c, k in zip(text.tolist(), start.tolist(), count.tolist(), key.tolist(), strict=True):
                    w = wanted[t]
                    if w is None or not len(w) or w[min(np.searchsorted(w, k), len(w) - 1)] != k:
                        continue
                    raw = data[off[t] + s:off[t] + s + c + length - 1].tobytes()
                    out.append((k, *_key(raw), t1[t], t2[t], s, c, raw))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())],
                                                     names=["k", "s1", "s2", "t1", "t2", "start", "n_starts", "seg"])

    return run


def _marked(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its string starts occur at another place in the shard."""
    sizes = np.array([len(s) for s in segments])
    joined = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 2
    t = np.ones(len(joined) + len(segments) + 1, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    t[np.arange(len(joined)) + np.repeat(np.arange(len(segments)), sizes)] = joined
    t[-1] = 0
    sa = suffix_array(t)
    shared = common_prefixes(t, sa)
    both = np.maximum(shared[sa], np.append(shared[sa[1:]], 0))
    longest = np.empty(len(t), np.int64)
    longest[sa] = both
    return [longest[b:b + s - length + 1] >= length for b, s in zip(begin, sizes, strict=False)]


def _arrays(length: int, shard_bytes: int):
    """Suffix arrays over whole key groups, about `shard_bytes` at a time; rows come sorted by key."""

    def solve(rows: list[dict]):
        marks = _marked([r["seg"] for r in rows], length)
        out = []
        for r, m in zip(rows, marks, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8), [0]])))
            out += [(r["k"], r["s1"], r["s2"], int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k", "s1", "s2", "from", "many"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= shard_bytes and r["k"] != held[-1]["k"]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["seg"])
        if held:
            yield from solve(held)

    return run


def _cut_out(length: int):
    """Per text: what is left without the bytes of its repeated strings."""

    def run(batches):
        for batch, data, off in slices(batches, "_text", limit=1 << 20):
            rows = []
            for i, r in enumerate(batch.column("ranges").to_pylist()):
                raw = data[off[i]:off[i + 1]]
                if _key(raw.tobytes()) != (batch.column("t1")[i].as_py(), batch.column("t2")[i].as_py()):
                    continue
                edge = np.zeros(len(raw) + 1, np.int64)
                for a, n in ((x["a"], x["n"]) for x in r):
                    edge[a] += 1
                    edge[a + n + length - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                rows.append((batch.column("t1")[i].as_py(), batch.column("t2")[i].as_py(), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest(),
                             raw[~gone].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())],
                                             names=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_strings(docs: DataFrame, length: int = 400, shard_bytes: int = 1 << 18, group_segments: int = 2_000,
                     id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profile, texts): per row of `docs` its size and text key, and per text with repeated strings what is left of it.

    Strings of `length` bytes are dealt to shards by their key (see `_runs`).
    Keys that occur once are dropped after counting. What stays is cut into
    segments, runs of strings with one key, and equal segments collapse to one
    with a count: with two or more, all their strings are repeated. Where a key
    has several different segments, a suffix array over them (induced sorting)
    and its permuted common prefixes tell which strings occur elsewhere. A key
    with more than `group_segments` different segments is split further, into
    segments of a single string, which collapse by counting alone: no group is
    ever gathered whole. Texts of several documents are treated once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    profile = materialize(rows.mapInArrow(
        _profile(length), f"_id {id_type}, n_bytes long, t1 long, t2 long, sha string, ks array<long>, twice array<long>"), "profile")

    seen = profile.select("t1", "t2", F.explode("ks").alias("k"), F.lit(False).alias("twice")).unionByName(
        profile.select("t1", "t2", F.explode("twice").alias("k"), F.lit(True).alias("twice")))
    shared = seen.groupBy("k").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d"),
                                   F.max("twice").alias("twice")).filter("a <> b OR c <> d OR twice").select("k")
    first = profile.groupBy("t1", "t2").agg(F.min("_id").alias("_id"))
    wanted = profile.select("t1", "t2", F.explode("ks").alias("k")).join(shared, "k").groupBy("t1", "t2").agg(F.collect_set("k").alias("ks"))
    wanted = wanted.join(first, ["t1", "t2"])
    keyed = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_id"])).select("t1", "t2", "ks", "_text")
    texts = materialize(keyed.dropDuplicates(["t1", "t2", "_text"]), "texts")  # another text under the same id fails the key test below
    segments = materialize(texts.mapInArrow(
        _segments(length), "k long, s1 long, s2 long, t1 long, t2 long, start long, n_starts long, seg binary"), "segments")

    groups = materialize(segments.groupBy("k", "s1", "s2").agg(
        F.count("*").alias("n"), F.min(F.struct("t1", "t2", "start")).alias("rep")), "groups")
    inside = profile.select(F.explode("twice").alias("k")).distinct().withColumn("inside", F.lit(True))
    kinds = groups.groupBy("k").agg(F.count("*").alias("kinds")).join(inside, "k", "left")
    mixed = groups.join(kinds.filter("kinds > 1 OR inside"), "k")
    place = F.struct("t1", "t2", "start")
    bytes_of = segments.select("k", "s1", "s2", place.alias("rep"), "seg", "n_starts")
    reps = mixed.filter(F.col("kinds") <= group_segments).join(bytes_of, ["k", "s1", "s2", "rep"]).select("k", "s1", "s2", "seg")
    found = reps.repartition("k").sortWithinPartitions("k").mapInArrow(_arrays(length, shard_bytes), "k long, s1 long, s2 long, from long, many long")

    copied = groups.filter("n > 1").select("k", "s1", "s2", F.lit(0).cast("long").alias("from"), F.lit(None).cast("long").alias("many"))
    large = segments.join(kinds.filter(F.col("kinds") > group_segments), "k")
    ranges = segments.join(found.unionByName(copied), ["k", "s1", "s2"]).select(
        "t1", "t2", (F.col("start") + F.col("from")).alias("a"), F.coalesce("many", "n_starts").alias("n")).unionByName(_singles(large, length))
    per_text = ranges.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "n")).alias("ranges"))
    out = texts.join(per_text, ["t1", "t2"]).select("t1", "t2", "_text", "ranges").mapInArrow(
        _cut_out(length), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return profile, out


def _singles(large: DataFrame, length: int) -> DataFrame:
    """Ranges of one string each: the strings of `large` segments that occur twice or more, by counting."""
    every = large.select("t1", "t2", "start", "seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_starts") - 1)).alias("i"))
    string = F.md5(F.substring("seg", (F.col("i") + 1).cast("int"), F.lit(length)))
    named = every.select("t1", "t2", (F.col("start") + F.col("i")).alias("a"), string.alias("h"))
    often = named.groupBy("h").count().filter("count > 1").select("h")
    return named.join(often, "h").select("t1", "t2", "a", F.lit(1).cast("long").alias("n"))


def remove_repeats(docs: DataFrame, length: int = 400, with_kept: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row: bytes covered by a string that starts anywhere else go.

    Null text is the empty text; texts shorter than `length` lose nothing. A
    text that is there twice loses everything if it is long enough. Rows are
    matched by text, so repeated ids are no trouble; other columns are not
    read. `kept` are the remaining bytes, null where nothing was removed.
    """
    profile, texts = repeated_strings(docs, length, **options)
    copies = profile.groupBy("t1", "t2").agg((F.count("*") > 1).alias("copied"))
    known = texts if with_kept else texts.drop("kept")
    joined = profile.join(copies, ["t1", "t2"]).join(known, ["t1", "t2"], "left")
    whole = F.col("copied") & (F.col("n_bytes") >= length)

    def pick(all_gone: Column, some: Column, none: Column) -> Column:
        return F.when(whole, all_gone).otherwise(F.coalesce(some, none))

    zero = F.lit(0).cast("long")
    out = [F.col("_id").alias("doc_id"), "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), zero).alias("n_removed"),
           pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans"),
           pick(F.sha2(F.lit("").cast("binary"), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256")]
    if with_kept:
        out.append(F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    return joined.select(*out)
