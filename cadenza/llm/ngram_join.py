"""Near-duplicate join on word n-grams: MinHash bands, then exact Jaccard on the full sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.text import mix, shingles, slices, word_hashes
from cadenza.operators.duplicates import connected_components
from cadenza.session import materialize

NO_ID = -(1 << 63)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair at `threshold` with probability `recall` within `most` hashes.

    The longest bands give the fewest false candidates.
    """
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall within that many hashes")


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Row per text with its `bands` hashes; texts without n-grams must be left out by the caller."""
    has = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, bands), np.uint64)
    if not len(has):
        return out
    a, b = _coefficients(bands * rows)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(x)
    for band in range(bands):
        h = np.full(len(has), band + 1, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            np.multiply(x, a[i], out=work)
            np.add(work, b[i], out=work)
            h = mix(h * np.uint64(31) + np.minimum.reduceat(work, first[has]))
        out[has, band] = h
    return out


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        for batch, data, off in slices(batches, "_text", limit=1 << 20):
            grams, first = shingles(*word_hashes(data, off), n)
            table = band_hashes(grams, first, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * bands, pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("key"), pa.array(np.diff(first)), lists], names=["_id", "key", "grams", "bands"])

    return run


def _sets(n: int):
    """Per text the sorted set of its n-gram hashes, as bytes."""

    def run(batches):
        for batch, data, off in slices(batches, "_text", limit=1 << 20):
            grams, first = shingles(*word_hashes(data, off), n)
            sets = [np.unique(grams[first[i]:first[i + 1]]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], names=["key", "grams"])

    return run


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a block's sets, over the n-grams that two or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wanted = times > 1
    place = np.cumsum(wanted) - 1
    use = wanted[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(wanted.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        total += part @ part.T
    return total


def _verify(threshold: float):
    """Counts links inside a pair of blocks of one band bucket; a pair counts in the first band in which it meets."""

    def solve(rows: list[dict]):
        g = len(rows)
        if g < 2:
            return []
        sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        inter = _overlaps(sets) if g > 2 else None
        if g == 2:
            common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            inter = np.array([[0, common], [common, 0]], np.float32)
        similar = inter.astype(np.float64) >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
        block = np.array([r["block"] for r in rows])
        if rows[0]["bi"] != rows[0]["bj"]:
            similar &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(similar, 1))
        band = rows[0]["band"]
        if band and len(a):
            table = np.array([r["bands"][:band] for r in rows], np.int64)
            fresh = ~(table[a] == table[b]).any(axis=1)
            a, b = a[fresh], b[fresh]
        if not len(a):
            return []
        copies = np.array([r["copies"] for r in rows], np.int64)
        links, texts = np.zeros(g, np.int64), np.zeros(g, np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        np.add.at(texts, a, 1)
        np.add.at(texts, b, 1)
        label = np.arange(g)
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        return [(rows[i]["key"], int(links[i]), int(texts[i]), rows[label[i]]["key"]) for i in np.flatnonzero(texts)]

    def run(batches):
        held, out, name = [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["band"], r["bucket"], r["bi"], r["bj"])
                if at != name:
                    out += solve(held)
                    held, name = [], at
                held.append(r)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        out += solve(held)
        if out:
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    k, n, t, r = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n, pa.int64()), pa.array(t, pa.int64()), pa.array(r)], names=["key", "links", "texts", "root"])


def similar_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, block: int = 1_024,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, text_key, keep) of each row: groups of texts linked by Jaccard >= threshold on word n-grams.

    class_id: the lowest doc_id of all rows linked directly or through others,
    equal texts included. n_links: other rows with a similarity of `threshold`
    or more, copies counted; n_text_links: different texts among them. keep:
    the row is the one to keep of its class (its text is that of the class id;
    rows that repeat both id and text are all marked).

    Equal texts collapse first, by key. Bands and rows per band follow from
    the recall asked for at the threshold; texts meet in buckets of equal band
    hashes. Buckets with the same members are visited once, in their first
    band. A bucket is dealt out as pairs of blocks of at most about `block`
    texts, and the pairs inside are only counted, never written: a pair counts
    in the first band it shares. Links leave a block as stars, and components
    are found by label rounds in the shared folder.

    Words are runs without ASCII white space. A text of one to four words is
    one n-gram; a null or empty text or one of white space only has none,
    links to nothing and is its own class. A null doc_id counts as the lowest;
    as a class id it is null, too. Other columns are not read.
    """
    bands, rows_ = choose_bands(threshold, recall)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("key", F.md5("_text"))
    signed = materialize(base.mapInArrow(_signatures(n, bands, rows_), "_id long, key string, grams long, bands array<long>"), "signatures")
    texts = materialize(signed.filter("grams > 0").groupBy("key").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "texts")

    meets = texts.select("key", F.posexplode("bands").alias("band", "bucket"))
    crowd = meets.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "key")).alias("y")).filter("m > 1")
    once = materialize(crowd.groupBy("m", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("at")).select("at.band", "at.bucket", "m"), "buckets")
    members = materialize(meets.join(once, ["band", "bucket"]), "members")

    needed = members.select("key").distinct().join(texts.select("key", "rep"), "key").withColumnRenamed("key", "_key")
    full = base.join(needed, (base["_id"] == needed["rep"]) & (base["key"] == needed["_key"])).dropDuplicates(["_id", "key"]).select("key", "_text")
    sets = materialize(full.mapInArrow(_sets(n), "key string, grams binary"), "sets")

    blocks = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = members.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", "band", "bucket", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    rich = texts.join(sets, "key").select("key", "copies", "bands", "grams")
    group = ["band", "bucket", "bi", "bj"]
    links = materialize(dealt.join(rich, "key").repartition(*group).sortWithinPartitions(*group).mapInArrow(
        _verify(threshold), "key string, links long, texts long, root string"), "links")

    counted = links.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    edges = links.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    groups = connected_components(counted.select("key"), edges, "key")
    lowest = groups.join(texts, "key").groupBy("component").agg(F.min(F.struct("rep", "key")).alias("low"))
    linked = groups.join(lowest, "component").join(counted, "key").select(
        "key", F.col("low.rep").alias("low_id"), F.col("low.key").alias("low_key"), "links", F.col("texts").alias("text_links"))
    table = texts.select("key", "rep", "copies").join(linked, "key", "left").select(
        F.col("key").alias("_key"), "rep", "copies", F.coalesce("low_id", "rep").alias("class_id"), F.coalesce("low_key", "key").alias("class_key"),
        F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    joined = signed.select("_id", "key").join(table, F.col("key") == F.col("_key"), "left")
    alone = F.col("_key").isNull()
    return joined.select(
        F.nullif("_id", F.lit(NO_ID)).alias("doc_id"), F.nullif(F.when(alone, F.col("_id")).otherwise(F.col("class_id")), F.lit(NO_ID)).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("text_links"), F.lit(0)).cast("long").alias("n_text_links"), F.col("key").alias("text_key"),
        (alone | ((F.col("_id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))).alias("keep"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each class of `similar_documents`; rows that repeat id and text go down to one, too, except texts without words."""
    chosen = similar_documents(docs, **options)
    kept = chosen.filter("keep").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_k"), F.col("doc_id").cast("long").alias("_i"))
    one = keyed.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))).dropDuplicates(["_i", "_k"])
    return one.select("row.*")
