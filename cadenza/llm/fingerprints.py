"""Document fingerprints by winnowing over word n-grams. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.mixing import SPACE

#: low bits of a packed number that hold the place of an n-gram, and the largest place
_BITS, _LAST = 27, (1 << 27) - 1


def _hashed(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))


def with_fingerprint(rows: DataFrame, text_col: str, out: str, n: int = 5, window: int = 16) -> DataFrame:
    """`rows` with array `out` of packed numbers: 36 bits of an n-gram's hash, then its place counted from the end of the range.

    Rolling hashes of n words are taken at every word, and in each run of
    `window` of them the least is chosen, the rightmost on ties: the place is
    stored as its complement, so that of equal hashes the later is less. Two
    texts that share `window + n - 1` words in a row share at least one chosen
    n-gram (match guarantee). A text with fewer than n words, but one, has its
    words as the only n-gram; one with fewer than `window` n-grams is one run.
    Null and empty texts have an empty fingerprint.
    """
    words, grams = f"_{out}_w", f"_{out}_g"
    step = rows.withColumn(words, _hashed(F.coalesce(F.col(text_col), F.lit(""))))
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    packed = F.transform(places, lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, i, n)), 64 - 36), _BITS).bitwiseOR((_LAST - i).cast("long")))
    step = step.withColumn(grams, F.when(F.size(words) > 0, packed).otherwise(F.array().cast("array<bigint>")))
    runs = F.sequence(F.lit(1), F.greatest(F.size(grams) - window + 1, F.lit(1)))
    chosen = F.array_distinct(F.transform(runs, lambda i: F.array_min(F.slice(grams, i, window))))
    return step.withColumn(out, F.when(F.size(grams) > 0, chosen).otherwise(F.array().cast("array<bigint>"))).drop(words, grams)


def hashes_of(fingerprint: Column) -> Column:
    """The different hashes of a fingerprint, without their places."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, _BITS)))


def positions_of(fingerprint: Column) -> Column:
    """(hash, place) of each chosen n-gram, places from 0."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, _BITS).alias("hash"), (_LAST - 1 - x.bitwiseAND(_LAST)).cast("int").alias("place")))


def as_text(fingerprint: Column) -> Column:
    """Hash:place of each chosen n-gram in hexadecimal, comma-joined."""
    return F.array_join(F.transform(positions_of(fingerprint), lambda p: F.concat(F.hex(p["hash"]), F.lit(":"), F.hex(p["place"].cast("long")))), ",")


def likeness(a: str, b: str) -> Column:
    """Shared part of all hashes of two hash-set columns; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def chunked(docs: DataFrame, rows_per_chunk: int = 10_000, most_cuts: int = 64) -> DataFrame:
    """`docs` dealt to chunks of neighbouring ids (_chunk, _key), each chunk with a copy (_guest = 1) of the row that follows it in descending id.

    Ids are cut at up to `most_cuts` quantiles and each part into equal ranges,
    so that a chunk has about `rows_per_chunk` rows. After the lowest row comes
    the highest. A null id is lowest.
    """
    ranked = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    size = ranked.agg(F.count("*").alias("n")).first()["n"]
    chunks = size // rows_per_chunk + 1
    parts = min(chunks, most_cuts + 1)
    cuts: list[int] = []
    if parts > 1:
        cuts = sorted(set(ranked.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"]))
    finer = -(-chunks // parts)
    ends = ranked.agg(F.min("_key").alias("a"), F.max("_key").alias("b")).first() if finer > 1 else None
    placed = ranked.withColumn("_chunk", _chunk_of(F.col("_key"), cuts, finer, ends))
    tops = placed.groupBy("_chunk").agg(F.max("_key").alias("_k"))
    by_chunk = Window.orderBy("_chunk")  # one row per chunk
    lowest = F.min("_chunk").over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("_k", F.coalesce(F.lead("_chunk").over(by_chunk), lowest).alias("_to"))
    first = Window.partitionBy("_key").orderBy(F.desc(F.xxhash64("text")))
    tops = F.broadcast(tops) if chunks <= 100_000 else tops
    heads = placed.drop("_chunk").join(tops, F.col("_key") == F.col("_k")).withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    guests = heads.select(*docs.columns, "_key", F.col("_to").alias("_chunk"), F.lit(1).alias("_guest"))
    return placed.withColumn("_guest", F.lit(0)).unionByName(guests)


def _chunk_of(key: Column, cuts: list[int], finer: int, ends) -> Column:
    """Number of cuts at or below the key, by nested halves; parts go into `finer` equal ranges."""
    floor = ends["a"] if ends else 0
    borders = [floor, *cuts, (ends["b"] + 1) if ends else 0]

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            if finer == 1:
                return F.lit(lo).cast("long")
            a, b = borders[lo], max(borders[lo] + 1, borders[lo + 1])
            inside = F.floor((key.cast("double") - F.lit(float(a))) / float(b - a) * finer).cast("long")
            return F.lit(lo * finer).cast("long") + F.greatest(F.lit(0), F.least(inside, F.lit(finer - 1)))
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` (of `chunked`) with next_<column>, those of the row after it in descending doc_id; equal ids are ordered by a hash of the text.

    The window runs inside a chunk, so no task sees more; guests end their
    chunk and leave.
    """
    down = Window.partitionBy("_chunk").orderBy("_guest", F.desc("_key"), F.desc(F.xxhash64("text")))
    out = rows.select("*", *[F.lead(c).over(down).alias(f"next_{c}") for c in columns])
    return out.filter("_guest = 0").drop("_guest", "_chunk", "_key")


def edited_fingerprints(docs: DataFrame, n: int = 5, window: int = 16) -> DataFrame:
    """Fingerprint of each text and of its edited form, with their likeness and that to the next document's.

    Edited: the last half of the code points gives way to as many first code
    points of the next document (all of a shorter one). Null text is the empty
    text. Needs doc_id and text; an empty table gives no rows.
    """
    texts = chunked(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    pairs = with_next(with_fingerprint(texts, "text", "fp", n, window), ["text", "fp"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    pairs = pairs.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    pairs = with_fingerprint(pairs, "edited", "edited_fp", n, window)
    sets = pairs.withColumns({"_a": hashes_of(F.col("fp")), "_b": hashes_of(F.col("edited_fp")), "_c": hashes_of(F.col("next_fp"))})
    return sets.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"))
