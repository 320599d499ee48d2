"""Benchmark passages in documents: winnowed word n-grams meet, hits are extended to whole windows. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.joins import join_table
from cadenza.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what stands between words, with A-Z still in the text
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def scheme(length: int, gram: int) -> tuple[int, int]:
    """(words of an n-gram, n-grams of a window) for spans of `length` words: any such span holds a whole window of n-grams."""
    k = min(gram, length)
    return k, length - k + 1


def _grams(words: str, k: int) -> Column:
    """Hash of each run of k words, from the array of word hashes `words`."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: str, w: int) -> Column:
    """Least hash of each run of w n-grams: what winnowing keeps of it."""
    if w == 1:
        return F.col(grams)
    runs = F.transform(F.sequence(F.lit(1), F.size(grams) - w + 1), lambda i: F.array_min(F.slice(F.col(grams), i, w)))
    return F.when(F.size(grams) >= w, runs).otherwise(F.array().cast("array<bigint>"))


def with_minima(rows: DataFrame, words: str, lengths: list[int], gram: int) -> DataFrame:
    """`rows` with m<L> for each L of `lengths`: the winnowed hash of each run of L words of the array `words`, in order."""
    step = rows.withColumn("_h", F.transform(words, lambda x: F.xxhash64(x)))
    sizes = sorted({scheme(n, gram)[0] for n in lengths})
    for k in sizes:
        step = step.withColumn(f"_g{k}", _grams("_h", k))
    for n in lengths:
        k, w = scheme(n, gram)
        step = step.withColumn(f"m{n}", _minima(f"_g{k}", w))
    return step.drop("_h", *[f"_g{k}" for k in sizes])


def item_windows(items: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(item_id, length, span, mark) of the different windows of each item, and the lengths that occur.

    span: the window's words, joined by blanks; mark: its winnowed hash. An
    item of fewer than `window` words, but one, is a window of its own length.
    """
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.size("words"), F.lit(window)))
    lengths = sorted(r["length"] for r in words.select("length").distinct().collect())
    step = with_minima(words, "words", lengths, gram)
    marks = F.expr("CASE length " + " ".join(f"WHEN {n} THEN m{n}" for n in lengths) + " END") if lengths else F.array().cast("array<bigint>")
    step = step.select("item_id", "length", "words", F.posexplode(marks).alias("at", "mark"))
    return step.select("item_id", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("span"), "mark").distinct(), lengths


def _near_hits(length: int) -> Column:
    """(start, length, span) of the runs of `length` words around a hash that the items share."""
    places = F.filter(F.transform(F.col(f"m{length}"), lambda m, i: F.struct(i.alias("start"), m.alias("mark"))), lambda x: F.array_contains("_shared", x["mark"]))
    return F.transform(places, lambda x: F.struct(
        x["start"].alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(F.col("_words"), x["start"] + 1, length), " ").alias("span")))


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, small_table: int = 100_000) -> DataFrame:
    """(key, n_words, row, spans) of each document: `row` is the struct of its columns without the text, spans the runs of hit words with the items they are of.

    spans: array of (start, end, length, items) in word places, end exclusive:
    each occurrence of an item's window, with the ids of all items that have
    it. Null, where there is none.

    Of every run of `window - gram + 1` n-grams of `gram` words, documents and
    items keep the least hash. A shared window has the same n-grams on both
    sides, so the same least hash: none is missed, wherever it stands. A
    document that shares a hash is a candidate; each run around such a hash is
    then compared word by word (as its words) with the windows of the items.
    Shorter items go through runs of their own length.

    Candidates are handled once per text, and results return by the text's
    key. Tables of items and of candidates with up to `small_table` entries
    (windows, hashes or spans) are broadcast; larger ones are shuffled, hot
    keys salted. Null, empty and wordless texts have no words; ids may be
    null or repeat; an empty table of documents gives no rows, one of items no
    hits. Columns of other names are not touched.
    """
    windows, lengths = item_windows(items, window, gram)
    windows = materialize(windows, "windows")
    spans = materialize(windows.groupBy("length", "span", "mark").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "spans")
    n_spans = windows.count()  # rows of `spans` with all the items in them
    marks = spans.select("mark").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.col("text").alias("_text"))
    split = keyed.withColumn("_words", words_of(F.col("_text")))
    found = F.array_distinct(F.concat(*[F.col(f"m{n}") for n in lengths])) if lengths else F.array().cast("array<bigint>")
    row = F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != "text"] or [F.lit(True).alias("present")])
    sketch = with_minima(split, "_words", lengths, gram).select("key", F.size("_words").cast("long").alias("n_words"), found.alias("marks"), row.alias("row"))
    sketch = materialize(sketch, "sketch")
    shared = join_table(sketch.select("key", F.explode("marks").alias("mark")), marks, ["mark"], n_spans, ["key"], "left_semi", small_table)
    candidates = materialize(shared.groupBy("key").agg(F.collect_set("mark").alias("_shared")), "candidates")
    n_candidates = candidates.agg(F.sum(F.size("_shared"))).first()[0] or 0

    texts = keyed.select("key", "_text")
    near = join_table(texts, candidates, ["key"], n_candidates, ["_text"], small=small_table).dropDuplicates(["key"])
    near = with_minima(near.withColumn("_words", words_of(F.col("_text"))), "_words", lengths, gram)
    runs = [_near_hits(n) for n in lengths]
    none = F.array().cast("array<struct<start:int,length:int,span:string>>")
    tried = near.select("key", F.explode(F.concat(*runs) if runs else none).alias("r")).select("key", "r.start", "r.length", "r.span")
    hits = join_table(tried, spans.drop("mark"), ["length", "span"], n_spans, ["key"], small=small_table)
    told = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("length")).alias("end"), "length", "items"))).alias("spans"))
    told = materialize(told, "hits")
    n_told = told.agg(F.sum(F.size("spans"))).first()[0] or 0
    return join_table(sketch.select("key", "n_words", "row"), told, ["key"], n_told, ["row"], "left", small_table)


def n_covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).cast("long").alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda s: s["n"])


def report(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, small_table: int = 100_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document; an item without an id is named null."""
    found = contaminated_words(docs.select("doc_id", "text"), items, window, gram, small_table)
    items_ = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"])))), F.array().cast("array<string>"))
    hit = F.coalesce(n_covered(F.col("spans")), F.lit(0)).cast("long")
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS MATERIALIZED (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS span
  FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
o AS MATERIALIZED (
  SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS span
  FROM (SELECT d.r, d.w, l.n, unnest(range(len(d.w) - l.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM s) AS l WHERE len(d.w) >= l.n)),
h AS MATERIALIZED (SELECT o.r, o.i, o.n, s.item_id FROM o JOIN s ON o.n = s.n AND o.span = s.span),
n_hit AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(10) AS t(k) WHERE k < h.n GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN named USING (r)
"""
