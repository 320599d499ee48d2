"""Quality rules per document, and verdicts on hosts from shrunken failure rates. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.mixing import SPACE
from cadenza.session import materialize

#: characters that count as symbols
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def figures(docs: DataFrame, window: int = 8, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; null text is the empty text.

    n_repeat_words: words inside runs of `window` words that occur twice or
    more in the text. The runs' hashes are sorted with their places; those
    equal to a neighbour are repeated; back in text order, each adds the words
    that the next doesn't cover. All of it is arithmetic on arrays inside a
    row: nothing is exploded or shuffled, and a text costs n log n of its own
    length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<bigint>")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), "")).withColumn("_lines", lines)
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    runs = F.transform(F.sequence(F.lit(1), F.size("_hashes") - window + 1), lambda i: F.xxhash64(F.slice("_hashes", i, window)))
    step = step.withColumn("_runs", F.when(F.size("_hashes") >= window, runs).otherwise(none))
    some = F.size("_runs") > F.size(F.array_distinct("_runs"))
    in_order = F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    step = step.withColumn("_sorted", F.when(some, in_order).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    step = step.withColumn("_places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_places", lambda p, i: F.least(F.coalesce(F.get("_places", i + 1) - p, F.lit(window)), F.lit(window)))
    return step.select(
        *docs.columns, F.size("_words").cast("long").alias("n_words"), _without(text, " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(judged: DataFrame, limit: float = 0.5, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_failed) from rows with base_failed.

    The failure rates of all hosts give a beta prior by their mean and
    variance; a host's rate is shrunk towards it, so that a few bad documents
    of a small host don't condemn it. Hosts above `limit` fail. Where the rates
    don't vary more than chance gives, the prior weighs as much as all rows; it
    weighs two rows at least.
    Rows are counted before they are shuffled; one row per host and one row of
    sums move on. A null host is a host of its own.
    """
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, x = F.col("n_docs"), F.col("n_failed")
    prior = hosts.agg(
        F.sum(n).alias("_n"), (F.sum(x) / F.sum(n)).alias("_mean"), F.count("*").alias("_k"), F.sum(x * x / n).alias("_sq"), F.sum(n * n).alias("_nn"))
    # variance between hosts beyond that of chance, by the weighted sum of squares
    mean, total, k = F.col("_mean"), F.col("_n"), F.col("_k")
    chance = mean * (1 - mean)
    between = (F.col("_sq") - total * mean * mean - (k - 1) * chance) / F.when(total * total > F.col("_nn"), total - F.col("_nn") / total)
    weight = F.when((between > 0) & (chance > between), chance / between - 1).when(between >= chance, F.lit(2.0)).otherwise(total.cast("double"))
    sums = prior.select(mean.alias("mean"), F.coalesce(F.greatest(weight, F.lit(2.0)), F.lit(2.0)).alias("weight")).first()
    alpha, size = (sums["mean"] or 0.0) * sums["weight"], sums["weight"]
    rate = (x + alpha) / (n + size)
    return hosts.select("_host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > limit).alias("host_failed"))


def judge(docs: DataFrame, limit: float = 0.5, host: str = "source") -> DataFrame:
    """doc_id, host and `figures` of each row with base_failed, host_rate and kept: neither the document nor its host fails.

    The figures are written once to the shared folder, without the texts, and
    serve both the hosts' sums and the join back. Repeated rows and ids are
    rows of their own; an empty table gives no rows.
    """
    narrow = figures(docs.select("doc_id", F.col(host), F.col("text"))).drop("text")
    judged = materialize(narrow.withColumn("base_failed", base_failed()), "figures")
    verdicts = host_verdicts(judged, limit, host)
    joined = judged.join(verdicts, judged[host].eqNullSafe(verdicts["_host"]))
    return joined.select(*judged.columns, "host_rate", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


#: DuckDB's form over `documents`
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
f AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM b GROUP BY source),
p AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) AS sq, sum(n * n) AS nn FROM h),
v AS (SELECT *, m * (1 - m) AS c, (sq - n * m * m - (k - 1) * m * (1 - m)) / CASE WHEN n * n > nn THEN n - nn / n END AS s FROM p),
q AS (SELECT m, greatest(coalesce(CASE WHEN s > 0 AND c > s THEN c / s - 1 WHEN s >= c THEN 2 ELSE n END, 2), 2) AS a FROM v),
u AS (SELECT h.source, (x + m * a) / (n + a) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.5 AS kept
FROM b JOIN u ON b.source IS NOT DISTINCT FROM u.source
"""
