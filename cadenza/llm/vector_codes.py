"""Vector codes: codebooks per part of the vectors, fitted and applied through tries over the distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.joins import join_table
from cadenza.session import materialize

#: components at or beyond this are left out: squared distances of whole vectors then fit a long
LIMIT = 1 << 27


def _kept(vectors: DataFrame, parts: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): whole components of the vectors that can be coded, of any length that has `parts` equal parts."""
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = vectors.filter(vector.isNotNull() & fine & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))


def leaves_of(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, common leading components with the row before, copies, leaf of each row)."""
    order = np.lexsort(part.T[::-1])
    rows = part[order]
    differs = rows[1:] != rows[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), part.shape[1])
    new = np.concatenate([[True], shared < part.shape[1]])
    leaf = np.empty(len(part), np.int64)
    leaf[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return rows[at], np.concatenate([[0], shared])[at], np.diff(np.append(at, len(part))), leaf


def nearest_entries(leaves: np.ndarray, shared: np.ndarray, entries: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each leaf of a trie over lexicographically ordered distinct parts; ties to the lower entry.

    The trie is walked depth first. A node hands its children the distances of
    its prefix to all entries, so the dimensions of a common prefix are added
    up once. Neighbouring children with at most `block` leaves together are
    finished level by level, larger ones are entered: what is held is a vector
    for each level and one block of leaves.
    """
    n, d = leaves.shape
    best, least = np.empty(n, np.int64), np.empty(n, np.int64)

    def finish(lo: int, hi: int, depth: int, held: np.ndarray) -> None:
        for a in range(lo, hi, block):
            b = min(a + block, hi)
            nodes, owner = held[None, :], np.zeros(b - a, np.int64)
            for level in range(depth, d):
                new = shared[a:b] <= level
                new[0] = True
                at = np.flatnonzero(new)
                nodes = nodes[owner[at]] + np.square(leaves[a + at, level][:, None] - entries[:, level][None, :])
                owner = np.cumsum(new) - 1
            best[a:b] = nodes.argmin(axis=1)
            least[a:b] = nodes.min(axis=1)

    def walk(lo: int, hi: int, depth: int, held: np.ndarray) -> None:
        if hi - lo <= block or depth == d - 1:
            finish(lo, hi, depth, held)
            return
        at = lo + np.flatnonzero(np.concatenate([[True], shared[lo + 1:hi] <= depth]))
        ends = np.append(at[1:], hi)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, at[i] + block, "right")))
            if j > i + 1 or ends[i] - at[i] <= block:
                finish(int(at[i]), int(ends[j - 1]), depth, held)
            else:
                walk(int(at[i]), int(ends[i]), depth + 1, held + np.square(leaves[at[i], depth] - entries[:, depth]))
            i = j

    if n:
        walk(0, n, 0, np.zeros(len(entries), np.int64))
    return best, least


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches put together up to about `rows` rows, with their components."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield held, _matrix(held, dims)
            held, n = [], 0
    if held:
        yield held, _matrix(held, dims)


def _matrix(held: list[pa.RecordBatch], dims: int) -> np.ndarray:
    return np.concatenate([np.asarray(b.column("v").flatten(), np.int64).reshape(-1, dims) for b in held])


def _totals(books: np.ndarray, rows: int):
    """Per part and entry, the number and the componentwise sums of the parts that a task assigns to it."""
    parts, size, d = books.shape

    def run(batches):
        count, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, d), np.int64)
        for _, v in _blocks(batches, parts * d, rows):
            for p in range(parts):
                leaves, shared, copies, _ = leaves_of(v[:, p * d:(p + 1) * d])
                entry, _ = nearest_entries(leaves, shared, books[p])
                np.add.at(count[p], entry, copies)
                np.add.at(sums[p], entry, leaves * copies[:, None])
        p, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * d, pa.int32()), pa.array(sums[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray, rows: int):
    """Code and error of each vector."""
    parts, _, d = books.shape

    def run(batches):
        for held, v in _blocks(batches, parts * d, rows):
            code, error = np.empty((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
            for p in range(parts):
                leaves, shared, _, leaf = leaves_of(v[:, p * d:(p + 1) * d])
                entry, distance = nearest_entries(leaves, shared, books[p])
                code[:, p] = entry[leaf]
                error += distance[leaf]
            text, at = code.tobytes().hex(), 0
            for b in held:
                n = b.num_rows
                codes = pa.array([text[i * 2 * parts:(i + 1) * 2 * parts] for i in range(at, at + n)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), codes, pa.array(error[at:at + n])], names=["vec_id", "label", "code", "error"])
                at += n

    return run


def fit(kept: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, rows: int = 65_536) -> np.ndarray | None:
    """Codebooks (part, entry, component) over all rows of `kept` (vec_id, v); None without rows.

    They start as the parts of the `size` lowest ids (equal ids by components,
    a null id last; fewer where there are fewer). A round sends every vector
    through the tries of its task; only sums per part and entry are shuffled,
    and parts * size rows of them reach the driver.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).collect()
    if not first:
        return None
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    d = books.shape[2]
    for _ in range(rounds):
        told = kept.select("v").mapInArrow(_totals(books, rows), "part int, entry int, n long, sums array<long>")
        summed = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)])
        books = books.copy()
        for r in summed.collect():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return books


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))


def codable(vectors: DataFrame, parts: int = 16, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the vectors that are coded, written once: components are floor(scale * x).

    Left out are vectors that are null or empty, hold a null or non-finite
    component or one of LIMIT or more after scaling (its squared distances
    pass a long), whose length is not divisible by `parts`, or differs from
    that of the lowest id.
    """
    all_ = materialize(_kept(vectors, parts, scale, id_col, vector_col, label_col), "vectors")
    lowest = all_.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    return all_.filter(F.size("v") == len(lowest[0]["v"])) if lowest else all_


def compress(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256, rows: int = 65_536, small_table: int = 100_000,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that `codable` keeps.

    code: indexes of the nearest entries in part order, two hex digits each;
    error: their squared distances summed; label_error: error summed over the
    rows of equal label, null labels together. Repeated rows count each and
    all come back. Each task holds `rows` vectors, whose distinct parts form
    one trie per part: no part is shuffled. At most 256 entries (`size`). An
    empty table, or one without a vector to code, gives no rows. Other columns
    are not read.
    """
    if size > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    kept = codable(vectors, parts, scale, id_col, vector_col, label_col)
    books = fit(kept, parts, size, rounds, rows)
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialize(kept.mapInArrow(_coded(books, rows), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "codes")
    named = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("name"))
    sums = materialize(coded.groupBy(named(F.col("label")).alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    both = join_table(coded.withColumn("_label", named(F.col("label"))), sums, ["_label"], sums.count(), ["code", "error", "vec_id"], small=small_table)
    return both.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector of whole components that a code stands for."""
    parts = books.shape[0]
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(
        F.get(table, p), F.conv(F.substr(code, p * 2 + 1, F.lit(2)), 16, 10).cast("int"))))


ORACLE = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
cut AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS part FROM kept, range(16) AS r(p)),
u AS MATERIALIZED (SELECT p, part, count(*) AS n FROM cut GROUP BY p, part),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM cut
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED (
  SELECT p, part, n, min({'d': list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))), 'e': e}) AS b
  FROM u JOIN c0 USING (p) GROUP BY p, part, n),
t0 AS (SELECT p, b.e AS e, i, sum(part[i] * n)::BIGINT AS s, sum(n)::BIGINT AS m FROM a0, range(1, 5) AS r(i) GROUP BY ALL),
m0 AS (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS entry FROM t0 GROUP BY p, e),
c1 AS MATERIALIZED (SELECT p, e, coalesce(m0.entry, c0.entry) AS entry FROM c0 LEFT JOIN m0 USING (p, e)),
a1 AS MATERIALIZED (
  SELECT p, part, n, min({'d': list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))), 'e': e}) AS b
  FROM u JOIN c1 USING (p) GROUP BY p, part, n),
t1 AS (SELECT p, b.e AS e, i, sum(part[i] * n)::BIGINT AS s, sum(n)::BIGINT AS m FROM a1, range(1, 5) AS r(i) GROUP BY ALL),
m1 AS (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS entry FROM t1 GROUP BY p, e),
c2 AS MATERIALIZED (SELECT p, e, coalesce(m1.entry, c1.entry) AS entry FROM c1 LEFT JOIN m1 USING (p, e)),
a2 AS MATERIALIZED (
  SELECT p, part, min({'d': list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))), 'e': e}) AS b
  FROM u JOIN c2 USING (p) GROUP BY p, part),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error
  FROM cut JOIN a2 USING (p, part) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM coded
"""
