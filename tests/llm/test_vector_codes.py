"""Vector codes against a plain loop, on odd vectors and ties."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v string, _label string, error long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "v", "l", 1) for i, v, label in rows], SCHEMA)


def brute(rows, parts=4, size=3, rounds=2, scale=256):
    """The contract as loops over Python integers."""
    whole = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
             if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    if not whole:
        return []
    d = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(v, p) for _, v, _ in whole[:size]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        got = collections.defaultdict(list)
        for _, v, _ in whole:
            for p in range(parts):
                got[p, near(p, cut(v, p))[1]].append(cut(v, p))
        for (p, e), members in got.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, "".join(f"{near(p, cut(v, p))[1]:02x}" for p in range(parts)), sum(near(p, cut(v, p))[0] for p in range(parts)), label) for i, v, label in whole]
    by = collections.Counter()
    for _, _, e, label in out:
        by[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by[label], sha) for i, c, e, label in out]


def bag(rows):
    return collections.Counter(map(str, rows))


ODD = [(5, [0.5, -0.25, 0.001, 3.0, 2.0, -7.5, 0.0, 1.0], 1), (3, [0.5, -0.25, 0.001, 3.0, 2.0, -7.5, 0.0, 1.0], None), (4, None, 1), (6, [], 2), (7, [float("nan")] * 8, 1),
       (8, [1.0] * 7 + [None], 1), (9, [1.0] * 7 + [float("inf")], 3), (10, [0.25] * 8, 3), (10, [0.25] * 8, 3), (None, [0.75] * 8, 3), (11, [0.1] * 12, 1), (12, [0.1] * 6, 1),
       (13, [-0.25] * 8, None), (2, [0.0] * 8, 2), (14, [1e30] * 8, 2), (1, [0.25, 0.0] * 4, 2)]


@pytest.mark.parametrize("small", [100_000, 0])
def test_odd_vectors_equal_the_loop(spark, small):
    got = vector_codes.compress(frame(spark, ODD), parts=4, size=3, small_table=small).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert bag(tuple(r) for r in got) == bag(brute([r for r in ODD if r[0] != 14]))


def test_copies_and_ties_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    some = [[int(x) / 256 for x in rng.integers(-4, 5, 8)] for _ in range(40)]
    rows = [(int(i), some[0] if i % 3 == 0 else some[int(rng.integers(40))], int(i) % 2) for i in rng.permutation(400)]
    got = vector_codes.compress(frame(spark, rows).repartition(5), parts=4, size=7, rows=32).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert bag(tuple(r) for r in got) == bag(brute(rows, size=7))


def test_nothing_to_code(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [], 1)])).collect() == []


def test_tries_equal_plain_distances():
    rng = np.random.default_rng(9)
    for d, block in ((1, 3), (4, 5), (4, 4096), (6, 2)):
        part, entries = rng.integers(-3, 4, (500, d)), rng.integers(-3, 4, (9, d))
        leaves, shared, copies, leaf = vector_codes.leaves_of(part)
        assert (leaves[leaf] == part).all() and copies.sum() == 500 and len(np.unique(part, axis=0)) == len(leaves)
        entry, distance = vector_codes.nearest_entries(leaves, shared, entries, block)
        plain = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (entry == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_codes_read_back(spark):
    rows = [(i, [((i * 7 + j * 3) % 11) / 256 for j in range(8)], 0) for i in range(30)]
    kept = vector_codes.codable(frame(spark, rows), parts=4)
    books = vector_codes.fit(kept, parts=4, size=30)
    out = vector_codes.compress(frame(spark, rows), parts=4, size=30).select("vec_id", "error", vector_codes.decoded(F.col("code"), books).alias("back")).join(
        kept.select("vec_id", "v"), "vec_id").collect()
    assert len(out) == 30 and all(sum((a - b) ** 2 for a, b in zip(r["v"], r["back"], strict=True)) == r["error"] for r in out)
