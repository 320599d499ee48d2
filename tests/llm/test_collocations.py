"""Collocations against a plain count, with split prefixes, open codes and odd texts."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import collocations

SCHEMA = "doc_id long, text string, lang string, c1 string, h string, word string, n string, _lang string, _text string"


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def brute(rows, least, top=2000, covered=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, *w[i:i + size]) for i in range(len(w) - size + 1))
    out = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(100 * b >= covered * a for (la, *v), b in f.items() if la == lang and len(v) == 3 and b >= least and w in (v[:2], v[1:])):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]


def bag(rows):
    return collections.Counter(map(str, rows))


def texts():
    rng = np.random.default_rng(8)
    vocabulary = ["the", "of", "über", "Ünit", "new", "york", "city", "x" * 300, "x" * 299 + "y", "#", "a b", "\U0001F600", "q\x1c"]
    share = np.array([40, 25, 9, 6, 5, 5, 5, 2, 2, 3, 3, 2, 3], float)
    rows = []
    for i in range(120):
        w = [vocabulary[j] for j in rng.choice(13, int(rng.integers(1, 60)), p=share / share.sum())]
        marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "]
        rows.append(("".join(x + marks[int(rng.integers(10))] for x in w), ["en", "de", None, "und", ""][i % 5]))
    rows += [("New York City " * 200, "en"), ("the " * 500, "en"), (None, "en"), ("", None), (" .,\n", "fr"), ("a b", "fr"), ("of the " * 300 + "end", None)] + [("Same copy of a text", "de")] * 30
    return rows


@pytest.mark.parametrize("options", [{}, {"budget": 40, "codes": 3, "limit": 300, "suffixes": 200}, {"budget": 400, "codes": 6, "limit": 5000, "small_table": 0}])
def test_counts_and_scores_equal_the_plain_count(spark, options):
    rows = texts()
    docs = spark.createDataFrame([(i, t, lang, "c", "h", "w", "n", "l", "t") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = collocations.collocations(docs, least=5, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert bag(tuple(r) for r in got) == bag(brute(rows, 5))


def test_only_the_first_come_back_with_ties_by_bytes(spark):
    rows = [(f"{a}{b} {a}zé.", "en") for a in "abcde" for b in "mné" for _ in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, least=3, top=7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert bag(tuple(r) for r in got) == bag(brute(rows, 3, top=7)) and len(got) == 7


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [(10**12 + i, 10**12 + 7 * i + 1, 10**12 + 3 * i + 2) for i in range(50)] + [(3 * 10**15, 3 * 10**15, 3 * 10**15), (10, 3 * 10**7, 10**8)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", collocations.score(F.col("a"), F.col("l"), F.col("r")))
    assert [r["s"] for r in df.collect()] == [1_000_000 * a * a // (l * r) for a, l, r in rows]


def test_nothing_to_count(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_packed_suffixes_read_back():
    rng = np.random.default_rng(2)
    c = [np.where(rng.random(900) < 0.2, collocations._OPEN | rng.integers(0, 50, 900), rng.integers(-1, collocations._PLACES, 900)) for _ in range(3)]
    n = rng.integers(1, 1 << 31, 900)
    assert all((a == b).all() for a, b in zip(collocations.unpack(collocations.pack(c, n)), [*c, n], strict=True))


def test_leaf_totals():
    c = [np.array([1, 1, 1, 2, 2]), np.array([1, 1, 3, 3, 3]), np.array([-1, 4, 4, 4, 5])]
    nodes = collocations.subtree(c, np.array([2, 3, 5, 7, 11]))
    assert [(a.tolist(), t.tolist()) for a, t in nodes] == [([0, 3], [10, 18]), ([0, 2, 3], [5, 5, 18]), ([0, 1, 2, 3, 4], [2, 3, 5, 7, 11])]
