"""Benchmark passages against a plain search over all windows, on odd texts and items."""

import collections
import hashlib
import re

import pytest

from cadenza.llm import decontamination

DOCS = "doc_id long, text string, key string, marks string, row string, words string, n_words string"
ITEMS = "item_id long, text string, span string, words string, mark string"
LONG = " ".join(f"w{i % 53}x{i % 19}" for i in range(400))
PASSAGE = "Alpha beta, gamma delta! epsilon zeta eta theta iota kappa lambda mu"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, passage in items:
            v = words(passage)
            n = min(window, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[i:i + n]:
                        hit.update(range(j, j + n))
                        found.add("null" if item_id is None else str(item_id))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def bag(rows):
    return collections.Counter(map(str, rows))


ODD_DOCS = [(1, None), (2, ""), (3, " ,.;\n"), (4, PASSAGE), (4, PASSAGE), (None, PASSAGE.upper()), (5, "x " * 3 + PASSAGE + " tail " + PASSAGE), (6, LONG), (7, "a " * 300),
            (8, "Öl İ short item here"), (9, PASSAGE[:-10]), (10, "one two three"), (11, "b\x00a a a a a a a a a a a c"), (12, "the alpha-beta_gamma delta epsilon zeta eta theta iota kappa"), (13, LONG[500:900] + " " + PASSAGE)]
ODD_ITEMS = [(1, PASSAGE), (1, "another text of the same item with over ten words in it"), (2, "a " * 14), (3, "short item"), (4, None), (5, ""), (6, "!!"), (None, LONG[300:800]), (7, "two"), (8, "a a a a a a a"), (9, PASSAGE)]


@pytest.mark.parametrize(("small", "gram"), [(100_000, 5), (0, 5), (100_000, 10), (100_000, 1)])
def test_odd_documents_equal_the_search(spark, small, gram):
    docs = spark.createDataFrame([(*r, "k", "m", "r", "w", "n") for r in ODD_DOCS], DOCS)
    items = spark.createDataFrame([(*r, "s", "w", "m") for r in ODD_ITEMS], ITEMS)
    got = decontamination.report(docs, items, gram=gram, small_table=small).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert bag(tuple(r) for r in got) == bag(brute(ODD_DOCS, ODD_ITEMS))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, PASSAGE, "k", "m", "r", "w", "n")], DOCS)
    assert decontamination.report(docs, spark.createDataFrame([(1, PASSAGE, "s", "w", "m")], ITEMS)).collect() == []
    assert [tuple(r) for r in decontamination.report(some, items).collect()] == brute([(1, PASSAGE)], [])


def test_every_span_of_ten_words_is_found_and_spans_name_their_items(spark):
    base = [f"q{i}" for i in range(60)]
    docs = spark.createDataFrame([(s, " ".join(["z1", "z2", *base[s:s + n], "z3"])) for s in range(0, 40) for n in (9, 10, 13)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(base))], "item_id long, text string")
    for r in decontamination.contaminated_words(docs, items).collect():
        n = r["n_words"] - 3
        assert (r["spans"] or []) == [(2 + i, 12 + i, 10, ["1"]) for i in range(n - 9)]
    few = decontamination.contaminated_words(docs.select("text"), items)
    assert few.count() == 120
