"""The registered searches over rows of their own: long lists, and every row asked."""

import random

import duckdb
import pytest

import __spark_entry__ as entry


def table(spark, folder, rows):
    """A folder with these (vec_id, label, embedding) as its `embeddings`."""
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def long_list(spark, tmp_path_factory):
    # equal vectors of one label, more than 10 000, whose ids are divisible by 100; no list takes the rows without a label
    rows = [*[(100 * i, 3, [1.0, 2.0]) for i in range(10_050)], *[(10_000_000 + 100 * i, None, [1.0, 2.0]) for i in range(5)]]
    return table(spark, tmp_path_factory.mktemp("long"), rows)


def test_a_long_list_keeps_its_recent_picks(spark, long_list):
    rows = entry.queries()["v06_mmr_selection"](spark, long_list).orderBy("query_id").collect()
    assert len(rows) == 10_050 and {r.label for r in rows} == {3}
    # only the first step of a list has shown nothing yet
    assert [r.score for r in rows] == [1.0] + [0.6] * 10_049
    # ten picks are held back, so eleven take turns
    assert [r.picked for r in rows] == [100 * (i % 11) for i in range(10_050)]


def test_a_long_list_never_picks_a_clip_twice(spark, long_list):
    rows = entry.queries()["m16_two_stage_selection"](spark, long_list).orderBy("query_id").collect()
    assert len(rows) == 10_050 and {r.label for r in rows} == {3}
    assert sorted(r.picked for r in rows[:100]) == [100 * i for i in range(100)]
    # the 100 candidates of a step are used up then: the lowest unused clip, to the end of the list
    assert [(r.picked, r.score) for r in rows[100:]] == [(100 * i, 0.5) for i in range(100, 10_050)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    # ids of every remainder, so that a query set cut by the id stands out
    rng = random.Random(11)
    return table(spark, tmp_path_factory.mktemp("vectors"), [(i, i % 3, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)])


def compared(spark, folder, name):
    """Rows of a query as sorted tuples by column name, and those of its oracle statement."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    sides = df.select(*names).collect(), cur.fetchall()
    return names, *(sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in side) for side in sides)


@pytest.mark.parametrize("name,asked,per_row", [
    ("v02_exact_neighbours", "query_id", 10),
    ("v07_batch_best_with_exclusions", "query_id", 1),
    ("v08_continuity_rerank", "query_id", 1),
    ("v13_search_with_exclusions", "query_id", 5),
    ("m16_coarse_and_stateless_terms", "query_id", 10),
])
def test_every_row_is_asked(spark, vectors, name, asked, per_row):
    names, got, want = compared(spark, vectors, name)
    assert got == want
    at = names.index(asked)
    assert {r[at] for r in got} == set(range(120)) and len(got) == 120 * per_row


def test_recall_is_held_for_every_row(spark, vectors):
    names, got, want = compared(spark, vectors, "v03_recall")
    assert got == want and len(got) == 10
    assert {r[names.index("n_neighbours")] for r in got} == {120}
    found = entry.queries()["v03_approximate_neighbours"](spark, vectors).collect()
    assert {r.query_id for r in found} == set(range(120))


def test_every_row_gets_its_similar_clips(spark, vectors):
    names, got, want = compared(spark, vectors, "v04_similar_clips")
    assert got == want
    # similarities under 0.3 are left out, so a clip may have fewer than ten
    assert {r[names.index("clip_id")] for r in got} == set(range(120))


@pytest.mark.parametrize("name", ["v06_mmr_selection", "m16_two_stage_selection"])
def test_every_row_is_a_step_of_its_list(spark, vectors, name):
    names, got, want = compared(spark, vectors, name)
    assert got == want
    assert sorted((r[names.index("label")], r[names.index("query_id")]) for r in got) == sorted((i % 3, i) for i in range(120))
