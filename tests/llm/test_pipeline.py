"""The five stages on odd rows, and the trees of the classifier walked by hand."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import quality_model

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, _text string, key string, size string, score string, taken string"
GOOD = "The river ran past the old mill and the children walked along its bank. "
BAD = "$$$ ||| ### buy buy buy !!! <<<>>> %%% "


def rows():
    out = [(i, (GOOD + f"Day {i} was mild, number {i * 7}. ") * 8 if i % 2 else BAD * (6 + i % 5), "en", f"s{i % 3}") for i in range(200)]
    out += [(300, None, None, None), (301, "", "en", "s0"), (302, GOOD * 3000, "en", "s1"), (303, out[1][1], "en", "s0"), (303, out[1][1], "en", "s0"), (None, GOOD * 9, "en", None),
            (304, GOOD * 8 + "password: hunter2hunter2hunter2", "en", "s1")]
    return [(*r, len(r[1] or ""), "r", "t", "k", "s", "x", "n") for r in out]


@pytest.fixture()
def folder(spark, tmp_path):
    docs = spark.createDataFrame([(a, b, c, d, *rest) for a, b, c, d, *rest in rows()], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_their_promises(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        seen.append(docs.select("doc_id", "text", "source").collect())
    good = {r["doc_id"] for r in seen[0] if r["doc_id"] is not None and r["doc_id"] < 200}
    assert good == {i for i in range(200) if i % 2}
    assert len([r for r in seen[1] if r["doc_id"] in (1, 303)]) <= 1 and len(seen[1]) <= len(seen[0])
    assert not any("hunter2hunter2" in (r["text"] or "") for r in seen[2]) and len(seen[2]) == len(seen[1])
    assert {r["text"] for r in seen[3]} <= {r["text"] for r in seen[2]}
    packed = corpus_pipeline.run(spark, folder).collect()
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables_run_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_scores_with_a_column_named_as_the_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    out = quality_model.score(docs, model)
    assert out.count() == len(rows()) and out.select("_text").distinct().collect()[0][0] == "t" and out.filter(F.col("score").isNull()).count() == 0


def test_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] + x[:, 4] > 0.4)).astype(float)
    trees = quality_model.fit(x, y, rounds=20)
    for row, got in zip(x[:60], trees.scores(x[:60]), strict=True):
        total = trees.start
        for root in trees.roots:
            node = root
            while trees.left[node] != node:
                node = trees.left[node] + (1 if row[trees.feature[node]] > trees.threshold[node] else 0)
            total += trees.value[node]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.9 and zlib.crc32(b"1") % 3 in (0, 1, 2)
