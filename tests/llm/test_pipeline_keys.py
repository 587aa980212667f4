"""Rows of the pipeline's similarity stage that share a doc_id."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_rows_that_share_a_doc_id_go_only_as_copies(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    # 7 has a text of its own, a copy of 1 and the same row again; 8 has two unrelated texts.
    rows = [(1, a, "x"), (7, b, "x"), (7, a, "x"), (7, b, "x"), (8, c, "x"), (8, d, "y"), (9, d + " more", "x"), (None, a, "x")]
    got = pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (7, b), (8, c), (8, d), (0, a)])
