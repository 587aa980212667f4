"""Parts of the Jaccard join: batches and counts without Spark, and components by both ways."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

op9 = pytest.importorskip("codeloom.llm.op09_jaccard_join")
from codeloom.llm.common import components  # noqa: E402


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_shared_shingles_come_back_in_global_order(ranges):
    rng = random.Random(3)
    common, texts = [f"c{i}" for i in range(30)], [None, "", "one"]
    for _ in range(60):
        texts.append(" ".join(rng.choices(common, k=rng.randint(0, 40)) + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]))
    texts += [texts[5]] * 40
    made, batches = [], op9.Batches(2, ranges, 1)
    for i, t in enumerate(texts):
        batches.add(None if i == 3 else i, t)
        if i % 25 == 24:
            made.append(batches.rows())
    made.append(batches.rows())
    rows = pa.Table.from_batches(made).sort_by("range")
    assert len(set(rows["batch"].to_pylist())) == len(made)
    found = pa.Table.from_batches(op9.count_ranges(iter(rows.to_batches()))).to_pandas()
    got = pd.concat([op9.assembled(part, 80, 100) for _, part in found.groupby("batch")]).reset_index(drop=True)
    shingler = op9.Shingler(2)
    sets = [set(shingler.set(t).tolist()) for t in texts]
    held = {}
    for s in sets:
        for x in s:
            held[x] = held.get(x, 0) + 1
    assert got["n"].tolist() == [len(s) for s in sets] and got["doc_id"].isna().sum() == 1
    for s, row in zip(sets, got.itertuples(index=False), strict=True):
        shared = sorted((op9.level_of(np.array([held[x]]))[0], x) for x in s if held[x] > 1)
        base = len(s) - -(-80 * len(s) // 100)
        if not s or base + 1 <= len(s) - len(shared):
            assert row.shared is None and row.prefix is None
            continue
        assert row.shared.view(np.uint64).tolist() and sorted(row.shared.view(np.uint64).tolist()) == sorted(x for _, x in shared)
        k = base + row.matches - (len(s) - len(shared))
        assert row.prefix.view(np.uint64).tolist() == [x for _, x in shared[:k]]
        assert row.pos.tolist() == list(range(len(s) - len(shared), base + row.matches))


def test_levels_keep_the_order_of_counts():
    counts = np.unique(np.geomspace(1, 10**9, 500).astype(np.int64))
    levels = op9.level_of(counts)
    assert (np.diff(levels.astype(int)) >= 0).all() and (levels[:20] == counts[:20]).all()
    assert np.allclose(op9.documents_of(levels[counts < 10**8]) / counts[counts < 10**8], 1, atol=0.13)


@pytest.mark.parametrize("most", [10, 10_000])
def test_components_by_both_ways(spark, most):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(7, i) for i in range(2000, 2100)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    rng.shuffle(edges)
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), most=most)
    assert {r["id"]: r["component_id"] for r in got.collect()} == {v: root(v) for v in list(parent)}


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w"), (None, "a b c d e f g h"), (3, "x"), (3, "x")]
    got = op9.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 6, 0), (1, 6, 1), (1, 6, 1), (2, 6, 1), (3, 1, 3), (3, 1, 3)]
