"""The forest against brute force: recall near the bar, components, and leaves that don't grow."""

import numpy as np
import pandas as pd
import pytest

op2 = pytest.importorskip("codeloom.llm.op02_embedding_dedup")


def near_pairs(rng, n, dim, cosine):
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


def brute(x, labels):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= op2.COSINE) & np.equal.outer(labels, labels)
    np.fill_diagonal(near, False)
    to = np.arange(len(x))
    while True:
        least = np.minimum(to, np.where(near, to[None, :], len(x)).min(axis=1))
        if np.array_equal(least, to):
            return near.sum(axis=1), to
        to = least


def test_links_and_components_near_the_bar(spark):
    rng = np.random.default_rng(7)
    parts = [near_pairs(rng, 500, 24, c) for c in (0.925, 0.9305, 0.935, 0.94, 0.95, 0.99)]
    chain = [rng.standard_normal(24)]
    for _ in range(60):
        chain.append(near_pairs(rng, 1, 24, 0.945)[0][0])
    x = np.concatenate([v for pair in parts for v in pair] + [np.array(chain)])
    base = rng.standard_normal(24)
    x = np.concatenate([x, base + 0.045 * rng.standard_normal((400, 24)) * np.arange(1, 401)[:, None] / 100])
    labels = rng.integers(0, 2, len(x))
    labels[: 6000] = np.repeat(np.arange(6), 1000) // 3
    rows = [(i, [float(v) for v in e], int(k), 1.0, "v") for i, (e, k) in enumerate(zip(x, labels, strict=True))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, times double, key string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op2.embedding_links(frame).collect()}
    links, to = brute(x, labels)
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()
    same = [got[i][1] == to[i] for i in range(len(x))]
    assert np.mean(same) > 0.999
    if found.sum() == links.sum():
        assert all(same)


def test_recall_of_the_trees():
    """Pairs just above the bar among 20,000 others share a leaf; so many trees as the depth asks for."""
    rng = np.random.default_rng(1)
    x, y = near_pairs(rng, 3000, 64, 0.931)
    back = rng.standard_normal((14_000, 64))
    unit = np.concatenate([back / np.linalg.norm(back, axis=1, keepdims=True), x, y])
    met = np.zeros(3000, dtype=bool)
    spill = op2.margin(op2.COSINE, 64)
    trees = op2.trees_for(len(unit))
    copies = 0
    for t in range(trees):
        rows, nodes = op2.route(op2.fit(unit, t, 1.0, spill), t, unit, spill)
        copies += len(rows) / len(unit)
        pairs = pd.DataFrame({"row": rows, "node": nodes})
        a, b = pairs[pairs.row.between(14_000, 16_999)], pairs[pairs.row >= 17_000]
        both = a.assign(pair=a.row - 14_000).merge(b.assign(pair=b.row - 17_000), on=["pair", "node"])
        met[both.pair.unique()] = True
    assert met.mean() >= 0.999 and copies < 24


def test_leaves_do_not_grow_with_the_input():
    """Splits fitted on 2,000 vectors and 200,000 routed: large leaves are split on by their own."""
    rng = np.random.default_rng(2)
    unit = rng.standard_normal((200_000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    spill = op2.margin(op2.COSINE, 16)
    rows, nodes = op2.route(op2.fit(unit[:2000], 0, 100.0, spill), 0, unit, spill)
    sizes = np.bincount(nodes)
    assert sizes.max() > 2 * op2.LEAF
    at = int(sizes.argmax())
    own = rows[nodes == at]
    part = pd.DataFrame({"node": own, "label": "a", "dim": 16, "key": at, "v": [b"\x08" + unit[i].tobytes() for i in own]})
    split = op2.split_on(part, op2.COSINE)
    assert set(split["node"]) == set(own) and split.groupby("key").size().max() <= op2.LEAF


def test_shared_ids_and_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.001], 1), (3, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], None)]
    got = op2.embedding_links(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]
    assert op2.embedding_links(spark.createDataFrame([], schema)).count() == 0
