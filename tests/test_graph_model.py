"""Traversal by joins and windows against a sequential model on random graphs."""

import random

import pytest

from codeloom.operators.graph import traverse
from tests.rows import edges, symbols


def model(ids, rows, root, depth, limit, kinds, cap):
    rows = sorted(r for r in rows if r[1] in ids and r[2] in ids)
    nodes, kept, frontier, truncated = [root], set(), [root], False
    for _ in range(depth):
        new = []
        for node in sorted(frontier):
            near = [r for r in rows if r[1] == node] + [r for r in rows if r[2] == node and r[1] != node]
            near = [r for r in near if not kinds or r[3] in kinds]
            truncated |= len(near) > cap
            for r in near[:cap]:
                if r[0] in kept:
                    continue
                other = r[2] if r[1] == node else r[1]
                if other not in nodes:
                    if len(nodes) >= limit:
                        truncated = True
                        continue
                    nodes.append(other)
                    new.append(other)
                kept.add(r[0])
        frontier = new
    return set(nodes), kept, truncated


@pytest.mark.parametrize("seed", range(6))
def test_same_as_model(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(rng.randint(3, 12))]
    rows = [(f"e{i:02d}", rng.choice(ids), rng.choice([*ids, "gone"]), rng.choice(["calls", "references"])) for i in range(rng.randint(4, 30))]
    depth, limit, cap = rng.randint(1, 3), rng.randint(1, 10), rng.choice([2, 3, 500])
    kinds = rng.choice([None, ["calls"]])
    found = traverse(symbols(spark, *[(i, i, "a.cs") for i in ids]), edges(spark, *rows), ids[0], depth, limit, kinds, cap)
    ours = {r["id"] for r in found.nodes.collect()}, {r["id"] for r in found.edges.collect()}, found.truncated
    assert ours == model(set(ids), rows, ids[0], depth, limit, kinds, cap)


def test_unknown_root(spark):
    found = traverse(symbols(spark, ("a", "A", "a.cs")), edges(spark), "b")
    assert found.nodes.count() == 0 and not found.truncated
