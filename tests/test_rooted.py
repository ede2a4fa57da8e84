"""Trees rooted by a tour, against a plain walk."""

import random
from collections import deque

import pytest
from millrace.operators import overlay
from pyspark.sql import functions as F


def walk(edges, root):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, queue = {root: (0, None, None)}, deque([root])
    while queue:
        u = queue.popleft()
        for v in near.get(u, []):
            if v not in out:
                out[v] = (out[u][0] + 1, u, out[u][2] if out[u][2] is not None else v)
                queue.append(v)
    return out


def random_tree(n, seed, near=None):
    rng = random.Random(seed)
    return [(i, rng.randrange(max(0, i - (near or i)), i)) for i in range(1, n)]


CASES = {
    "star from a leaf": ([(0, i) for i in range(1, 50)], 7),
    "deep": (random_tree(120, 2, near=2), 60),
    "a forest": (random_tree(30, 3) + [(a + 100, b + 100) for a, b in random_tree(40, 4)], 0),
    "no such node": ([(1, 2)], 9),
    "none": ([], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_rooted_is_a_walk(spark, name):
    edges, root = CASES[name]
    got = overlay.rooted(spark.createDataFrame(edges, "a long, b long"), root).collect()
    assert {r["node"]: (r["depth"], r["parent"], r["first_hop"]) for r in got} == walk(edges, root) and len(got) == len(walk(edges, root))


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds, keep = [], overlay.kept
    monkeypatch.setattr(overlay, "kept", lambda df: rounds.append(1) or keep(df))
    n = 4_001
    tree = spark.range(n - 1).select((F.col("id") * 2003 % n).alias("a"), ((F.col("id") + 1) * 2003 % n).alias("b"))
    got = overlay.rooted(tree, 0)
    assert got.agg(F.max("depth"), F.count("*"), F.count_distinct("first_hop")).first()[:] == (n - 1, n, 1) and len(rounds) < 40
