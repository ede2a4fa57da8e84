"""Shortest hops and relays on deep graphs, against plain walks."""

import random
from collections import Counter, deque

from millrace.operators import overlay
from pyspark.sql import functions as F

from .test_rooted import random_tree, walk


def plain(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, todo = {start: 0}, deque([start])
    while todo:
        u = todo.popleft()
        for v in near.get(u, ()):
            if v not in depth:
                depth[v] = depth[u] + 1
                todo.append(v)
    out = {start: (0, None, None)}
    for v in sorted(depth, key=depth.get)[1:]:
        p = min(u for u in near[v] if depth[u] == depth[v] - 1)
        out[v] = (depth[v], p, out[p][2] if p != start else v)
    return out


def test_hops_across_blocks(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(61), rng.randrange(61)) for _ in range(9)] + [(100, 101), (5, 5)]
    got = overlay.breadth_first(spark.createDataFrame(edges, "a long, b long"), 7, block=8).collect()
    assert {r["node"]: tuple(r)[1:] for r in got} == plain(edges, 7) and len(got) == 61


def test_a_deep_ring_takes_few_rounds(spark, monkeypatch):
    rounds, keep = [], overlay.kept
    monkeypatch.setattr(overlay, "kept", lambda df: rounds.append(1) or keep(df))
    n = 3_000
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    assert overlay.levels(ring, 1).agg(F.max("depth"), F.count("*")).first()[:] == (n // 2, n) and len(rounds) < 10


def test_relays_are_inner_nodes_of_ways(spark):
    rng = random.Random(8)
    edges = random_tree(70, 5, near=4) + [(200, 201)]
    up = {v: p for v, (_, p, _) in walk(edges, 3).items()}
    messages, want = [(rng.randrange(12), rng.randrange(72)) for _ in range(60)] + [(200, 201), (5, 5)], Counter()
    for s, t in messages:
        if s in up and t in up and s != t:
            ways = []
            for x in (s, t):
                way = [x]
                while up[way[-1]] is not None:
                    way.append(up[way[-1]])
                ways.append(way)
            meet = next(x for x in ways[0] if x in ways[1])
            way = ways[0][: ways[0].index(meet)] + ways[1][: ways[1].index(meet) + 1]
            want.update(x for x in way if x not in (s, t))
    got = overlay.relays(spark.createDataFrame(messages, "source long, sink long"), spark.createDataFrame(edges, "a long, b long"), 3).collect()
    assert {r["node"]: r["relayed_count"] for r in got} == dict(want) and len(got) == len(want)
