"""Graphs repaired to one degree: always regular, simple, with the links that can stay, and connected if they were."""

import random
from collections import Counter

import pytest
from millrace.operators import overlay
from millrace.operators.repair import repaired


def start(n, k, seed):
    """A graph with degrees of at most k: some of a regular one's links, and some others."""
    rng, degree, out = random.Random(seed), Counter(), set()
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    rng.shuffle(pairs)
    for a, b in pairs[: rng.randint(0, len(pairs))]:
        if degree[a] < k and degree[b] < k:
            out.add((a, b))
            degree[a] += 1
            degree[b] += 1
    return sorted(out)


def reached(n, edges):
    seen, todo = {0}, [0]
    while todo:
        u = todo.pop()
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == u and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return len(seen) == n


def check(spark, n, k, edges):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = [tuple(r) for r in repaired(nodes, spark.createDataFrame(edges, "a long, b long"), k).collect()]
    assert len(set(got)) == len(got) == n * k // 2 and all(a < b for a, b in got)
    assert k == 0 or Counter(x for e in got for x in e) == dict.fromkeys(range(n), k)
    if reached(n, edges):
        assert reached(n, got)
    return got


@pytest.mark.parametrize(("n", "k", "seed"), [(7, 4, 2), (8, 5, 3)])
def test_any_start_ends_regular(spark, n, k, seed):
    check(spark, n, k, start(n, k, seed))


def test_links_that_fit_stay(spark):
    ring = [(i, (i + 1) % 30) for i in range(30)]
    got = check(spark, 30, 4, ring)
    assert len({(min(e), max(e)) for e in ring} & set(got)) >= 28


def test_two_that_know_each_other_need_a_swap(spark):
    # all nodes of a 3-regular prism but two linked ones have their degree
    prism = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)]
    halves = [(a + 6, b + 6) for a, b in prism]
    check(spark, 12, 3, prism[:-1] + halves)
    check(spark, 4, 0, [])


def test_what_cannot_be(spark):
    nodes, none = spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame([], "a long, b long")
    for k in (3, 5, -1):
        with pytest.raises(ValueError):
            repaired(nodes, none, k)
    with pytest.raises(ValueError, match="already"):
        repaired(nodes, spark.createDataFrame([(0, i) for i in range(1, 5)], "a long, b long"), 2)
    assert overlay.degrees(repaired(nodes.limit(0), none, 0)).isEmpty()
