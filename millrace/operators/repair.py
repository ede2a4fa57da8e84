"""Graphs brought to one degree: nodes that lack links get them, those with fewest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored as kept
from .numbering import numbered
from .overlay import both_ways, canonical, is_connected, regular_edges

TRIES = 3  # rounds without a new link after which swaps begin


def lacking(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``(node, degree)`` of nodes with fewer than ``k`` links."""
    counted = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")).where(F.col("degree") < k)


def _paired(short: DataFrame, edges: DataFrame, k: int, n: int, salt: int) -> DataFrame:
    """New links of one round: free ends in order of degree, each with the one half their number further on.

    Ends of a degree stand in an order that changes with ``salt``.  A pair that
    is no link yet, and no node with itself, is taken; every end has one partner,
    so no node gets too many.
    """
    order = F.xxhash64("node", F.lit(salt))
    ends = short.select("node", "degree", order.alias("mixed"), F.explode(F.sequence(F.lit(1), (F.lit(k) - F.col("degree")).cast("int"))).alias("end"))
    placed = numbered(ends, ["degree", "mixed", "end"])
    half = n // 2
    low = placed.where(F.col("at") < half).select(F.col("node").alias("u"), "at")
    high = placed.where(F.col("at") >= half).select(F.col("node").alias("v"), (F.col("at") - half).alias("at"))
    pairs = low.join(high, "at").where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return pairs.join(edges, ["a", "b"], "left_anti")


def _outside(edges: DataFrame, node) -> DataFrame:
    """Nodes that ``node`` is linked to, and itself."""
    mine = both_ways(edges).where(F.col("a") == F.lit(node)).select(F.col("b").alias("near"))
    return mine.unionByName(mine.sparkSession.range(1).select(F.lit(node).cast(mine.schema["near"].dataType).alias("near")))


def _swaps(edges: DataFrame, u, v) -> DataFrame:
    """Links (x, y), x not next to u and y not next to v, that can give way to (u, x) and (v, y)."""
    ways = both_ways(edges).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near_u, near_v = _outside(edges, u), _outside(edges, v)
    return ways.join(F.broadcast(near_u), F.col("x") == F.col("near"), "left_anti").join(F.broadcast(near_v), F.col("y") == F.col("near"), "left_anti").where("x <> y")


def _link(a, b, edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType
    ends: tuple[Column, Column] = (F.lit(min(a, b)).cast(kind), F.lit(max(a, b)).cast(kind))
    return edges.sparkSession.range(1).select(ends[0].alias("a"), ends[1].alias("b"))


def repaired(nodes: DataFrame, edges: DataFrame, k: int, rounds: int = 200) -> DataFrame:
    """Links ``(a, b)``, a < b, of a simple graph in which every one of ``nodes(node)`` has ``k``.

    ``edges(a, b)`` are links to keep; loops and repeats are dropped, and no
    node may have more than ``k``.  n * k has to be even, and k below n.  Rounds
    of pairs give links to nearly all that lack them.  The few nodes left are
    linked to each other already, so at most k + 1 of them: for those a link
    elsewhere is taken apart and its ends are given to two of them, one after
    another.  If the graph was connected it stays so: a swap that would part it
    is passed over.  Where no swap is left, which takes a small and dense graph,
    the regular ring takes the graph's place.
    """
    edges = kept(canonical(edges.select("a", "b").where("a <> b")))
    n = nodes.count()
    if k < 0 or k and k >= n or n * k % 2:
        raise ValueError(f"no graph of {n} nodes has {k} links at each")
    most = both_ways(edges).groupBy("a").count().agg(F.max("count")).first()[0] or 0
    if most > k:
        raise ValueError(f"a node has {most} links already")
    root = nodes.agg(F.min("node")).first()[0]
    whole = n > 0 and is_connected(nodes, edges, root).first()["connected"]
    idle = 0
    for salt in range(rounds):
        short = kept(lacking(nodes, edges, k))
        free = short.agg(F.coalesce(F.sum(F.lit(k) - F.col("degree")), F.lit(0))).first()[0]
        if free == 0:
            return edges
        if idle < TRIES:
            more = kept(_paired(short, edges, k, free, salt))
            added = more.count()
            idle = 0 if added else idle + 1
            edges = kept(edges.unionByName(more)) if added else edges
            continue
        # at most k + 1 nodes, which all know each other
        left = short.orderBy("degree", "node").limit(2).collect()
        u, v = left[0]["node"], left[-1]["node"]
        if free > 1 and len(left) == 2 and k - left[0]["degree"] > 1:
            v = u  # the one that lacks most takes both ends
        found = None
        for s in _swaps(edges, u, v).orderBy(F.xxhash64("x", "y")).limit(8).collect():
            gone = _link(s["x"], s["y"], edges)
            tried = kept(edges.join(gone, ["a", "b"], "left_anti").unionByName(_link(u, s["x"], edges)).unionByName(_link(v, s["y"], edges)))
            if not whole or is_connected(nodes, tried, root).first()["connected"]:
                found = tried
                break
        if found is None:
            return regular_edges(nodes, k)
        edges, idle = found, 0
    raise RuntimeError("the graph isn't regular after the number of rounds allowed")
