"""Overlay graphs: k-regular links, spanning trees, shortest hops, relays."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# each round reads a table, not a checkpoint: a checkpoint hands on its plan's orderings and sizes, which double with every round
from ..sources.shared import stored as kept
from .numbering import numbered, running

BLOCK = 1 << 16  # nodes whose depths one task settles at a time


def regular_edges(nodes: DataFrame, k: int, node: str = "node") -> DataFrame:
    """``(a, b)`` with a < b: every node linked to its k/2 next ones on the ring of ids, and for odd k to the one across.

    With an odd number of nodes and odd k no graph is regular; then every node
    but one has the link across.  Fewer than two nodes, or k not below their
    number, give no links.
    """
    n = nodes.count()
    if n < 2 or not 0 <= k < n:
        return nodes.select(F.col(node).alias("a"), F.col(node).alias("b")).limit(0)
    steps = [(d, n) for d in range(1, k // 2 + 1)]
    if k % 2:
        steps.append((n // 2, n // 2))  # each pair across once
    placed = numbered(nodes.select(F.col(node).alias("id")), ["id"])
    links = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(most).alias("most")) for d, most in steps)) if steps else F.array().cast("array<struct<d:int,most:int>>")
    each = placed.select("id", "at", F.explode(links).alias("s")).where(F.col("at") < F.col("s.most")).select("id", ((F.col("at") + F.col("s.d")) % n).alias("to"))
    other = placed.select(F.col("id").alias("other"), F.col("at").alias("to"))
    return each.join(other, "to").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a <> b").distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller end first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in ("a", "b")]).dropDuplicates(["a", "b"])


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select("a", "b", *rest).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def breadth_first(edges: DataFrame, start, block: int = BLOCK) -> DataFrame:
    """``(node, depth, parent, first_hop)`` of every node that ``start`` reaches, itself with nulls; of several parents the smallest."""
    found = kept(levels(edges, start, block))
    # ways up are doubled until all end below the start
    hop = found.where("parent is not null").select("node", F.when(F.col("depth") > 1, F.col("parent")).alias("up"), F.col("node").alias("first_hop"))
    most = found.agg(F.max("depth")).first()[0]
    for _ in range(most.bit_length()):
        above = hop.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("first_hop").alias("there"))
        hop = kept(hop.join(above, "up", "left").select("node", F.col("further").alias("up"), F.coalesce("there", "first_hop").alias("first_hop")))
    return found.join(hop.select("node", "first_hop"), "node", "left")


def levels(edges: DataFrame, start, block: int = BLOCK) -> DataFrame:
    """``(node, depth, parent)`` as ``breadth_first`` has them.

    Nodes are dealt by id into blocks of at most ``block``.  A round settles
    depths inside each block that something came into, each in a task of its
    own, and sends what got smaller over links to other blocks.  So rounds are
    as many as blocks on a shortest way, where near ids are linked, and at worst
    as many as levels.
    """
    kind = edges.schema["a"].dataType
    pairs = both_ways(edges.select("a", "b")).where("a <> b").distinct()
    alone = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(alone).distinct()
    dealt = kept(numbered(nodes, ["node"]).select("node", F.floor(F.col("at") / block).alias("block")))
    ways = kept(pairs.join(dealt.select(F.col("node").alias("a"), F.col("block").alias("block")), "a").join(dealt.select(F.col("node").alias("b"), F.col("block").alias("to")), "b"))
    inner, cross = ways.where("block = to").select("block", "a", "b"), ways.where("block <> to").select("a", F.col("b").alias("node"), F.col("to").alias("block"))
    come = dealt.join(alone, "node").select("block", "node", F.lit(0).alias("depth"))
    known = come.limit(0)
    schema = come.select("block", "node", "depth").schema
    while True:
        active = F.broadcast(come.select("block").distinct())
        marks = known.withColumn("fresh", F.lit(False)).unionByName(come.withColumn("fresh", F.lit(True))).join(active, "block", "left_semi")
        smaller = kept(inner.join(active, "block", "left_semi").groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(_settled, schema))
        known = kept(known.unionByName(smaller).groupBy("block", "node").agg(F.min("depth").alias("depth")))
        sent = smaller.join(cross.drop("block"), smaller["node"] == cross["a"]).select(cross["node"].alias("node"), (F.col("depth") + 1).alias("depth")).groupBy("node").agg(F.min("depth").alias("depth"))
        had = known.select("node", F.col("depth").alias("had"))
        come = kept(sent.join(had, "node", "left").where("had is null or depth < had").join(dealt, "node").select("block", "node", "depth"))
        if come.isEmpty():
            break
    above = known.select(F.col("node").alias("b"), F.col("depth").alias("above"))
    parents = known.join(pairs, F.col("node") == F.col("a")).join(above, "b").where("above = depth - 1").groupBy("node").agg(F.min("b").alias("parent"))
    return known.join(parents, "node", "left").select("node", "depth", "parent")


def _settled(ways: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """The depths of one block that ``marks`` that are fresh make smaller, by ``ways`` inside it."""
    near: dict = {}
    for a, b in zip(ways["a"], ways["b"]):
        near.setdefault(a, []).append(b)
    old = marks[~marks["fresh"]]
    best, found = dict(zip(old["node"], old["depth"])), {}
    fresh = marks[marks["fresh"]]
    todo = list(zip(fresh["depth"], fresh["node"]))
    heapq.heapify(todo)
    while todo:
        depth, node = heapq.heappop(todo)
        if depth < best.get(node, depth + 1):
            best[node] = found[node] = depth
            for other in near.get(node, ()):
                if depth + 1 < best.get(other, depth + 2):
                    heapq.heappush(todo, (depth + 1, other))
    return pd.DataFrame({"block": marks["block"].iloc[0] if found else [], "node": list(found.keys()), "depth": list(found.values())})


def toured(tree: DataFrame, root) -> DataFrame | None:
    """``(a, b, place, back, down)`` of each step of a tour from ``root`` around its tree; None if it has no edge.

    Each edge is walked both ways, around each node from one neighbour to the
    next: one tour of the whole tree, whose places are found by doubling how far
    each step looks ahead.  The first of an edge's two steps goes down; ``back``
    is the place of the other one.  A tree takes as many rounds as its number of
    steps has binary digits, however deep it is; neither a path nor a node's
    neighbours are ever brought together.
    """
    steps = kept(numbered(both_ways(tree.select("a", "b")).distinct(), ["a", "b"], "id"))
    n = steps.count()
    first = steps.groupBy("a").agg(F.min("id").alias("first"))
    start = steps.where(F.col("a") == F.lit(root)).agg(F.min("id")).first()[0]
    if start is None:
        return None
    after = steps.select((F.col("id") - 1).alias("id"), F.col("a").alias("next_a"))
    turned = steps.join(after, "id", "left").join(first, "a").select(F.col("a").alias("b"), F.col("b").alias("a"), F.when(F.col("next_a") == F.col("a"), F.col("id") + 1).otherwise(F.col("first")).alias("to"))
    # where the tour would come back to its first step it ends
    jump = steps.join(turned, ["a", "b"]).select("id", F.when(F.col("to") != start, F.col("to")).alias("to"))
    jump = kept(jump.withColumn("left", F.col("to").isNotNull().cast("long")))
    for _ in range(n.bit_length()):
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("left").alias("more"))
        jump = kept(jump.join(ahead, "to", "left").select("id", F.col("on").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    # steps of other trees go round without an end
    placed = kept(jump.where("to is null").join(steps, "id").select("a", "b", (-F.col("left")).alias("place")))
    back = placed.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("place").alias("back"))
    return placed.join(back, ["a", "b"]).select("a", "b", "place", "back", (F.col("place") < F.col("back")).alias("down"))


def rooted(tree: DataFrame, root) -> DataFrame:
    """``(node, depth, parent, first_hop)`` of every node that edges ``tree(a, b)`` of a forest join to ``root``, the root with nulls."""
    node = tree.schema["a"].dataType
    alone = tree.sparkSession.range(1).select(F.lit(root).cast(node).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(node).alias("parent"), F.lit(None).cast(node).alias("first_hop"))
    steps = toured(tree, root)
    return alone if steps is None else _told(steps).unionByName(alone)


def _told(steps: DataFrame) -> DataFrame:
    """Nodes below the root, from the steps of its tour."""
    deep = running(steps, "place", "depth", F.sum, F.when(F.col("down"), 1).otherwise(-1).cast("long"))
    top = F.when(F.col("down") & (F.col("depth") == 1), F.struct("place", F.col("b").alias("hop")))
    hops = running(deep, "place", "top", F.max, top)
    return hops.where("down").select(F.col("b").alias("node"), F.col("depth").cast("int").alias("depth"), F.col("a").alias("parent"), F.col("top.hop").alias("first_hop"))


def is_connected(nodes: DataFrame, edges: DataFrame, start, node: str = "node") -> DataFrame:
    """One row: nodes, nodes reached, and whether that is all.

    Components are merged, in rounds that grow with the logarithm of their
    number of nodes; how many links lie between two nodes doesn't count.
    """
    _, label = _merged(edges.select("a", "b", F.lit(0).alias("w")))
    mine = label.where(F.col("node") == F.lit(start)).select("root")
    reached = label.join(F.broadcast(mine), "root", "left_semi").select(F.col("node").alias("_n"))
    alone = reached.sparkSession.range(1).select(F.lit(start).cast(reached.schema["_n"].dataType).alias("_n"))
    reached = reached.unionByName(alone).distinct()
    found = nodes.join(reached, nodes[node] == reached["_n"], "left").agg(F.count(node).alias("nodes"), F.count("_n").alias("reached"))
    return found.withColumn("connected", F.col("nodes") == F.col("reached"))


def spanning_forest(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """The minimum spanning forest of ``edges(a, b, w)``.

    In each round every component takes the smallest edge that leaves it, by
    (w, a, b), and joins the component at its other end.  That order has no
    ties, so the forest is the only one.  Components at least halve each round.
    """
    return _merged(edges, rounds)[0]


def _merged(edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """The forest, and ``(node, root)``: a node of its tree that stands for it."""
    edges = kept(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
    label = kept(both_ways(edges).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    tree = edges.limit(0)
    for _ in range(rounds):
        la, lb = label.select(F.col("node").alias("a"), F.col("root").alias("ra")), label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        crossing = kept(edges.join(la, "a").join(lb, "b").where("ra <> rb"))
        if crossing.isEmpty():
            return tree, label
        each = crossing.select(F.explode(F.array(F.struct(F.col("ra").alias("root"), F.col("rb").alias("to")), F.struct(F.col("rb").alias("root"), F.col("ra").alias("to")))).alias("r"), F.struct("w", "a", "b").alias("e"))
        chosen = kept(each.groupBy("r.root").agg(F.min(F.struct("e", "r.to")).alias("m")).select("root", "m.e", "m.to"))
        tree = kept(tree.unionByName(chosen.select("e.a", "e.b", "e.w").distinct()))
        label = kept(label.join(_roots(chosen.select("root", "to")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    raise RuntimeError("the forest isn't done after the number of rounds allowed")


def _roots(points: DataFrame) -> DataFrame:
    """``(root, to)``, whose only cycles are pairs that point at each other, to ``(root, top)`` by pointer jumping."""
    back = points.select(F.col("root").alias("to"), F.col("to").alias("back"))
    up = points.join(back, "to").select("root", F.when((F.col("back") == F.col("root")) & (F.col("root") < F.col("to")), F.col("root")).otherwise(F.col("to")).alias("top"))
    up = kept(up)
    while True:
        higher = up.select(F.col("root").alias("top"), F.col("top").alias("next"))
        jumped = kept(up.join(higher, "top").select("root", F.col("next").alias("top"), (F.col("top") != F.col("next")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return up
        up = jumped.select("root", "top")


def relays(messages: DataFrame, tree: DataFrame, root) -> DataFrame:
    """``(node, relayed_count)``: how often each node passes on a message on its way along the tree; nodes that pass on none are left out.

    A message's way goes up from both ends to where they meet; inner nodes of
    it relay.  A link is crossed by what is sent or received below it, less what
    meets there too; an inner node has two of a way's links, an end has one.
    """
    steps = toured(tree, root)
    if steps is None:
        return messages.select(F.col("source").alias("node"), F.lit(0).cast("long").alias("relayed_count")).limit(0)
    steps = kept(steps)
    told = kept(_told(steps).select("node", F.col("depth").cast("long").alias("depth"), "parent"))
    alone = told.sparkSession.range(1).select(F.lit(root).cast(told.schema["node"].dataType).alias("node"), F.lit(0).cast("long").alias("depth"))
    depths = told.select("node", "depth").unionByName(alone)
    counted = messages.groupBy("source", "sink").agg(F.count("*").alias("n")).where("source <> sink")
    ends = counted
    for c in ("source", "sink"):
        ends = ends.join(depths.select(F.col("node").alias(c), F.col("depth").alias(f"{c}_depth")), c)
    ends = kept(ends)
    met = _meetings(ends, told)
    own = ends.select(F.explode(F.array("source", "sink")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("ends"))
    less = met.groupBy(F.col("meet").alias("node")).agg((-2 * F.sum("n")).alias("ends"))
    below = own.unionByName(less).groupBy(F.col("node").alias("b")).agg(F.sum("ends").alias("value"))
    valued = steps.join(below, "b", "left").withColumn("value", F.when(F.col("down"), F.coalesce("value", F.lit(0))).otherwise(0))
    summed = kept(running(valued, "place", "sum", F.sum, F.col("value")))
    up = summed.select(F.col("place").alias("back"), F.col("sum").alias("all"))
    crossed = summed.where("down").join(up, "back").select("a", "b", (F.col("all") - F.col("sum") + F.col("value")).alias("crossed"))
    links = crossed.select(F.explode(F.array("a", "b")).alias("node"), "crossed").groupBy("node").agg(F.sum("crossed").alias("crossed"))
    passed = links.join(own, "node", "left").select("node", F.expr("(crossed - coalesce(ends, 0)) div 2").alias("relayed_count"))
    return passed.where("relayed_count > 0")


def _meetings(ends: DataFrame, told: DataFrame) -> DataFrame:
    """``(meet, n)`` of ``ends(source, sink, source_depth, sink_depth, n)``: the lowest node above both, by steps up of powers of two."""
    most = told.agg(F.max("depth")).first()[0]
    ups = [told.select("node", F.col("parent").alias("up"))]
    for _ in range(most.bit_length() - 1):
        more = ups[-1].select(F.col("node").alias("up"), F.col("up").alias("further"))
        ups.append(kept(ups[-1].join(more, "up").select("node", F.col("further").alias("up"))))
    deep = F.col("source_depth") >= F.col("sink_depth")
    pairs = ends.select(F.when(deep, F.col("source")).otherwise(F.col("sink")).alias("low"), F.when(deep, F.col("sink")).otherwise(F.col("source")).alias("high"), F.abs(F.col("source_depth") - F.col("sink_depth")).alias("gap"), "n")
    for k, up in enumerate(ups):
        step = up.select(F.col("node").alias("low"), F.col("up").alias("low_up"))
        pairs = kept(pairs.join(step, "low", "left").withColumn("low", F.when(F.shiftright("gap", k).bitwiseAND(1) == 1, F.col("low_up")).otherwise(F.col("low"))).drop("low_up"))
    for up in reversed(ups):
        low, high = up.select(F.col("node").alias("low"), F.col("up").alias("low_up")), up.select(F.col("node").alias("high"), F.col("up").alias("high_up"))
        moves = F.coalesce((F.col("low") != F.col("high")) & (F.col("low_up") != F.col("high_up")), F.lit(False))
        both = pairs.join(low, "low", "left").join(high, "high", "left")
        pairs = kept(both.select(F.when(moves, F.col("low_up")).otherwise(F.col("low")).alias("low"), F.when(moves, F.col("high_up")).otherwise(F.col("high")).alias("high"), "n"))
    above = told.select(F.col("node").alias("low"), "parent")
    return pairs.join(above, "low", "left").select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("parent")).alias("meet"), "n")
