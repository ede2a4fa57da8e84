"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(u, v)`` to ``(u, v)`` with v the smallest id that u reaches; only ids above that smallest one appear.

    Each round is two shuffles of the links; their number falls to one for each
    id.  A hub's links are joined to its one minimum, so a task reads each once.
    Links with a null end, or from an id to itself, are left out.  Rounds end
    when nothing changes, after a number that grows with the logarithm of the
    largest component; ``rounds`` only guards against an endless loop.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    if not state[0]:
        return edges
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            return edges
    raise RuntimeError("components did not settle")


def classes_under_hubs(members: DataFrame, hub_links: Callable[[DataFrame], DataFrame], other_links: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``members(hub, node)``, each once, hubs being members of their own, to ``(u, v)`` as ``components`` gives them.

    Each member is first compared with its hub, which is linear in their number:
    ``hub_links`` takes pairs ``(u, v)``, u above v, and returns those that link.
    Where members are still in several components, those outside the largest
    one of a hub are compared with all members of other components, so no link
    is lost, while those of the largest one, however many, don't meet one
    another.  ``other_links`` takes both sides, ``(hub, node, root, main)`` each,
    and returns their links; ``apart`` is the condition on ``a`` and ``b``.
    """
    pair = [F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")]
    classes = components(hub_links(members.where("node <> hub").select(*pair).distinct()))
    rooted = members.join(classes.withColumnRenamed("u", "node").withColumnRenamed("v", "root"), "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("hub", "root").agg(F.count("*").alias("n"))
    still_open = sizes.groupBy("hub").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("hub", "main")
    left = cut(rooted.join(still_open, "hub"))
    if left.isEmpty():
        return classes
    more = cut(other_links(left.where("root <> main"), left).distinct())
    return classes if more.isEmpty() else components(classes.unionByName(more))


def apart(a: str = "a", b: str = "b") -> Column:
    """Of two members of one hub, a outside its main component: whether they are in different components; of two outside it, true in one order only."""
    return (F.col(f"{a}.hub") == F.col(f"{b}.hub")) & (F.col(f"{a}.root") != F.col(f"{b}.root")) & ((F.col(f"{b}.root") == F.col(f"{b}.main")) | (F.col(f"{a}.root") < F.col(f"{b}.root")))
