"""Nodes and keys on a ring of 2^16: owners, neighbours, routing cells, next hops.

The key space bounds every table here that is not of keys: 65536 rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import DIGITS, RING, hex_id, ring_distance, shared_digits

HALF = RING // 2


def owner_table(nodes: DataFrame) -> DataFrame:
    """``(key16, owner)`` for each point of the ring: the nearest of ``nodes(id16)``, of two the one with the higher id."""
    points = nodes.sparkSession.range(RING).select(F.col("id").alias("key16"))
    marked = points.join(F.broadcast(nodes.select(F.col("id16").alias("key16")).distinct().withColumn("node", F.col("key16"))), "key16", "left")
    span = nodes.agg(F.min("id16").alias("lowest"), F.max("id16").alias("highest")).first()
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("key16"), F.desc("key16")))
    back = F.coalesce(F.last("node", True).over(up), F.lit(span["highest"]).cast("long"))
    ahead = F.coalesce(F.last("node", True).over(down), F.lit(span["lowest"]).cast("long"))
    found = marked.select("key16", back.alias("back"), ahead.alias("ahead")).where("back is not null")
    nearest = F.least(*(F.struct(ring_distance(F.col("key16"), F.col(c)).alias("d"), (-F.col(c)).alias("n")) for c in ("back", "ahead")))
    return found.select("key16", (-nearest["n"]).alias("owner"))


def owners(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys(key16, ...)`` with the node that owns each; keys are not shuffled."""
    return keys.join(F.broadcast(owner_table(nodes)), "key16")


def leaf_sets(nodes: DataFrame) -> DataFrame:
    """Each node's nearest neighbour on either side, null where none lies within half the ring; one straight across fills the right side if that is empty, else the left."""
    order = Window.orderBy("id16")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = nodes.select("id16").distinct().select(
        "id16",
        F.coalesce(F.lead("id16").over(order), F.min("id16").over(whole)).alias("next"),
        F.coalesce(F.lag("id16").over(order), F.max("id16").over(whole)).alias("prior"),
    )
    ahead, behind = F.pmod(F.col("next") - F.col("id16"), F.lit(RING)), F.pmod(F.col("id16") - F.col("prior"), F.lit(RING))
    right = F.when((ahead > 0) & (ahead <= HALF), F.col("next"))
    left = F.when((behind > 0) & ((behind < HALF) | ((behind == HALF) & (ahead < HALF))), F.col("prior"))
    return near.select("id16", left.alias("left_id"), right.alias("right_id"))


def routing_cells(nodes: DataFrame) -> DataFrame:
    """``(id16, row, col, entry)``: of the nodes that share ``row`` digits with a node and go on with another digit, the last one by ``node``.

    Nodes are summed up by each prefix of their ids, and a node looks up the
    sixteen continuations of each of its own prefixes.
    """
    named = nodes.select("node", "id16", hex_id(F.col("id16")).alias("hex"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.lit(DIGITS)), lambda n: F.substring("hex", F.lit(1), n)))
    last = named.select("node", "id16", cut.alias("prefix")).groupBy("prefix").agg(F.max_by("id16", "node").alias("entry"))
    grid = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(DIGITS) for c in range(16)]
    wanted = named.select("id16", "hex", F.explode(F.array(*grid)).alias("g")).select("id16", "hex", "g.*")
    own = F.substring("hex", F.col("row") + 1, F.lit(1))
    wanted = wanted.withColumn("digit", F.lower(F.hex("col"))).where(own != F.col("digit")).withColumn("prefix", F.concat(F.substring("hex", F.lit(1), F.col("row")), F.col("digit")))
    return wanted.join(last, "prefix").select("id16", "row", "col", "entry")


def next_hops(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked(at16, key16)`` with the node that passes the key on.

    A key at a node of its own id, or between the node's two neighbours, goes to
    the nearest of the three; else to the routing cell for the next digit; else
    to the owner.
    """
    leaves = leaf_sets(nodes).withColumnRenamed("id16", "at16")
    keyed = asked.withColumn("row", shared_digits(hex_id(F.col("at16")), hex_id(F.col("key16"))))
    keyed = keyed.withColumn("col", F.conv(F.substring(hex_id(F.col("key16")), F.col("row") + 1, F.lit(1)), 16, 10).cast("int"))
    cells = routing_cells(nodes).withColumnRenamed("id16", "at16")
    joined = owners(keyed, nodes).join(F.broadcast(leaves), "at16", "left").join(cells, ["at16", "row", "col"], "left")
    span = F.pmod(F.col("right_id") - F.col("left_id"), F.lit(RING))
    inside = F.pmod(F.col("key16") - F.col("left_id"), F.lit(RING)) <= span
    close = F.array(*(F.when(F.col(c).isNotNull(), F.struct(ring_distance(F.col("key16"), F.col(c)).alias("d"), (-F.col(c)).alias("n"))) for c in ("at16", "left_id", "right_id")))
    nearest = -F.array_min(F.array_compact(close))["n"]
    hop = F.when((F.col("row") == DIGITS) | F.coalesce(inside, F.lit(False)), nearest).otherwise(F.coalesce("entry", "owner"))
    return joined.select("at16", "key16", hop.alias("hop16"), "owner")
