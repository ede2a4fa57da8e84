"""Queries over nodes, links and keys, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import hash16, hex_id, is_hex_id, ring_distance, shared_digits
from ..operators import keyring, overlay, traffic
from ..operators.numbering import numbered
from ..operators.repair import repaired
from ..sources.bindings import bound, ctes

DEGREE, ODD_DEGREE = 8, 3
MEASURES = ["sent_count", "sent_sum", "received_count", "received_sum"]


def _messages(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select((F.col("o_custkey") % 50).alias("source"), (F.col("o_orderkey") % 50).alias("sink"), ((F.col("o_orderkey") * 7919) % 2147483647 - 1073741823).alias("payload"))


def _nodes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("node"))


def _edges(spark, sf_dir, k=DEGREE):
    found = overlay.regular_edges(_nodes(spark, sf_dir), k)
    return found.withColumn("w", ((F.col("a") * 7 + F.col("b") * 13) % 10 + 1).cast("int"))


def _dht(spark, sf_dir):
    return bound(spark, sf_dir, "dht_nodes")


def _keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", hash16("url").alias("key16"))


def traffic_rollup(spark, sf_dir):
    return traffic.with_total(traffic.traffic(_messages(spark, sf_dir)), MEASURES)


def load_share(spark, sf_dir):
    return traffic.load_share(bound(spark, sf_dir, "node_stats"))


def conservation_check(spark, sf_dir):
    return traffic.unbalanced(bound(spark, sf_dir, "node_stats"))


def recorded_vs_observed(spark, sf_dir):
    stats = bound(spark, sf_dir, "node_stats")
    a = stats.where("node % 7 <> 0").select("node", F.col("completed").alias("n"))
    b = stats.where("node % 5 <> 0").select("node", (F.col("completed") + (F.col("node") % 3 == 0).cast("int")).alias("n"))
    return traffic.compared(a, b)


def balance_plan(spark, sf_dir):
    stats = bound(spark, sf_dir, "node_stats")
    return traffic.balance_plan(stats.select("node", ((F.col("generated") + F.col("pulled")) * 40 - F.col("pushed") * 30).alias("queued")))


def ring_neighbours(spark, sf_dir):
    return traffic.ring(_nodes(spark, sf_dir))


def random_peers(spark, sf_dir):
    """For each node another one, drawn by seed: a step of 1 to n - 1 around the ring of ids."""
    nodes = _nodes(spark, sf_dir)
    n = nodes.count()
    placed = numbered(nodes, ["node"])
    drawn = placed.select("node", F.pmod(F.col("at") + 1 + F.pmod(F.conv(F.left(F.md5(F.concat_ws(":", "node", F.lit(11))), F.lit(12)), 16, 10).cast("long"), F.lit(max(1, n - 1))), F.lit(n)).alias("to"))
    return drawn.join(placed.select(F.col("node").alias("peer"), F.col("at").alias("to")), "to").select("node", "peer").where("node <> peer")


def overlay_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def overlay_edges_odd(spark, sf_dir):
    return _edges(spark, sf_dir, ODD_DEGREE)


def overlay_degree(spark, sf_dir):
    return overlay.degrees(_edges(spark, sf_dir))


def overlay_repaired(spark, sf_dir):
    """A graph that lost some of its links, brought back to one degree: every node's links, none twice."""
    nodes, whole = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    left = whole.where("(a * 31 + b) % 4 <> 0").select("a", "b")
    found = repaired(nodes, left, DEGREE)
    return overlay.degrees(found.where("a < b").distinct())


def overlay_weights(spark, sf_dir):
    """Smallest and largest weight and number of links; one row, of an empty graph too."""
    return _edges(spark, sf_dir).agg(F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.count("*").alias("links"))


def overlay_connected(spark, sf_dir):
    return overlay.is_connected(_nodes(spark, sf_dir), _edges(spark, sf_dir), 1)


def overlay_bfs(spark, sf_dir):
    return overlay.levels(_edges(spark, sf_dir), 1)


def mst(spark, sf_dir):
    return overlay.spanning_forest(_edges(spark, sf_dir))


def mst_levels(spark, sf_dir):
    """The spanning tree in breadth-first order from node 1."""
    return overlay.rooted(mst(spark, sf_dir), 1).select("node", "depth", "parent").orderBy("depth", "parent", "node")


def mst_bfs(spark, sf_dir):
    """Each node's depth and parent in the spanning tree, and the root's neighbour on the way to it."""
    return overlay.rooted(mst(spark, sf_dir), 1)


def relay_counts(spark, sf_dir):
    messages = _messages(spark, sf_dir).select((F.col("source") + 1).alias("source"), (F.col("sink") + 1).alias("sink"))
    return overlay.relays(messages, mst(spark, sf_dir), 1)


def dht_hash16(spark, sf_dir):
    return _keys(spark, sf_dir).select("page_id", "key16", hex_id(F.col("key16")).alias("hex"), is_hex_id(hex_id(F.col("key16"))).alias("well_formed"))


def dht_well_formed(spark, sf_dir):
    """Ids as nodes give them, some too short, too long or not hexadecimal."""
    odd = F.concat(F.substring("p_type", 1, 1), F.lower(F.hex(F.col("p_partkey") % 70000 * 13)))
    given = F.when(F.col("p_partkey") % 2 == 0, F.lower(F.hex(F.col("p_partkey") % 70000 * 13))).otherwise(odd)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", given.alias("given"), is_hex_id(given).alias("well_formed"))


def dht_owner(spark, sf_dir):
    found = keyring.owners(_keys(spark, sf_dir), _dht(spark, sf_dir))
    return found.select("page_id", "key16", "owner", ring_distance(F.col("key16"), F.col("owner")).alias("distance"), shared_digits(hex_id(F.col("key16")), hex_id(F.col("owner"))).alias("digits"))


def dht_leaf_set(spark, sf_dir):
    return keyring.leaf_sets(_dht(spark, sf_dir))


def dht_routing_table(spark, sf_dir):
    return keyring.routing_cells(_dht(spark, sf_dir))


def dht_next_hop(spark, sf_dir):
    asked = _keys(spark, sf_dir).select(((F.col("page_id") % 100 + 1) * 40503 + 7).alias("x"), "key16").select((F.col("x") % 65536).alias("at16"), "key16")
    return keyring.next_hops(asked, _dht(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        traffic_rollup, load_share, conservation_check, recorded_vs_observed, balance_plan, ring_neighbours, random_peers, overlay_edges, overlay_edges_odd, overlay_degree, overlay_repaired, overlay_weights, overlay_connected,
        overlay_bfs, mst, mst_levels, mst_bfs, relay_counts, dht_hash16, dht_well_formed, dht_owner, dht_leaf_set, dht_routing_table, dht_next_hop,
    )
}

_MESSAGES = "m AS (SELECT o_custkey % 50 AS source, o_orderkey % 50 AS sink, (o_orderkey * 7919) % 2147483647 - 1073741823 AS payload FROM orders)"
_STATS = f"WITH {ctes('node_stats')}"


def _graph(k: int) -> str:
    across = "UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM p x CROSS JOIN (SELECT count(*) AS n FROM p) JOIN p y ON y.at = x.at + n // 2 WHERE x.at < n // 2" if k % 2 else ""
    return f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS at FROM supplier),
      e AS (SELECT a, b, CAST((a * 7 + b * 13) % 10 + 1 AS INT) AS w FROM (
        SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM p x, range(1, {k // 2 + 1}) AS r(d), (SELECT count(*) AS n FROM p) JOIN p y ON y.at = (x.at + d) % n {across}))"""


_BFS = f"""{_graph(DEGREE)}, ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN ways ON a = node WHERE depth < (SELECT count(*) // 4 + 1 FROM p)),
  d AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""
# an edge is in the spanning tree if no way over smaller edges joins its ends
_MST = f"""{_graph(DEGREE)}, o AS (SELECT *, row_number() OVER (ORDER BY w, a, b) AS r FROM e),
  reach AS (SELECT r, a AS node FROM o UNION SELECT reach.r, CASE WHEN o.a = reach.node THEN o.b ELSE o.a END FROM reach JOIN o ON (o.a = reach.node OR o.b = reach.node) AND o.r < reach.r),
  t AS (SELECT a, b, w FROM o ANTI JOIN reach ON o.r = reach.r AND o.b = reach.node),
  tw AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t),
  down AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS first_hop
    UNION ALL SELECT tw.b, depth + 1, node, coalesce(first_hop, tw.b) FROM down JOIN tw ON tw.a = node WHERE parent IS NULL OR tw.b <> parent)"""
_HEX = "lower(lpad(printf('%x', {0}), 4, '0'))"
_KEYS = """k AS (SELECT page_id, CAST(list_reduce(list_prepend(0, list_transform(range(1, length(url) + 1), lambda i: CAST(ord(substr(url, i, 1)) AS BIGINT))), lambda a, c: (a * 31 + c) % 65536) AS BIGINT) AS key16 FROM pages)"""
_DHT = f"WITH {ctes('dht_nodes')}"

ORACLE_SQL = {
    "traffic_rollup": f"""WITH {_MESSAGES}, e AS (SELECT source AS node, payload, true AS sent FROM m UNION ALL SELECT sink, payload, false FROM m)
      SELECT coalesce(CAST(node AS VARCHAR), 'TOTAL') AS node, count(*) FILTER (sent) AS sent_count, CAST(sum(CASE WHEN sent THEN payload ELSE 0 END) AS BIGINT) AS sent_sum, count(*) FILTER (NOT sent) AS received_count,
        CAST(sum(CASE WHEN sent THEN 0 ELSE payload END) AS BIGINT) AS received_sum FROM e GROUP BY ROLLUP (node)""",
    "load_share": f"""{_STATS}, t AS (SELECT coalesce(CAST(node AS VARCHAR), 'TOTAL') AS node, CAST(sum(generated) AS BIGINT) AS generated, CAST(sum(pulled) AS BIGINT) AS pulled, CAST(sum(pushed) AS BIGINT) AS pushed,
      CAST(sum(completed) AS BIGINT) AS completed FROM node_stats GROUP BY ROLLUP (node))
      SELECT *, CASE WHEN (SELECT sum(completed) FROM node_stats) = 0 THEN 0 ELSE round(completed * 100 / (SELECT CAST(sum(completed) AS BIGINT) FROM node_stats), 4) END AS percent FROM t""",
    "conservation_check": f"{_STATS} SELECT *, generated + pulled - pushed AS expected FROM node_stats WHERE generated + pulled - pushed <> completed",
    "recorded_vs_observed": f"""{_STATS}, a AS (SELECT node, completed AS n FROM node_stats WHERE node % 7 <> 0), b AS (SELECT node, completed + CASE WHEN node % 3 = 0 THEN 1 ELSE 0 END AS n FROM node_stats WHERE node % 5 <> 0)
      SELECT coalesce(a.node, b.node) AS node, a.n AS recorded, b.n AS observed, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'not found' WHEN a.n = b.n THEN 'match' ELSE 'mismatch' END AS verdict FROM a FULL JOIN b ON a.node = b.node""",
    "balance_plan": f"""{_STATS}, q AS (SELECT node, (generated + pulled) * 40 - pushed * 30 AS queued FROM node_stats)
      SELECT node, queued, CAST(CASE WHEN queued > 2000 THEN greatest(20, (queued - 2000) // 2) ELSE 0 END AS BIGINT) AS push, CAST(CASE WHEN queued > 100 THEN greatest(20, (queued - 100) // 2) ELSE 0 END AS BIGINT) AS can_share,
        CAST(CASE WHEN queued < 100 THEN greatest(20, 2000 - queued) ELSE 0 END AS BIGINT) AS asks_for FROM q""",
    "ring_neighbours": """SELECT s_suppkey AS node, coalesce(lead(s_suppkey) OVER (ORDER BY s_suppkey), (SELECT min(s_suppkey) FROM supplier)) AS successor,
      coalesce(lag(s_suppkey) OVER (ORDER BY s_suppkey), (SELECT max(s_suppkey) FROM supplier)) AS predecessor FROM supplier""",
    "random_peers": """WITH p AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS seat, count(*) OVER () AS n FROM supplier),
      d AS (SELECT node, (seat + 1 + CAST('0x' || left(md5(node || ':11'), 12) AS BIGINT) % greatest(1, n - 1)) % n AS go FROM p)
      SELECT d.node, p.node AS peer FROM d JOIN p ON p.seat = d.go WHERE d.node <> p.node""",
    "overlay_edges": f"{_graph(DEGREE)} SELECT * FROM e",
    "overlay_edges_odd": f"{_graph(ODD_DEGREE)} SELECT * FROM e",
    "overlay_degree": f"{_graph(DEGREE)} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node",
    "overlay_repaired": f"SELECT s_suppkey AS node, CAST({DEGREE} AS BIGINT) AS degree FROM supplier",
    "overlay_weights": f"{_graph(DEGREE)} SELECT min(w) AS min_w, max(w) AS max_w, count(*) AS links FROM e",
    "overlay_connected": f"{_BFS} SELECT (SELECT count(*) FROM p) AS nodes, count(*) AS reached, count(*) = (SELECT count(*) FROM p) AS connected FROM d",
    "overlay_bfs": f"{_BFS} SELECT d.node, CAST(d.depth AS INT) AS depth, min(u.node) AS parent FROM d LEFT JOIN ways ON ways.b = d.node LEFT JOIN d u ON u.node = ways.a AND u.depth = d.depth - 1 GROUP BY 1, 2",
    "mst": f"{_MST} SELECT * FROM t",
    "mst_levels": f"{_MST} SELECT node, depth, parent FROM down",
    "mst_bfs": f"{_MST} SELECT * FROM down",
    "dht_hash16": f"WITH {_KEYS} SELECT page_id, key16, {_HEX.format('key16')} AS hex, true AS well_formed FROM k",
    "dht_well_formed": """WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE substr(p_type, 1, 1) END || lower(printf('%x', p_partkey % 70000 * 13)) AS given FROM part)
      SELECT *, regexp_full_match(given, '[0-9a-fA-F]{4}') AS well_formed FROM g""",
    "dht_owner": f"""{_DHT}, {_KEYS}, o AS (
      SELECT page_id, key16, id16 AS owner, least(abs(key16 - id16), 65536 - abs(key16 - id16)) AS distance FROM k, dht_nodes QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY distance, id16 DESC) = 1)
      SELECT *, CAST(CASE WHEN {_HEX.format('key16')} = {_HEX.format('owner')} THEN 4 WHEN left({_HEX.format('key16')}, 3) = left({_HEX.format('owner')}, 3) THEN 3 WHEN left({_HEX.format('key16')}, 2) = left({_HEX.format('owner')}, 2) THEN 2
        WHEN left({_HEX.format('key16')}, 1) = left({_HEX.format('owner')}, 1) THEN 1 ELSE 0 END AS INT) AS digits FROM o""",
    "dht_leaf_set": f"""{_DHT}, x AS (SELECT s.id16, o.id16 AS other, (o.id16 - s.id16 + 65536) % 65536 AS cw FROM dht_nodes s JOIN dht_nodes o ON s.id16 <> o.id16)
      SELECT id16, arg_max(other, cw) FILTER (cw > 32768) AS left_id, arg_min(other, cw) FILTER (cw <= 32768) AS right_id FROM x GROUP BY id16""",
    "dht_routing_table": f"""{_DHT}, h AS (SELECT node, id16, {_HEX.format('id16')} AS hex FROM dht_nodes),
      x AS (SELECT s.id16, o.id16 AS entry, o.node, o.hex, CASE WHEN left(s.hex, 3) = left(o.hex, 3) THEN 3 WHEN left(s.hex, 2) = left(o.hex, 2) THEN 2 WHEN left(s.hex, 1) = left(o.hex, 1) THEN 1 ELSE 0 END AS r FROM h s JOIN h o ON s.id16 <> o.id16)
      SELECT id16, CAST(r AS INT) AS "row", CAST(instr('0123456789abcdef', substr(hex, CAST(r AS INT) + 1, 1)) - 1 AS INT) AS col, arg_max(entry, node) AS entry FROM x GROUP BY ALL""",
}
