"""Queries of the block store and proofs of work, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import base_name, clean_path, host_port, part_name, part_of
from ..operators import blocks, erasure
from ..sources.bindings import bound, ctes

CHARS, SLICE = 4096, 512
PROOF_BITS = 8
LOST = 3


def _chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) > 0")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))  # one walk through the text, and no row holds more than a piece
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk", "data")).select("doc_id", (F.col("chunk") + 1).alias("chunk"), "data")


def _locations(spark, sf_dir):
    return bound(spark, sf_dir, "locations")


def _beats(spark, sf_dir):
    return bound(spark, sf_dir, "heartbeats").select("server", (F.unix_micros(F.col("beat_at").cast("timestamp")) / 1000).cast("long").alias("beat_ms"), "event_type")


def block_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk", F.char_length("data").alias("chars"))


def block_slice_sha1(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk", F.array_join(blocks.slice_digests(F.col("data"), SLICE), ",").alias("digests"))


def block_corruption(spark, sf_dir):
    """Chunks after one character of some is changed: the first slice that no longer fits its stored digest."""
    found = _chunks(spark, sf_dir).withColumn("stored", blocks.slice_digests(F.col("data"), SLICE))
    at = (F.col("doc_id") % 8 * SLICE + 5).cast("int")
    hurt = F.when(F.col("doc_id") % 7 == 0, F.overlay("data", F.lit("#"), at)).otherwise(F.col("data"))
    return found.select("doc_id", "chunk", blocks.first_bad_slice(F.col("stored"), blocks.slice_digests(hurt, SLICE)).alias("bad_slice"))


def used_space(spark, sf_dir):
    return blocks.used_space(_locations(spark, sf_dir))


def place_replicas(spark, sf_dir):
    return blocks.placement(blocks.used_space(_locations(spark, sf_dir)))


def place_shards(spark, sf_dir):
    return blocks.placement(blocks.used_space(_locations(spark, sf_dir), digests=False), blocks.SHARDS)


def last_heartbeat(spark, sf_dir):
    return blocks.latest_state(_beats(spark, sf_dir), "event_type").select("server", "beat_ms")


def dead_servers(spark, sf_dir):
    beats = _beats(spark, sf_dir)
    now = beats.agg(F.max("beat_ms")).first()[0] or 0
    return blocks.dead_servers(beats.where("event_type = 'error'"), F.lit(now))


def chunk_count(spark, sf_dir):
    return blocks.file_info(_chunks(spark, sf_dir).withColumnRenamed("doc_id", "file"))


def catalogue_merge(spark, sf_dir):
    known = _locations(spark, sf_dir).select("file_no", "fragment", "server")
    full = known.where("server = 1 and file_no % 5 <> 0")
    short = known.where("server = 2").withColumn("file_no", F.col("file_no") + 1000)
    return blocks.merged_catalogue(blocks.merged_catalogue(known, full, True), short, False)


def file_parts(spark, sf_dir):
    """The stored parts of one file, found by the file's column of their key."""
    return blocks.parts_of(_locations(spark, sf_dir), "file_no", 7).select("file_no", "fragment", "server")


def alive_replicas(spark, sf_dir):
    """Replicas on servers that aren't lost: a semi join with the registry."""
    alive = blocks.used_space(_locations(spark, sf_dir)).where("server % 5 <> 2").select("server")
    return _locations(spark, sf_dir).join(alive, "server", "left_semi").groupBy("file_no").agg(F.count_distinct("server").alias("replicas"))


def read_failover(spark, sf_dir):
    replicas = _locations(spark, sf_dir).groupBy("file_no", "server").agg(F.min("fragment").alias("place"))
    return blocks.read_choice(replicas.where("server < 9").withColumn("place", F.col("server")), (F.col("server") + F.col("file_no")) % 3 != 0)


def rereplication_plan(spark, sf_dir):
    found = _locations(spark, sf_dir)
    return blocks.rereplication(found, blocks.used_space(found), LOST)


def fragment_health(spark, sf_dir):
    return blocks.fragment_health(_locations(spark, sf_dir).where("server % 4 <> 1 or file_no % 3 = 0"))


def fragment_plan(spark, sf_dir):
    found = _locations(spark, sf_dir)
    one = found.groupBy("file_no", "fragment").agg(F.max("server").alias("server"))
    return blocks.fragment_repair(one, blocks.used_space(found, digests=False), LOST)


def part_names(spark, sf_dir):
    """Paths and names of stored parts, composed and taken apart again."""
    found = _locations(spark, sf_dir).select("file_no", "fragment", clean_path(F.concat(F.lit("./dir/"), F.col("file_no"), F.lit(".bin"))).alias("path"))
    named = found.withColumn("name", part_name(base_name(F.col("path")), F.col("file_no") % 5, F.col("fragment"))).withColumn("p", part_of(F.col("name")))
    where = host_port(F.concat_ws(":", F.lit("node"), (F.col("fragment") + 9000).cast("string")))
    return named.select("path", "name", "p.file", "p.chunk", "p.shard", where["host"].alias("host"), where["port"].alias("port")).distinct()


def rs_roundtrip(spark, sf_dir):
    """Chunks sharded, three shards of each taken away, and restored: whether the bytes are the same."""
    chunks = _chunks(spark, sf_dir).select("doc_id", "chunk", F.col("data").cast("binary").alias("data"))
    shards = erasure.shards_of(chunks, ["doc_id", "chunk"])
    left = shards.where(F.pmod(F.col("shard") + F.col("doc_id"), F.lit(3)) != 0)
    back = erasure.restored(left, ["doc_id", "chunk"])
    return back.join(chunks.withColumnRenamed("data", "was"), ["doc_id", "chunk"]).select("doc_id", "chunk", F.col("data").eqNullSafe(F.col("was")).alias("same"), F.octet_length("data").alias("size"))


def pow_sha3(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    return erasure.with_proof(nodes, "s_name", PROOF_BITS)


QUERIES = {
    f.__name__: f
    for f in (
        block_chunks, block_slice_sha1, block_corruption, used_space, place_replicas, place_shards, last_heartbeat, dead_servers, chunk_count, catalogue_merge, alive_replicas, read_failover, rereplication_plan,
        fragment_health, fragment_plan, part_names, file_parts, rs_roundtrip, pow_sha3,
    )
}

_LOC = f"WITH {ctes('locations')}"
_BEATS = f"WITH {ctes('heartbeats')}, hb AS (SELECT server, CAST(floor(epoch_us(beat_at) / 1000) AS BIGINT) AS beat_ms, event_type FROM heartbeats)"
_CHUNK = f"c AS (SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, (i - 1) * {CHARS} + 1, {CHARS}) AS data FROM documents, unnest(range(1, CAST(ceil(length(text) / {CHARS}.0) AS BIGINT) + 1)) AS u(i) WHERE length(text) > 0)"
_SHA = f"list_transform(range(0, 8), lambda i: sha1(substr({{0}}, i * {SLICE} + 1, {SLICE})))"
_SPACE = "sp AS (SELECT server, count(*) AS parts, CAST(sum(data_size + {0}) AS BIGINT) AS used, CAST(1073741824 - sum(data_size + {0}) AS BIGINT) AS free FROM locations GROUP BY server)"
_S160, _S0 = _SPACE.format(160), _SPACE.format(0)

ORACLE_SQL = {
    "block_chunks": f"WITH {_CHUNK} SELECT doc_id, chunk, CAST(length(data) AS INT) AS chars FROM c",
    "block_slice_sha1": f"WITH {_CHUNK} SELECT doc_id, chunk, array_to_string({_SHA.format('data')}, ',') AS digests FROM c",
    "block_corruption": f"""WITH {_CHUNK}, x AS (SELECT doc_id, chunk, data, CASE WHEN doc_id % 7 <> 0 THEN data WHEN length(data) < doc_id % 8 * {SLICE} + 4 THEN data || '#' ELSE substr(data, 1, CAST(doc_id % 8 * {SLICE} + 4 AS INT)) || '#' || substr(data, CAST(doc_id % 8 * {SLICE} + 6 AS INT)) END AS hurt FROM c)
      SELECT doc_id, chunk, CAST(coalesce(list_position(list_transform(range(0, 8), lambda i: substr(data, i * {SLICE} + 1, {SLICE}) <> substr(hurt, i * {SLICE} + 1, {SLICE})), true), 0) AS INT) AS bad_slice FROM x""",
    "used_space": f"{_LOC}, {_S160} SELECT * FROM sp",
    "place_replicas": f"{_LOC}, {_S160} SELECT *, CAST(row_number() OVER (ORDER BY free DESC, server) AS INT) AS place FROM sp QUALIFY place <= 3",
    "place_shards": f"{_LOC}, {_S0} SELECT *, CAST(row_number() OVER (ORDER BY free DESC, server) AS INT) AS place FROM sp QUALIFY place <= 9",
    "last_heartbeat": f"{_BEATS} SELECT server, max(beat_ms) AS beat_ms FROM hb GROUP BY server",
    "dead_servers": f"{_BEATS} SELECT server, max(beat_ms) AS last_ms, (SELECT max(beat_ms) FROM hb) - max(beat_ms) AS silent_ms FROM hb WHERE event_type = 'error' GROUP BY server HAVING (SELECT max(beat_ms) FROM hb) - max(beat_ms) > 180000",
    "chunk_count": f"WITH {_CHUNK} SELECT doc_id AS file, max(chunk) AS last_chunk FROM c GROUP BY doc_id",
    "catalogue_merge": f"""{_LOC} SELECT DISTINCT file_no, fragment, server FROM locations WHERE server <> 1 OR file_no % 5 <> 0 UNION SELECT file_no + 1000, fragment, server FROM locations WHERE server = 2""",
    "file_parts": f"{_LOC} SELECT file_no, fragment, server FROM locations WHERE file_no = 7",
    "alive_replicas": f"{_LOC} SELECT file_no, count(DISTINCT server) AS replicas FROM locations WHERE server % 5 <> 2 GROUP BY file_no",
    "read_failover": f"""{_LOC}, r AS (SELECT DISTINCT file_no, server, (server + file_no) % 3 <> 0 AS ok FROM locations WHERE server < 9), f AS (SELECT *, min(server) FILTER (ok) OVER (PARTITION BY file_no) AS first_ok FROM r)
      SELECT file_no, max(first_ok) AS source, count(*) FILTER (NOT ok AND (first_ok IS NULL OR server < first_ok)) AS skipped FROM f GROUP BY file_no""",
    "rereplication_plan": f"""{_LOC}, {_S160}, h AS (SELECT file_no, list_sort(list(DISTINCT server)) AS held FROM locations GROUP BY file_no HAVING bool_or(server = {LOST}))
      SELECT file_no, list_filter(held, lambda s: s <> {LOST})[1] AS source, (SELECT server FROM sp WHERE server <> {LOST} AND NOT list_contains(held, server) ORDER BY free DESC, server LIMIT 1) AS target FROM h""",
    "fragment_health": f"""{_LOC}, h AS (SELECT file_no, list(DISTINCT fragment) AS held FROM locations WHERE server % 4 <> 1 OR file_no % 3 = 0 GROUP BY file_no)
      SELECT file_no, CAST(len(held) AS INT) AS available, array_to_string(list_filter(range(0, 9), lambda i: NOT list_contains(held, i)), ',') AS missing, len(held) >= 6 AS restorable FROM h""",
    "fragment_plan": f"""{_LOC}, {_S0}, o AS (SELECT file_no, fragment, max(server) AS server FROM locations GROUP BY 1, 2),
      f AS (SELECT file_no, list(struct_pack(f := fragment, s := server) ORDER BY fragment) FILTER (server <> {LOST}) AS l, list(fragment ORDER BY fragment) FILTER (server = {LOST}) AS gone FROM o GROUP BY file_no),
      g AS (SELECT *, list_transform(l, lambda x: x.s) AS held FROM f WHERE len(gone) > 0 AND len(l) >= 6),
      t AS (SELECT file_no, server, row_number() OVER (PARTITION BY file_no ORDER BY free DESC, server) AS n FROM g, sp WHERE server <> {LOST} AND NOT list_contains(held, server)),
      u AS (SELECT file_no, l, unnest(gone) AS fragment, unnest(range(1, len(gone) + 1)) AS n FROM g)
      SELECT u.file_no, u.fragment, t.server AS target, array_to_string(list_transform(l[1:6], lambda x: x.f || ':' || x.s), ',') AS sources FROM u LEFT JOIN t ON t.file_no = u.file_no AND t.n = u.n""",
    "part_names": f"""{_LOC} SELECT DISTINCT '/dir/' || file_no || '.bin' AS path, file_no || '.bin_chunk' || file_no % 5 || '_shard' || fragment AS name, file_no || '.bin' AS file, CAST(file_no % 5 AS INT) AS chunk, CAST(fragment AS INT) AS shard,
      'node' AS host, CAST(fragment + 9000 AS INT) AS port FROM locations""",
}
