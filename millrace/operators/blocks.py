"""Stored files as chunks and fragments: digests, placement, health, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: slices in a chunk and the bytes of their digests, space of a server, copies, shards, silence of a lost server
SLICES, DIGEST_BYTES = 8, 20
SERVER_SPACE = 1 << 30
COPIES, DATA_SHARDS, PARITY_SHARDS = 3, 6, 3
SHARDS = DATA_SHARDS + PARITY_SHARDS
SILENCE_MS = 180_000


def slice_digests(data: Column, slice_size: int, slices: int = SLICES) -> Column:
    """SHA-1 of each slice of a chunk; slices past its end are empty, and hashed as such."""
    return F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.sha1(F.substring(data, i * slice_size + 1, F.lit(slice_size)).cast("binary")))


def first_bad_slice(stored: Column, found: Column) -> Column:
    """The number, from 1, of the first slice whose digest isn't the stored one; 0 if all agree, null without stored digests, -1 if there are too few of them."""
    bad = F.array_position(F.zip_with(stored, found, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(F.size(stored) < F.size(found), F.lit(-1)).otherwise(bad).cast("int")


def used_space(locations: DataFrame, digests: bool = True) -> DataFrame:
    """``(server, parts, used, free)`` from ``locations(server, data_size)``; with ``digests``, a chunk's digest file counts too."""
    extra = SLICES * DIGEST_BYTES if digests else 0
    used = F.sum(F.col("data_size") + extra).cast("long")
    return locations.groupBy("server").agg(F.count("*").alias("parts"), used.alias("used")).withColumn("free", F.lit(SERVER_SPACE) - F.col("used"))


def placement(space: DataFrame, copies: int = COPIES) -> DataFrame:
    """The ``copies`` servers with most room, ties by id; none if there are fewer. ``place`` is the order in which data is passed on."""
    best = space.orderBy(F.desc("free"), "server").limit(copies)
    order = Window.orderBy(F.desc("free"), "server")
    ranked = best.withColumn("place", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return ranked.where(F.col("_n") == copies).drop("_n")


def dead_servers(beats: DataFrame, now_ms: Column) -> DataFrame:
    """``beats(server, beat_ms)`` to servers that have been silent too long."""
    last = beats.groupBy("server").agg(F.max("beat_ms").alias("last_ms"))
    return last.withColumn("silent_ms", now_ms - F.col("last_ms")).where(F.col("silent_ms") > SILENCE_MS)


def latest_state(beats: DataFrame, value: str, at: str = "beat_ms") -> DataFrame:
    return beats.groupBy("server").agg(F.max(at).alias(at), F.max_by(value, at).alias(value))


def file_info(locations: DataFrame) -> DataFrame:
    return locations.groupBy("file").agg(F.coalesce(F.max("chunk"), F.lit(0)).alias("last_chunk"))


def parts_of(locations: DataFrame, key: str, file: str | int) -> DataFrame:
    """The rows of one file; an equality, which reaches the scan."""
    return locations.where(F.col(key) == F.lit(file))


def merged_catalogue(catalogue: DataFrame, beat: DataFrame, full: bool) -> DataFrame:
    """``catalogue(file_no, fragment, server)`` after a heartbeat: a full one replaces what its servers had, a short one adds to it."""
    kept = catalogue.join(beat.select("server").distinct(), "server", "left_anti") if full else catalogue
    return kept.select(*catalogue.columns).unionByName(beat.select(*catalogue.columns)).distinct()


def _servers_by_room(space: DataFrame) -> list[int]:
    """Server ids, most room first: one for each machine of the store."""
    return [r["server"] for r in space.orderBy(F.desc("free"), "server").select("server").collect()]


def _outside(servers: list, taken: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, servers)), taken)


def read_choice(replicas: DataFrame, healthy: Column) -> DataFrame:
    """``(file_no, source, skipped)``: the first healthy replica by ``place`` of each file, and the ones before it that failed."""
    order = Window.partitionBy("file_no").orderBy("place")
    marked = replicas.withColumn("_ok", healthy).withColumn("_rank", F.min(F.when(F.col("_ok"), F.col("place"))).over(Window.partitionBy("file_no")))
    marked = marked.withColumn("_rn", F.row_number().over(order))
    return marked.groupBy("file_no").agg(
        F.max(F.when(F.col("place") == F.col("_rank"), F.col("server"))).alias("source"),
        F.count_if(~F.col("_ok") & (F.col("_rank").isNull() | (F.col("place") < F.col("_rank")))).alias("skipped"),
    )


def rereplication(locations: DataFrame, space: DataFrame, lost: int) -> DataFrame:
    """``(file_no, source, target)`` for each file that ``lost`` held: copied from its first other holder to the roomiest server that holds none; without either, null."""
    servers = _servers_by_room(space.where(F.col("server") != lost))
    holders = locations.groupBy("file_no").agg(F.array_sort(F.collect_set("server")).alias("held")).where(F.array_contains("held", lost))
    others = F.array_remove("held", lost)
    return holders.select("file_no", F.get(others, 0).alias("source"), F.get(_outside(servers, F.col("held")), 0).alias("target"))


def fragment_health(locations: DataFrame) -> DataFrame:
    """Distinct fragments of each file, those that are missing, and whether the rest are enough to restore it."""
    held = locations.groupBy("file_no").agg(F.array_sort(F.collect_set("fragment")).alias("held"))
    missing = F.array_except(F.sequence(F.lit(0).cast(locations.schema["fragment"].dataType), F.lit(SHARDS - 1).cast(locations.schema["fragment"].dataType)), "held")
    return held.select("file_no", F.size("held").alias("available"), F.array_join(missing.cast("array<string>"), ",").alias("missing"), (F.size("held") >= DATA_SHARDS).alias("restorable"))


def fragment_repair(locations: DataFrame, space: DataFrame, lost: int) -> DataFrame:
    """``(file_no, fragment, target, sources)`` for each fragment that only ``lost`` held, if enough others are left.

    Each fragment goes to a server of its own that holds none of the file, in
    order of room; sources are (fragment:server) pairs, lowest fragments first.
    """
    servers = _servers_by_room(space.where(F.col("server") != lost))
    each = locations.groupBy("file_no", "fragment").agg(F.min(F.when(F.col("server") != lost, F.col("server"))).alias("server"), F.max((F.col("server") == lost).cast("int")).alias("was"))
    files = each.groupBy("file_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("server").isNotNull(), F.struct("fragment", "server")))).alias("left"),
        F.array_sort(F.collect_list(F.when(F.col("server").isNull() & (F.col("was") == 1), F.col("fragment")))).alias("gone"),
    )
    files = files.where((F.size("gone") > 0) & (F.size("left") >= DATA_SHARDS))
    free = _outside(servers, F.transform("left", lambda x: x["server"]))
    sources = F.array_join(F.transform(F.slice("left", 1, DATA_SHARDS), lambda x: F.concat_ws(":", x["fragment"].cast("string"), x["server"].cast("string"))), ",")
    return files.select("file_no", F.posexplode("gone").alias("_i", "fragment"), free.alias("_free"), sources.alias("sources")).select("file_no", "fragment", F.get("_free", F.col("_i")).alias("target"), "sources")
