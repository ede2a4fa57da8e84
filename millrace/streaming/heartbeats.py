"""The catalogue of a block store and the liveness of its servers, kept up by heartbeats as they come.

State is kept for each server: the parts it holds and when it was last heard.
A full heartbeat names all its parts, a short one those that are new.  Each
heartbeat sets a timer; a server that is silent until it fires is dead.  The
stream's output are changes, and a table is what the last change of each key
says: as many rows as there are changes, not a copy of the catalogue each time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.blocks import SILENCE_MS

FULL, SHORT = "major", "minor"
BEATS = "server long, beat_at timestamp, kind string, parts array<struct<file_no: long, fragment: long>>"
CHANGES = "server long, change string, file_no long, fragment long, at_ms long, seq int"
Change = Row("server", "change", "file_no", "fragment", "at_ms", "seq")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Server(StatefulProcessor):
    """Changes of one server.

    Heartbeats are taken in order of time, those of one time in order of kind,
    full ones first.  One that is older than the last full one says nothing that
    isn't known better, and is left out; a null list of parts is an empty one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "last_ms long, full_ms long, dead boolean")
        self.parts = handle.getMapState("parts", "file_no long, fragment long", "since_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (server,) = key
        last, full, dead = self.status.get() or (None, None, False)
        before, seq = last, 0
        for beat in sorted(rows, key=lambda r: (r["beat_ms"], r["kind"] != FULL)):
            at = beat["beat_ms"]
            last = at if last is None else max(last, at)
            if full is not None and at < full:
                continue
            named = {(p["file_no"], p["fragment"]) for p in beat["parts"] or []}
            if beat["kind"] == FULL:
                full = at
                for part in [k for k in self.parts.keys() if tuple(k) not in named]:
                    self.parts.removeKey(part)
                    yield Change(server, "drop", *part, at, seq)
                    seq += 1
            for part in sorted(named):
                if not self.parts.containsKey(part):
                    self.parts.updateValue(part, (at,))
                    yield Change(server, "add", *part, at, seq)
                    seq += 1
        if last != before:
            if before is not None and not dead:
                self.handle.deleteTimer(before + SILENCE_MS + 1)
            self.handle.registerTimer(last + SILENCE_MS + 1)
            if dead or before is None:
                yield Change(server, "alive", None, None, last, seq)
            dead = False
        self.status.update((last, full, dead))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (server,) = key
        last, full, _ = self.status.get()
        self.status.update((last, full, True))
        yield Change(server, "dead", None, None, expiredTimerInfo.getExpiryTimeInMs(), 0)

    def close(self) -> None:
        pass


def changes(beats: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``beats(server, beat_at, kind, parts)``, a stream, to changes; heartbeats may come ``delay`` late."""
    timed = beats.withColumn("beat_ms", (F.unix_micros("beat_at") / 1000).cast("long")).withWatermark("beat_at", delay)
    return timed.groupBy("server").transformWithState(Server(), CHANGES, "Append", "EventTime")


def start(spark: SparkSession, beats: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append changes to ``path``; state lies in RocksDB, with its snapshots under ``checkpoint``."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        writer = changes(beats).writeStream.queryName("heartbeats").option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(trigger or {"processingTime": "15 seconds"})).format("parquet").start(path)
    finally:
        spark.conf.set(name, before)


def catalogue(changed: DataFrame) -> DataFrame:
    """``(server, file_no, fragment)`` that servers hold after all changes."""
    parts = changed.where("change in ('add', 'drop')").groupBy("server", "file_no", "fragment")
    return parts.agg(F.max_by("change", F.struct("at_ms", "seq")).alias("change")).where("change = 'add'").drop("change")


def dead(changed: DataFrame) -> DataFrame:
    """``(server, since_ms)`` of servers whose last change of state was to fall silent."""
    state = changed.where("change in ('alive', 'dead')").groupBy("server")
    return state.agg(F.max_by("change", F.struct("at_ms", "seq")).alias("change"), F.max("at_ms").alias("since_ms")).where("change = 'dead'").drop("change")
