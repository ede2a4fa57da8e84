"""Streaming jobs of the three layers.

Each is one spec: a source, a pure transformation, and a sink.  Gated batches
are written aside and published whole, by one rename: a batch that runs again
replaces what it left unfinished, and leaves alone what was published.  Streams
that read the table know files by name, and new names would be read as new rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import gold, quality, silver
from ..rules import RULES, Rules
from ..schemas import SPECIAL, TABLES, TRIP, WEATHER, set_up
from ..sources.files import decoded, record_stream
from ..sources.record_log import log_stream
from ..sources.staged import ASIDE, batch_path, exists, publish, read_table, remove, stage
from ..sources.tables import overwrite

log = logging.getLogger(__name__)

PAYLOADS = {"trips": TRIP, "weather": WEATHER, "events": SPECIAL}
Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Job:
    """One streaming job; paths are below ``root``, and so is its checkpoint."""

    name: str
    source: str
    target: str
    schema: T.StructType
    transform: Transform
    every: str
    files_per_batch: int = 10
    constraints: tuple[quality.Constraint, ...] = ()


def _silver(make: Transform, keys: list[str]) -> Transform:
    return lambda bronze: silver.unmatched(make(bronze), keys)


def _gold(make: Transform) -> Transform:
    return lambda rows: make(rows.withWatermark("timestamp", "2 minutes"))


def jobs(rules: Rules = RULES) -> dict[str, Job]:
    """All jobs by name. Dimensions are a batch load: ``load_dimensions``."""
    bronze = {n: TABLES[f"bronze.{n}"].schema for n in ("trips", "weather", "events")}
    made = [
        Job("trips-cleaned", "bronze/trips", "silver/trips_cleaned", bronze["trips"], _silver(lambda b: silver.trips(b, rules), silver.TRIP_KEYS), "30 seconds", constraints=tuple(quality.TRIPS)),
        Job("weather-cleaned", "bronze/weather", "silver/weather_cleaned", bronze["weather"], _silver(lambda b: silver.weather(b, rules), silver.WEATHER_KEYS), "30 seconds", constraints=tuple(quality.WEATHER)),
        Job("events-cleaned", "bronze/events", "silver/events_cleaned", bronze["events"], _silver(lambda b: silver.events(b, rules), silver.EVENT_KEYS), "30 seconds", constraints=tuple(quality.EVENTS)),
        Job("trip-metrics-live", "silver/trips_cleaned", "gold/trip_metrics_live", TABLES["silver.trips_cleaned"].schema, _gold(lambda s: gold.trip_metrics(s, rules).withColumn("last_updated", F.current_timestamp())), "60 seconds"),
        Job("pipeline-latency", "silver/trips_cleaned", "monitoring/pipeline_latency_metrics", TABLES["silver.trips_cleaned"].schema, _gold(lambda s: gold.latency(s, F.current_timestamp(), rules, exact=False)), "60 seconds"),
    ]
    return {j.name: j for j in made}


def gated_sink(spark: SparkSession, root: str, job: Job) -> Callable[[DataFrame, int], None]:
    """Writes each batch to the target, or all of it to quarantine if a constraint fails; and a row of metrics.

    A batch is computed once, while it is written beside the target; what its
    constraints ask for is observed in that pass.  Then one rename publishes it.
    A batch that runs again after that changes nothing, one that runs again
    before it starts over.  If metrics can't be written that is logged; if rows
    can't, the batch fails and runs again.
    """
    table, constraints = job.target.replace("/", "."), list(job.constraints)
    spec, quarantine = TABLES[table], quality.quarantine_name(table).replace(".", "/")

    def write(batch: DataFrame, batch_id: int) -> None:
        done, away = batch_path(root, table, batch_id), f"{root}/{quarantine}/batch={batch_id}"
        if exists(spark, done) or exists(spark, away):
            return
        seen = Observation()
        staged = stage(spec.laid_out(batch).observe(seen, *quality.observed(constraints)), root, table, batch_id)
        found = quality.judged(seen.get, constraints)
        if found is None:  # an empty batch
            remove(spark, staged)
            return
        try:
            verdict = spark.createDataFrame([(batch_id, *found)], "batch_id long, record_count long, passed boolean, failures string")
            metrics = quality.metric_rows(verdict, table, job.name, F.current_timestamp())
            metrics.write.mode("overwrite").parquet(f"{root}/monitoring/silver_quality_metrics/job={job.name}/batch={batch_id}")
        except Exception:
            log.exception("metrics of batch %s of %s were not written", batch_id, job.name)
        _, passed, failures = found
        if passed:
            publish(spark, staged, done)
            return
        rows = spark.read.schema(spec.schema).parquet(staged).withColumns({"batch_id": F.lit(batch_id).cast("long"), "failure_reason": F.lit(failures)})
        aside = f"{root}/{quarantine}/{ASIDE}/batch={batch_id}"
        quality.quarantined(rows, F.current_timestamp()).write.mode("overwrite").parquet(aside)
        publish(spark, aside, away)
        remove(spark, staged)

    return write


def start(spark: SparkSession, root: str, job: Job, once: bool = False) -> StreamingQuery:
    """Start a job; ``once`` works off what is there and ends."""
    source = record_stream(spark, f"{root}/{job.source}", job.schema, job.files_per_batch).select(*job.schema.fieldNames())
    writer = job.transform(source)
    spec = TABLES[job.target.replace("/", ".")]
    if not job.constraints:
        writer = spec.laid_out(writer)
    writer = writer.writeStream.queryName(job.name).option("checkpointLocation", f"{root}/checkpoints/{job.target}").outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=job.every)
    if job.constraints:
        return writer.foreachBatch(gated_sink(spark, root, job)).start()
    return writer.partitionBy(spec.partition_column).format("parquet").start(f"{root}/{job.target}")


def start_bronze(spark: SparkSession, root: str, name: str, payload: T.StructType | None = None, every: str = "5 seconds", rules: Rules = RULES) -> StreamingQuery:
    """Records of the log ``records/<name>``, decoded and appended to bronze in its partitions, a bounded number for each batch."""
    spec, payload = TABLES[f"bronze.{name}"], PAYLOADS[name] if payload is None else payload
    records = log_stream(spark, f"{root}/records/{name}", f"{root}/checkpoints/bronze/{name}-positions", rules.offsets_in_batch)
    writer = spec.laid_out(decoded(records, payload)).writeStream.queryName(f"bronze-{name}").option("checkpointLocation", f"{root}/checkpoints/bronze/{name}")
    return writer.outputMode("append").trigger(processingTime=every).partitionBy(spec.partition_column).format("parquet").start(f"{root}/bronze/{name}")


def load_time_dimension(spark: SparkSession, root: str, start: str, end: str, rules: Rules = RULES) -> None:
    """Hours from ``start`` up to ``end``, anew and in full."""
    overwrite(gold.time_dimension(spark, start, end, rules).select(TABLES["gold.time_dim"].schema.fieldNames()), f"{root}/gold/time_dim")


def load_location_dimension(spark: SparkSession, root: str) -> None:
    """The zones of silver trips, anew and in full."""
    trips = read_table(spark, root, "silver.trips_cleaned")
    overwrite(gold.location_dimension(trips).select(TABLES["gold.location_dim"].schema.fieldNames()), f"{root}/gold/location_dim")


def load_dimensions(spark: SparkSession, root: str, start: str, end: str, rules: Rules = RULES) -> None:
    load_time_dimension(spark, root, start, end, rules)
    load_location_dimension(spark, root)


LOADS = ("load-time-dim", "load-location-dim")


def commands() -> list[str]:
    """Everything that ``run`` knows: tables of a layer, bronze streams, silver and gold jobs, dimension loads."""
    layers = sorted({name.split(".")[0] for name in TABLES})
    return [*(f"set-up-{x}" for x in [*layers, "all"]), *PAYLOADS, *jobs(), *LOADS]


def run(spark: SparkSession, root: str, name: str, once: bool = False, start_at: str | None = None, end_at: str | None = None) -> None:
    """Run one command by name until it ends; ``once`` works off what is there.

    Bounds of the calendar, for ``load-time-dim``, are ``start_at`` and
    ``end_at``: without them the first of this month, less a year and plus two.
    """
    if name not in commands():
        raise ValueError(f"{name} is none of {', '.join(commands())}")
    if name.startswith("set-up-"):
        layer = name.removeprefix("set-up-")
        set_up(spark, None if layer == "all" else layer)
    elif name == "load-time-dim":
        month = spark.sql("SELECT date_trunc('month', current_date()) AS m").selectExpr("string(m - INTERVAL 1 YEAR) AS a", "string(m + INTERVAL 2 YEAR) AS b").first()
        load_time_dimension(spark, root, start_at or month["a"], end_at or month["b"])
    elif name == "load-location-dim":
        load_location_dimension(spark, root)
    elif name in PAYLOADS:
        _ended(start_bronze(spark, root, name, every="0 seconds" if once else "5 seconds"), once)
    else:
        _ended(start(spark, root, jobs()[name], once), False)


def _ended(query: StreamingQuery, drain: bool) -> None:
    """Wait for a query; ``drain`` lets it work off what is there, in as many bounded batches as that takes, and stops it."""
    try:
        if drain:
            query.processAllAvailable()
        else:
            query.awaitTermination()
    finally:
        query.stop()
