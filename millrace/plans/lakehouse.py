"""Queries of the lakehouse, each with its DuckDB twin."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.columns import flag, without_zone
from ..operators import gold, quality, silver
from ..operators.numbering import numbered
from ..rules import RULES
from ..schemas import TRIP
from ..sources.bindings import AS_OF, bound, ctes, special_bronze, trips_bronze, weather_bronze
from ..sources.files import decoded
from ..sources.record_log import append_log, log_range
from ..sources.shared import kept, shared_dir

CALENDAR = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")
TRIP_JOB = "trips-cleaned"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.trips(trips_bronze(spark, sf_dir))


def _unique_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.first_of_each(_trips(spark, sf_dir), silver.TRIP_KEYS)


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_batch(_unique_trips(spark, sf_dir), RULES.rows_in_batch)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate(_batched(spark, sf_dir), quality.TRIPS)[0].drop("batch_id")


def bronze_metadata(spark, sf_dir):
    """Trips as broker records with JSON values, decoded again."""
    raw = trips_bronze(spark, sf_dir)
    records = raw.select(
        F.col("pickupLocationId").cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*TRIP.fieldNames())).alias("value"),
        F.lit("trips.yellow").alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis("timestamp").alias("timestamp"),
    )
    return without_zone(decoded(records, TRIP, _as_of()))


LOG_RANGE = {"0": (10, 400), "1": (0, 37), "3": (100, 101)}  # first and last but one offset by partition; partition 2 is read to its end


def log_offset_range(spark, sf_dir):
    """Trips as a log of records in four partitions, read back by offsets."""
    raw = trips_bronze(spark, sf_dir)
    records = raw.select(
        F.col("pickupLocationId").cast("string").cast("binary").alias("key"),
        F.concat_ws(":", "partition", "offset").cast("binary").alias("value"),
        F.lit("trips.yellow").alias("topic"),
        F.timestamp_millis("timestamp").alias("timestamp"),
    )
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    append_log(spark, records, path, by=F.col("key").cast("string").cast("int"))
    start, end = (json.dumps({p: r[i] for p, r in LOG_RANGE.items()}) for i in (0, 1))
    found = log_range(spark, path, start, end)
    return without_zone(found.select("partition", "offset", "timestamp", *(F.col(c).cast("string").alias(c) for c in ("key", "value"))))


def silver_trips(spark, sf_dir):
    return without_zone(_trips(spark, sf_dir))


def silver_weather(spark, sf_dir):
    return without_zone(silver.weather(weather_bronze(spark, sf_dir)))


def silver_events(spark, sf_dir):
    return without_zone(silver.events(special_bronze(spark, sf_dir)))


def silver_trips_dedup(spark, sf_dir):
    return without_zone(_unique_trips(spark, sf_dir))


def silver_weather_dedup(spark, sf_dir):
    return without_zone(silver.first_of_each(silver.weather(weather_bronze(spark, sf_dir)), silver.WEATHER_KEYS))


def silver_events_dedup(spark, sf_dir):
    return without_zone(silver.first_of_each(silver.events(special_bronze(spark, sf_dir)), silver.EVENT_KEYS))


def zones_in_order(spark, sf_dir):
    """The zones of all trips, sorted as a whole."""
    return numbered(gold.location_dimension(_trips(spark, sf_dir)), ["location_id"], "place", first=1).orderBy("place")


def quarantine_names(spark, sf_dir):
    """Where rows of a table go that the gate turns away; one table for each nation."""
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "lake.").otherwise(""), F.lit("silver."), F.lower("n_name"), F.lit("_cleaned"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(name.alias("table_name"), quality.quarantined_to(name).alias("quarantine"))


def dq_trips(spark, sf_dir):
    return quality.report(_trips(spark, sf_dir), quality.TRIPS)


def dq_weather(spark, sf_dir):
    return quality.report(silver.weather(weather_bronze(spark, sf_dir)), quality.WEATHER)


def dq_events(spark, sf_dir):
    return quality.report(silver.events(special_bronze(spark, sf_dir)), quality.EVENTS)


def gate_verdict(spark, sf_dir):
    found = quality.verdicts(_batched(spark, sf_dir), quality.TRIPS)
    return without_zone(quality.metric_rows(found, "silver.trips_cleaned", TRIP_JOB, _as_of()))


def gate_accepted(spark, sf_dir):
    return without_zone(_accepted(spark, sf_dir))


def gate_quarantined(spark, sf_dir):
    return without_zone(quality.quarantined(quality.gate(_batched(spark, sf_dir), quality.TRIPS)[1], _as_of()))


def gate_rows(spark, sf_dir):
    """The gate by row: how many rows break which constraints."""
    bad = quality.gate(_batched(spark, sf_dir), quality.TRIPS, mode="row")[1]
    return bad.groupBy("failure_reason").agg(F.count("*").alias("n_rows"))


def dq_pass_rate(spark, sf_dir):
    return quality.pass_rate(quality.metric_rows(quality.verdicts(_batched(spark, sf_dir), quality.TRIPS), "silver.trips_cleaned", TRIP_JOB, _as_of()))


def gold_trip_metrics(spark, sf_dir):
    return without_zone(gold.trip_metrics(_accepted(spark, sf_dir)))


def gold_latency_exact(spark, sf_dir):
    return without_zone(gold.latency(_accepted(spark, sf_dir), _as_of()))


def gold_latency_approx(spark, sf_dir):
    return without_zone(gold.latency(_accepted(spark, sf_dir), _as_of(), exact=False))


def latency_rank_errors(spark, sf_dir):
    """Latency quantiles of hours and days, from merged sketches of windows and from one approximate aggregation: whether each lies within its stated rank error."""
    measured = gold.lags(_accepted(spark, sf_dir), _as_of())
    sketches = kept(gold.latency_sketches(measured))
    ps = F.array(*map(F.lit, gold.QUANTILES))
    parts = []
    for unit in ("hour", "day"):
        merged = gold.merged_sketches(sketches, unit).select("period", F.lit("sketch").alias("name"), F.expr(f"kll_sketch_get_quantile_bigint(sketch, array({', '.join(f'{p}D' for p in gold.QUANTILES)}))").alias("q"))
        approx = measured.groupBy(F.date_trunc(unit, "timestamp").alias("period")).agg(F.percentile_approx("lag", list(gold.QUANTILES), R.RULES.latency_accuracy).alias("q")).select("period", F.lit("approx").alias("name"), "q")
        both = merged.unionByName(approx).select("period", "name", F.explode(F.arrays_zip(ps.alias("p"), F.col("q").alias("estimate"))).alias("e")).select("period", "name", "e.*")
        parts.append(gold.rank_errors(measured, both, unit).withColumn("unit", F.lit(unit)))
    bound = F.when(F.col("name") == "sketch", gold.SKETCH_ERROR).otherwise(1 / R.RULES.latency_accuracy) + 1 / F.col("events")  # a rank is whole: one value more
    return without_zone(parts[0].unionByName(parts[1]).select("unit", "period", "name", "p", "events", (F.col("error") <= bound).alias("within")))


def dim_time(spark, sf_dir):
    return without_zone(gold.time_dimension(spark, *CALENDAR))


def dim_location(spark, sf_dir):
    return gold.location_dimension(_trips(spark, sf_dir))


def star_trip_metrics(spark, sf_dir):
    trips = _accepted(spark, sf_dir)
    return gold.star(gold.trip_metrics(trips), gold.location_dimension(trips), gold.time_dimension(spark, *CALENDAR))


# validity as producers see it


def _outside(c, low, high):
    return (c < low) | (c > high)


def trip_invalid():
    d, fare, n = F.col("trip_distance"), F.col("fare_amount"), F.col("passenger_count")
    zones = _outside(F.col("pickup_location_id"), *R.ZONES) | _outside(F.col("dropoff_location_id"), *R.ZONES)
    return flag(zones) | flag((d <= R.VALID_DISTANCE[0]) | (d > R.VALID_DISTANCE[1])) | flag(fare < 0) | flag((n <= R.VALID_PASSENGERS[0]) | (n > R.VALID_PASSENGERS[1]))


def weather_invalid():
    dry = F.col("condition").isin(*R.DRY_CONDITIONS) & (F.col("precipitation") > R.DRY_PRECIPITATION)
    return flag(_outside(F.col("location_id"), *R.ZONES) | _outside(F.col("temperature"), *R.VALID_TEMPERATURE) | (F.col("precipitation") < 0) | (F.col("wind_speed") < 0) | dry)


def special_invalid():
    return flag(_outside(F.col("location_id"), *R.ZONES) | _outside(F.col("attendance_estimate"), *R.VALID_ATTENDANCE) | (F.col("end_ms") <= F.col("start_ms")))


def _validity(name, invalid):
    def query(spark, sf_dir):
        return bound(spark, sf_dir, name).select("bronze_offset", "bronze_partition", invalid().alias("is_invalid"))

    return query


def producer_stats(spark, sf_dir):
    """Valid and invalid records by stream, and in total."""
    streams = (("trips_bronze", trip_invalid), ("weather_bronze", weather_invalid), ("special_bronze", special_invalid))
    rows = [bound(spark, sf_dir, n).select(F.lit(n.removesuffix("_bronze")).alias("stream"), bad().alias("bad")) for n, bad in streams]
    counted = rows[0].unionByName(rows[1]).unionByName(rows[2]).rollup("stream")
    counted = counted.agg(F.count("*").alias("sent"), F.count_if(~F.col("bad")).alias("valid"), F.count_if("bad").alias("invalid"))
    return counted.withColumn("stream", F.coalesce("stream", F.lit("TOTAL")))


QUERIES = {
    f.__name__: f
    for f in (
        bronze_metadata, log_offset_range, silver_trips, silver_weather, silver_events, silver_trips_dedup, silver_weather_dedup, silver_events_dedup, zones_in_order, quarantine_names, dq_trips, dq_weather, dq_events, gate_verdict, gate_accepted,
        gate_quarantined, gate_rows, dq_pass_rate, gold_trip_metrics, gold_latency_exact, gold_latency_approx, latency_rank_errors, dim_time, dim_location, star_trip_metrics, producer_stats,
    )
}
QUERIES |= {
    "validity_trips": _validity("trips_bronze", trip_invalid),
    "validity_weather": _validity("weather_bronze", weather_invalid),
    "validity_events": _validity("special_bronze", special_invalid),
}

# DuckDB twins

_NOW = f"TIMESTAMP '{AS_OF}'"
_RUSH = "(({0} BETWEEN 7 AND 9) OR ({0} BETWEEN 16 AND 19))"


def _case(value: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {hi} THEN '{label}'" for hi, label in bands if hi is not None) + f" ELSE '{bands[-1][1]}' END"


SILVER_TRIPS = f"""st AS (
  SELECT make_timestamp(ts_ms * 1000) AS timestamp, CAST(pickup_location_id AS BIGINT) AS pickup_location_id, CAST(dropoff_location_id AS BIGINT) AS dropoff_location_id,
    trip_distance, fare_amount, passenger_count, {_NOW} AS ingestion_timestamp, bronze_offset, bronze_partition,
    {_RUSH.format("hour(make_timestamp(ts_ms * 1000))")} AS is_rush_hour, dayofweek(make_timestamp(ts_ms * 1000)) IN (0, 6) AS is_weekend,
    CAST(hour(make_timestamp(ts_ms * 1000)) AS INT) AS hour_of_day, dayname(make_timestamp(ts_ms * 1000)) AS day_of_week,
    CASE WHEN trip_distance > 0 THEN fare_amount / trip_distance END AS fare_per_mile,
    {_case("trip_distance", R.DISTANCE)} AS distance_category, {_case("fare_amount", R.FARE)} AS fare_category
  FROM trips_bronze)"""
UNIQUE_TRIPS = """ut AS (
  SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY timestamp, pickup_location_id, dropoff_location_id
    ORDER BY bronze_offset, bronze_partition, trip_distance NULLS FIRST, fare_amount NULLS FIRST, passenger_count NULLS FIRST) = 1)"""


def _test(c: quality.Constraint) -> str:
    if c.kind == "complete":
        return f"count(*) FILTER ({c.column} IS NULL) = 0"
    return f"coalesce({c.kind}({c.column}) {'>=' if c.kind == 'min' else '<='} {c.bound}, false)"


def _report(table: str, constraints) -> str:
    lines = [
        f"SELECT '{c.name}' AS \"constraint\", CAST({f'count(*) FILTER ({c.column} IS NULL)' if c.kind == 'complete' else f'{c.kind}({c.column})'} AS DOUBLE) AS metric, {_test(c)} AS passed FROM {table}"
        for c in constraints
    ]
    return " UNION ALL ".join(lines)


_FAILED = "list_filter([" + ", ".join(f"CASE WHEN NOT ({_test(c)}) THEN '{c.name}' END" for c in quality.TRIPS) + "], lambda x: x IS NOT NULL)"
VERDICTS = f"""bt AS (SELECT *, CAST(floor(bronze_offset / 80) AS BIGINT) AS batch_id FROM ut),
vd AS (SELECT batch_id, count(*) AS record_count, {_FAILED} AS failed FROM bt GROUP BY batch_id)"""
ACCEPTED = "ac AS (SELECT bt.* EXCLUDE (batch_id) FROM bt JOIN vd USING (batch_id) WHERE len(failed) = 0)"
METRICS = """tm AS (
  SELECT time_bucket(INTERVAL '5 minutes', timestamp) AS window_start, time_bucket(INTERVAL '5 minutes', timestamp) + INTERVAL '5 minutes' AS window_end, pickup_location_id, dropoff_location_id,
    count(*) AS trip_count, coalesce(sum(fare_amount), 0) AS total_revenue, coalesce(sum(trip_distance), 0) AS total_distance, CAST(coalesce(sum(passenger_count), 0) AS BIGINT) AS total_passengers,
    coalesce(avg(fare_amount), 0) AS avg_fare, coalesce(avg(trip_distance), 0) AS avg_distance, coalesce(avg(passenger_count), 0) AS avg_passengers, avg(CAST(floor(fare_per_mile * 1073741824) AS BIGINT)) / CAST(1073741824 AS DOUBLE) AS avg_fare_per_mile,
    count(*) FILTER (is_rush_hour) AS rush_hour_trip_count, count(*) FILTER (is_weekend) AS weekend_trip_count,
    """ + ", ".join(
    [f"count(*) FILTER (fare_category = '{x}') AS {x}_fare_count" for _, x in R.FARE] + [f"count(*) FILTER (distance_category = '{x}') AS {x}_trip_count" for _, x in R.DISTANCE]
) + """
  FROM ac GROUP BY ALL)"""
CALENDAR_SQL = f"""cal AS (
  SELECT h AS hour_timestamp, CAST(hour(h) AS INT) AS hour_of_day, dayname(h) AS day_of_week, CAST(dayofweek(h) + 1 AS INT) AS day_of_week_num, CAST(day(h) AS INT) AS day_of_month, CAST(month(h) AS INT) AS month,
    monthname(h) AS month_name, CAST(quarter(h) AS INT) AS quarter, CAST(year(h) AS INT) AS year, dayofweek(h) IN (0, 6) AS is_weekend, {_RUSH.format("hour(h)")} AS is_rush_hour,
    hour(h) BETWEEN 7 AND 9 AS is_morning_rush, hour(h) BETWEEN 16 AND 19 AS is_evening_rush, strftime(h, '%Y-%m-%d') AS date_key
  FROM range(TIMESTAMP '{CALENDAR[0]}', TIMESTAMP '{CALENDAR[1]}', INTERVAL 1 HOUR) AS r(h))"""
_TRIPS, _UNIQUE = f"WITH {ctes('trips_bronze')}, {SILVER_TRIPS}", f"WITH {ctes('trips_bronze')}, {SILVER_TRIPS}, {UNIQUE_TRIPS}"
_GATED = f"{_UNIQUE}, {VERDICTS}, {ACCEPTED}"

SILVER_WEATHER = f"""sw AS (
  SELECT make_timestamp(ts_ms * 1000) AS timestamp, CAST(location_id AS BIGINT) AS location_id, temperature, precipitation, wind_speed, condition, {_NOW} AS ingestion_timestamp, bronze_offset, bronze_partition,
    condition IN ('SNOW', 'STORM') OR precipitation > 1.0 OR wind_speed > 30.0 AS is_severe_weather,
    CAST(CASE WHEN condition = 'STORM' OR wind_speed > 50.0 THEN 3 WHEN condition IN ('SNOW', 'RAIN') OR precipitation > 0.5 THEN 2 WHEN condition = 'FOG' THEN 1 ELSE 0 END AS INT) AS weather_impact_level,
    {_case("temperature", R.TEMPERATURE)} AS temperature_category, CASE WHEN precipitation = 0 THEN 'none' ELSE {_case("precipitation", R.PRECIPITATION)} END AS precipitation_category,
    {_case("wind_speed", R.WIND)} AS wind_category, condition IN ('STORM', 'SNOW', 'FOG') OR precipitation > 0.5 OR temperature < 20.0 OR temperature > 95.0 AS impacts_travel
  FROM weather_bronze)"""
SILVER_EVENTS = f"""se AS (
  SELECT make_timestamp(ts_ms * 1000) AS timestamp, CAST(location_id AS BIGINT) AS location_id, event_type, attendance_estimate, start_ms AS start_time, end_ms AS end_time, venue_name,
    {_NOW} AS ingestion_timestamp, bronze_offset, bronze_partition,
    attendance_estimate > 20000 OR (event_type IN ('SPORTS', 'CONCERT') AND attendance_estimate > 10000) AS is_major_event, {_case("attendance_estimate", R.ATTENDANCE)} AS event_size_category,
    (end_ms - start_ms) / CAST(3600000 AS DOUBLE) AS event_duration_hours,
    {_RUSH.format("hour(make_timestamp(start_ms * 1000))")} OR {_RUSH.format("hour(make_timestamp(end_ms * 1000))")} AS overlaps_rush_hour,
    dayofweek(make_timestamp(start_ms * 1000)) IN (0, 6) AS is_weekend_event,
    CASE WHEN event_type IN ('SPORTS', 'CONCERT') THEN 'high_demand' WHEN event_type IN ('CONFERENCE', 'FESTIVAL') THEN 'medium_demand' ELSE 'low_demand' END AS demand_category,
    CAST(hour(make_timestamp(start_ms * 1000)) AS INT) AS event_start_hour, CAST(hour(make_timestamp(end_ms * 1000)) AS INT) AS event_end_hour,
    venue_name IS NOT NULL AND trim(venue_name) <> '' AS has_venue_details, {_case("(end_ms - start_ms) / CAST(3600000 AS DOUBLE)", R.DURATION)} AS duration_category
  FROM special_bronze WHERE start_ms < end_ms)"""
_BAD = {
    "trips": "coalesce(pickup_location_id NOT BETWEEN 1 AND 263, false) OR coalesce(dropoff_location_id NOT BETWEEN 1 AND 263, false) OR coalesce(trip_distance <= 0 OR trip_distance > 100, false) "
    "OR coalesce(fare_amount < 0, false) OR coalesce(passenger_count <= 0 OR passenger_count > 10, false)",
    "weather": "location_id NOT BETWEEN 1 AND 263 OR temperature NOT BETWEEN -50 AND 150 OR precipitation < 0 OR wind_speed < 0 OR (condition IN ('CLEAR', 'CLOUDY', 'FOG') AND precipitation > 0.1)",
    "special": "location_id NOT BETWEEN 1 AND 263 OR attendance_estimate NOT BETWEEN 0 AND 100000 OR end_ms <= start_ms",
}


def _valid(name: str) -> str:
    return f"WITH {ctes(name + '_bronze')} SELECT bronze_offset, bronze_partition, {_BAD[name]} AS is_invalid FROM {name}_bronze"


ORACLE_SQL = {
    "bronze_metadata": f"""WITH {ctes("trips_bronze")}
      SELECT CAST(pickup_location_id AS VARCHAR) AS kafka_key, 'trips.yellow' AS topic, bronze_partition AS "partition", bronze_offset AS "offset", make_timestamp(ts_ms * 1000) AS kafka_timestamp, ts_ms AS timestamp,
        pickup_location_id AS "pickupLocationId", dropoff_location_id AS "dropoffLocationId", trip_distance AS "tripDistance", fare_amount AS "fareAmount", passenger_count AS "passengerCount",
        {_NOW} AS ingestion_timestamp, CAST({_NOW} AS DATE) AS ingestion_date FROM trips_bronze""",
    "log_offset_range": f"""WITH {ctes("trips_bronze")}, r AS (SELECT CAST(pickup_location_id AS VARCHAR) AS "key", bronze_partition || ':' || bronze_offset AS "value", make_timestamp(ts_ms * 1000) AS timestamp,
        CAST(pickup_location_id % 4 AS INT) AS "partition" FROM trips_bronze),
      n AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY timestamp, "key", "value") - 1 AS "offset" FROM r)
      SELECT * FROM n WHERE {" OR ".join(f'"partition" = {p} AND "offset" >= {a} AND "offset" < {b}' for p, (a, b) in LOG_RANGE.items())} OR "partition" = 2""",
    "silver_trips": f"{_TRIPS} SELECT * FROM st",
    "silver_weather": f"WITH {ctes('weather_bronze')}, {SILVER_WEATHER} SELECT * FROM sw",
    "silver_events": f"WITH {ctes('special_bronze')}, {SILVER_EVENTS} SELECT * FROM se",
    "silver_trips_dedup": f"{_UNIQUE} SELECT * FROM ut",
    "silver_weather_dedup": f"WITH {ctes('weather_bronze')}, {SILVER_WEATHER} SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY timestamp, location_id ORDER BY bronze_offset, bronze_partition) = 1",
    "dq_trips": f"{_TRIPS} {_report('st', quality.TRIPS)}",
    "dq_weather": f"WITH {ctes('weather_bronze')}, {SILVER_WEATHER} {_report('sw', quality.WEATHER)}",
    "silver_events_dedup": f"WITH {ctes('special_bronze')}, {SILVER_EVENTS} SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY timestamp, location_id, event_type, start_time ORDER BY bronze_offset, bronze_partition) = 1",
    "quarantine_names": """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'lake.' ELSE '' END || 'silver.' || lower(n_name) || '_cleaned' AS table_name,
      CASE WHEN n_nationkey % 2 = 0 THEN 'lake.' ELSE '' END || 'quarantine.' || lower(n_name) || '_quarantined' AS quarantine FROM nation""",
    "zones_in_order": f"""{_TRIPS} SELECT *, row_number() OVER (ORDER BY location_id) AS place FROM (SELECT DISTINCT location_id, 'Zone_' || location_id AS zone_name, 'Unknown' AS borough, 'Unknown' AS service_zone
      FROM (SELECT pickup_location_id AS location_id FROM st UNION ALL SELECT dropoff_location_id FROM st)) ORDER BY location_id""",
    "dq_events": f"WITH {ctes('special_bronze')}, {SILVER_EVENTS} {_report('se', quality.EVENTS)}",
    "gate_verdict": f"""{_UNIQUE}, {VERDICTS}
      SELECT {_NOW} AS timestamp, 'silver.trips_cleaned' AS table_name, '{TRIP_JOB}' AS job_name, batch_id, record_count, CASE WHEN len(failed) = 0 THEN 'Success' ELSE 'Error' END AS status,
        len(failed) = 0 AS all_checks_passed, CAST(len(failed) = 0 AS BIGINT) AS passed_checks, CAST(len(failed) > 0 AS BIGINT) AS failed_checks,
        CASE WHEN len(failed) > 0 THEN array_to_string(failed, '; ') END AS constraint_failures, len(failed) > 0 AS batch_quarantined FROM vd""",
    "gate_accepted": f"{_GATED} SELECT * FROM ac",
    "gate_quarantined": f"""{_GATED} SELECT bt.* EXCLUDE (batch_id), array_to_string(failed, '; ') AS failure_reason, {_NOW} AS quarantine_timestamp, batch_id AS batch_id_quarantine, 'FAILED' AS validation_status
      FROM bt JOIN vd USING (batch_id) WHERE len(failed) > 0""",
    "gate_rows": f"""{_UNIQUE}, r AS (SELECT array_to_string(list_filter([{", ".join(
        f"CASE WHEN {c.column + (' IS NULL' if c.kind == 'complete' else (' < ' if c.kind == 'min' else ' > ') + str(c.bound))} THEN '{c.name}' END" for c in quality.TRIPS
    )}], lambda x: x IS NOT NULL), '; ') AS failure_reason FROM ut) SELECT failure_reason, count(*) AS n_rows FROM r WHERE failure_reason <> '' GROUP BY 1""",
    "dq_pass_rate": f"{_UNIQUE}, {VERDICTS} SELECT 'silver.trips_cleaned' AS table_name, count(*) AS batches, avg(CAST(len(failed) = 0 AS INT)) * 100 AS pass_rate FROM vd",
    "latency_rank_errors": f"""{_GATED} SELECT unit, date_trunc(unit, timestamp) AS period, name, CAST(p AS DOUBLE) AS p, count(*) AS events, true AS within
      FROM ac, unnest(['hour', 'day']) AS u(unit), unnest(['sketch', 'approx']) AS m(name), unnest([{", ".join(map(str, gold.QUANTILES))}]) AS q(p) GROUP BY ALL""",
    "gold_trip_metrics": f"{_GATED}, {METRICS} SELECT * FROM tm",
    "gold_latency_exact": f"""{_GATED}, lg AS (SELECT time_bucket(INTERVAL '2 minutes', timestamp) AS w, CAST(epoch({_NOW}) - floor(epoch(timestamp)) AS BIGINT) * 1000 AS lag FROM ac)
      SELECT w AS window_start, w + INTERVAL '2 minutes' AS window_end, count(*) AS events_processed, count(*) / CAST(120 AS DOUBLE) AS events_per_second, quantile_disc(lag, 0.5) AS latency_p50_ms,
        quantile_disc(lag, 0.95) AS latency_p95_ms, quantile_disc(lag, 0.99) AS latency_p99_ms, min(lag) AS min_latency_ms, max(lag) AS max_latency_ms, avg(lag) AS avg_latency_ms FROM lg GROUP BY w""",
    "dim_time": f"WITH {CALENDAR_SQL} SELECT * FROM cal",
    "dim_location": f"""{_TRIPS} SELECT location_id, 'Zone_' || location_id AS zone_name, 'Unknown' AS borough, 'Unknown' AS service_zone
      FROM (SELECT pickup_location_id AS location_id FROM st UNION SELECT dropoff_location_id FROM st)""",
    "star_trip_metrics": f"""{_GATED}, {METRICS}, {CALENDAR_SQL}
      SELECT 'Zone_' || pickup_location_id AS pickup_zone, 'Zone_' || dropoff_location_id AS dropoff_zone, day_of_week, is_weekend, CAST(sum(trip_count) AS BIGINT) AS trips, sum(total_revenue) AS revenue
      FROM tm JOIN cal ON hour_timestamp = date_trunc('hour', window_start) GROUP BY ALL""",
    "producer_stats": f"""WITH {ctes("trips_bronze", "weather_bronze", "special_bronze")}, a AS (
      SELECT 'trips' AS stream, {_BAD["trips"]} AS bad FROM trips_bronze UNION ALL SELECT 'weather', {_BAD["weather"]} FROM weather_bronze UNION ALL SELECT 'special', {_BAD["special"]} FROM special_bronze)
      SELECT coalesce(stream, 'TOTAL') AS stream, count(*) AS sent, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid FROM a GROUP BY ROLLUP (stream)""",
    "validity_trips": _valid("trips"),
    "validity_weather": _valid("weather"),
    "validity_events": _valid("special"),
}

