"""Schemas of the lakehouse tables, and how they are laid out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def _schema(columns: str) -> T.StructType:
    """Columns from "name type [not null], ..." without a session."""
    found = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind], not rest) for name, kind, *rest in found])


# fixed values: fields of the three event streams
TRIP = _schema("timestamp bigint not null, pickupLocationId int not null, dropoffLocationId int not null, tripDistance double not null, fareAmount double, passengerCount int")
WEATHER = _schema("timestamp bigint not null, locationId int not null, temperature double not null, precipitation double not null, windSpeed double not null, condition string not null")
SPECIAL = _schema(
    "timestamp bigint not null, locationId int not null, eventType string not null, attendanceEstimate int not null, startTime bigint not null, endTime bigint not null, venueName string"
)
TOPICS = {"trips.yellow": TRIP, "weather.updates": WEATHER, "special.events": SPECIAL}

_METADATA = "kafka_key string, topic string, `partition` int, offset bigint, kafka_timestamp timestamp"
_INGESTION = "ingestion_timestamp timestamp, ingestion_date date"


def bronze_schema(payload: T.StructType) -> T.StructType:
    return T.StructType([*_schema(_METADATA), *payload, *_schema(_INGESTION)])


SILVER_TRIPS = _schema(
    "timestamp timestamp not null, pickup_location_id bigint not null, dropoff_location_id bigint not null, trip_distance double not null, fare_amount double not null, passenger_count int not null, "
    "ingestion_timestamp timestamp not null, bronze_offset bigint not null, bronze_partition int not null, is_rush_hour boolean not null, is_weekend boolean not null, hour_of_day int not null, "
    "day_of_week string not null, fare_per_mile double, distance_category string not null, fare_category string not null"
)
SILVER_WEATHER = _schema(
    "timestamp timestamp not null, location_id bigint not null, temperature double not null, precipitation double not null, wind_speed double not null, condition string not null, "
    "ingestion_timestamp timestamp not null, bronze_offset bigint not null, bronze_partition int not null, is_severe_weather boolean not null, weather_impact_level int not null, "
    "temperature_category string not null, precipitation_category string not null, wind_category string not null, impacts_travel boolean not null"
)
SILVER_EVENTS = _schema(
    "timestamp timestamp not null, location_id bigint not null, event_type string not null, attendance_estimate int not null, start_time bigint not null, end_time bigint not null, venue_name string, "
    "ingestion_timestamp timestamp not null, bronze_offset bigint not null, bronze_partition int not null, is_major_event boolean not null, event_size_category string not null, event_duration_hours double not null, "
    "overlaps_rush_hour boolean not null, is_weekend_event boolean not null, demand_category string not null, event_start_hour int not null, event_end_hour int not null, has_venue_details boolean not null, duration_category string not null"
)
QUALITY_METRICS = _schema(
    "timestamp timestamp, table_name string, job_name string, batch_id bigint, record_count bigint, status string, all_checks_passed boolean, passed_checks bigint, failed_checks bigint, "
    "constraint_failures string, batch_quarantined boolean"
)

TRIP_METRICS = _schema(
    "window_start timestamp, window_end timestamp, pickup_location_id bigint not null, dropoff_location_id bigint not null, trip_count bigint not null, total_revenue double not null, total_distance double not null, "
    "total_passengers bigint not null, avg_fare double not null, avg_distance double not null, avg_passengers double not null, avg_fare_per_mile double, rush_hour_trip_count bigint not null, weekend_trip_count bigint not null, "
    "economy_fare_count bigint not null, standard_fare_count bigint not null, premium_fare_count bigint not null, luxury_fare_count bigint not null, short_trip_count bigint not null, medium_trip_count bigint not null, "
    "long_trip_count bigint not null, very_long_trip_count bigint not null, last_updated timestamp not null"
)
TIME_DIM = _schema(
    "hour_timestamp timestamp not null, hour_of_day int not null, day_of_week string not null, day_of_week_num int not null, day_of_month int not null, month int not null, month_name string not null, quarter int not null, "
    "year int not null, is_weekend boolean not null, is_rush_hour boolean not null, is_morning_rush boolean not null, is_evening_rush boolean not null, date_key string not null"
)
LOCATION_DIM = _schema("location_id bigint not null, zone_name string, borough string, service_zone string")
LATENCY_METRICS = _schema(
    "window_start timestamp, window_end timestamp, events_processed bigint not null, events_per_second double, latency_p50_ms bigint not null, latency_p95_ms bigint not null, latency_p99_ms bigint not null, "
    "min_latency_ms bigint not null, max_latency_ms bigint not null, avg_latency_ms double not null"
)


@dataclass(frozen=True)
class TableSpec:
    """A table: its columns, and the time column and unit that its files are partitioned by."""

    name: str
    schema: T.StructType
    time: str | None = None
    unit: str | None = None

    @property
    def partition_column(self) -> str | None:
        return f"{self.time}_{self.unit}" if self.time else None

    def ddl(self) -> str:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in self.schema)
        layout = f", `{self.partition_column}` timestamp) USING parquet PARTITIONED BY (`{self.partition_column}`)" if self.time else ") USING parquet"
        return f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}{layout} OPTIONS (compression 'zstd')"

    def laid_out(self, df: DataFrame) -> DataFrame:
        """``df`` with the partition column added and its rows sent to one task for each of its values."""
        if not self.time:
            return df
        out = df.withColumn(self.partition_column, F.date_trunc(self.unit, self.time))
        return out if df.isStreaming else out.repartition(self.partition_column)


TABLES = {
    spec.name: spec
    for spec in (
        TableSpec("bronze.trips", bronze_schema(TRIP), "ingestion_timestamp", "hour"),
        TableSpec("bronze.weather", bronze_schema(WEATHER), "ingestion_timestamp", "hour"),
        TableSpec("bronze.events", bronze_schema(SPECIAL), "ingestion_timestamp", "day"),
        TableSpec("silver.trips_cleaned", SILVER_TRIPS, "timestamp", "day"),
        TableSpec("silver.weather_cleaned", SILVER_WEATHER, "timestamp", "day"),
        TableSpec("silver.events_cleaned", SILVER_EVENTS, "timestamp", "month"),
        TableSpec("gold.trip_metrics_live", TRIP_METRICS, "window_start", "day"),
        TableSpec("gold.time_dim", TIME_DIM),
        TableSpec("gold.location_dim", LOCATION_DIM),
        TableSpec("monitoring.silver_quality_metrics", QUALITY_METRICS, "timestamp", "day"),
        TableSpec("monitoring.pipeline_latency_metrics", LATENCY_METRICS, "window_start", "day"),
    )
}


def set_up(spark: SparkSession, layer: str | None = None) -> list[str]:
    """Create the tables of one layer, or of all; the first failure ends it. Tables are created empty: no sample rows go in."""
    made = []
    for name, spec in sorted(TABLES.items()):
        space = name.split(".")[0]
        if layer in (None, space):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {space}")
            spark.sql(spec.ddl())
            made.append(name)
    return made
