"""Bronze rows to silver rows: one select for each stream, then duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.columns import band, flag, is_rush, is_weekend, millis, ratio
from ..rules import RULES, Rules

TRIP_KEYS = ["timestamp", "pickup_location_id", "dropoff_location_id"]
WEATHER_KEYS = ["timestamp", "location_id"]
EVENT_KEYS = ["timestamp", "location_id", "event_type", "start_time"]


def _origin() -> list[Column]:
    return [F.col("ingestion_timestamp"), F.col("offset").alias("bronze_offset"), F.col("partition").alias("bronze_partition")]


def trips(bronze: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Trips with rush-hour and weekend flags and distance and fare bands. A null fare lies in the top band."""
    at, distance, fare = millis(F.col("timestamp")), F.col("tripDistance"), F.col("fareAmount")
    return bronze.select(
        at.alias("timestamp"),
        F.col("pickupLocationId").cast("long").alias("pickup_location_id"),
        F.col("dropoffLocationId").cast("long").alias("dropoff_location_id"),
        distance.alias("trip_distance"),
        fare.alias("fare_amount"),
        F.col("passengerCount").alias("passenger_count"),
        *_origin(),
        is_rush(F.hour(at), rules.rush).alias("is_rush_hour"),
        is_weekend(at).alias("is_weekend"),
        F.hour(at).alias("hour_of_day"),
        F.date_format(at, "EEEE").alias("day_of_week"),
        ratio(fare, distance).alias("fare_per_mile"),
        band(distance, R.DISTANCE).alias("distance_category"),
        band(fare, R.FARE).alias("fare_category"),
    )


def weather(bronze: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Weather with severity, impact level 0 to 3 and bands. Negative precipitation counts as light."""
    w = rules.weather
    condition, rain, wind, heat = F.col("condition"), F.col("precipitation"), F.col("windSpeed"), F.col("temperature")
    level = (
        F.when((condition == "STORM") | (wind > w.high_impact_wind), 3)
        .when(condition.isin("SNOW", "RAIN") | (rain > w.medium_impact_precipitation), 2)
        .when(condition == "FOG", 1)
        .otherwise(0)
    )
    travel = condition.isin(*w.travel_conditions) | (rain > w.medium_impact_precipitation) | (heat < w.extreme_cold) | (heat > w.extreme_hot)
    return bronze.select(
        millis(F.col("timestamp")).alias("timestamp"),
        F.col("locationId").cast("long").alias("location_id"),
        heat,
        rain,
        wind.alias("wind_speed"),
        condition,
        *_origin(),
        flag(condition.isin(*w.severe_conditions) | (rain > w.severe_precipitation) | (wind > w.severe_wind)).alias("is_severe_weather"),
        level.alias("weather_impact_level"),
        band(heat, R.TEMPERATURE).alias("temperature_category"),
        F.when(rain == 0, "none").otherwise(band(rain, R.PRECIPITATION)).alias("precipitation_category"),
        band(wind, R.WIND).alias("wind_category"),
        flag(travel).alias("impacts_travel"),
    )


def events(bronze: DataFrame, rules: Rules = RULES, true_overlap: bool = False) -> DataFrame:
    """Special events that end after they start, with size, demand and duration bands.

    Rush-hour overlap looks at the hours of start and end; with ``true_overlap``
    at every hour between them.
    """
    e, kind, crowd = rules.events, F.col("eventType"), F.col("attendanceEstimate")
    start, end = millis(F.col("startTime")), millis(F.col("endTime"))
    hours = (F.col("endTime") - F.col("startTime")) / F.lit(3600000.0)
    overlap = is_rush(F.hour(start), rules.rush) | is_rush(F.hour(end), rules.rush)
    if true_overlap:
        each = F.sequence(F.lit(0), F.least(F.ceil(hours), F.lit(24)).cast("int"))
        overlap = F.exists(each, lambda h: is_rush(F.hour(F.timestamp_millis(F.least(F.col("startTime") + h * 3600000, F.col("endTime") - 1))), rules.rush))
    demand = F.lit("low_demand")
    for label, kinds in R.DEMAND.items():
        demand = F.when(kind.isin(*kinds), label).otherwise(demand)
    return bronze.where(F.col("startTime") < F.col("endTime")).select(
        millis(F.col("timestamp")).alias("timestamp"),
        F.col("locationId").cast("long").alias("location_id"),
        kind.alias("event_type"),
        crowd.alias("attendance_estimate"),
        F.col("startTime").alias("start_time"),
        F.col("endTime").alias("end_time"),
        F.col("venueName").alias("venue_name"),
        *_origin(),
        flag((crowd > e.major_attendance) | (kind.isin(*e.major_types) & (crowd > e.major_type_attendance))).alias("is_major_event"),
        band(crowd, R.ATTENDANCE).alias("event_size_category"),
        hours.alias("event_duration_hours"),
        overlap.alias("overlaps_rush_hour"),
        is_weekend(start).alias("is_weekend_event"),
        demand.alias("demand_category"),
        F.hour(start).alias("event_start_hour"),
        F.hour(end).alias("event_end_hour"),
        flag(F.trim(F.col("venueName")) != "").alias("has_venue_details"),
        band(hours, R.DURATION).alias("duration_category"),
    )


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the first by bronze offset and partition, then by the other columns, so reruns agree.

    Spark keeps only the first row of each key in a task before it shuffles.
    """
    rest = [c for c in df.columns if c not in (*keys, "bronze_offset", "bronze_partition")]
    order = Window.partitionBy(*keys).orderBy("bronze_offset", "bronze_partition", *rest)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unmatched(df: DataFrame, keys: list[str], delay: str = "5 minutes") -> DataFrame:
    """The streaming form: a key counts as seen until the watermark on ingestion time passes it, and is then forgotten."""
    return df.withWatermark("ingestion_timestamp", delay).dropDuplicatesWithinWatermark(keys)
