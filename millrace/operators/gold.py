"""Windowed facts, dimensions and the star over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.columns import is_rush, is_weekend, stable_mean
from ..rules import RULES, Rules


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def trip_metrics(silver: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Counts, sums, means and banded counts by time window, pickup and dropoff."""
    fares = [F.count_if(F.col("fare_category") == label).alias(f"{label}_fare_count") for _, label in R.FARE]
    distances = [F.count_if(F.col("distance_category") == label).alias(f"{label}_trip_count") for _, label in R.DISTANCE]
    grouped = silver.groupBy(F.window("timestamp", rules.metric_window).alias("w"), "pickup_location_id", "dropoff_location_id").agg(
        F.count("*").alias("trip_count"),
        _or_zero(F.sum("fare_amount")).alias("total_revenue"),
        _or_zero(F.sum("trip_distance")).alias("total_distance"),
        _or_zero(F.sum("passenger_count")).alias("total_passengers"),
        _or_zero(F.avg("fare_amount")).alias("avg_fare"),
        _or_zero(F.avg("trip_distance")).alias("avg_distance"),
        _or_zero(F.avg("passenger_count")).alias("avg_passengers"),
        stable_mean(F.col("fare_per_mile")).alias("avg_fare_per_mile"),
        F.count_if("is_rush_hour").alias("rush_hour_trip_count"),
        F.count_if("is_weekend").alias("weekend_trip_count"),
        *fares,
        *distances,
    )
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])


def latency(silver: DataFrame, now: Column, rules: Rules = RULES, exact: bool = True) -> DataFrame:
    """Event counts, rates and latency percentiles by window; whole seconds, in milliseconds.

    Exact percentiles sort each window's values; the approximate ones keep a
    sketch of bounded size, and are what a stream uses.
    """
    seconds = rules.latency_window_seconds

    def percentile(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY lag)") if exact else F.percentile_approx("lag", p, rules.latency_accuracy)

    grouped = lags(silver, now).groupBy(F.window("timestamp", f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("events_processed"),
        *(_or_zero(percentile(p / 100)).cast("long").alias(f"latency_p{p}_ms") for p in (50, 95, 99)),
        _or_zero(F.min("lag")).alias("min_latency_ms"),
        _or_zero(F.max("lag")).alias("max_latency_ms"),
        _or_zero(F.avg("lag")).alias("avg_latency_ms"),
    )
    rate = (F.col("events_processed") / F.lit(float(seconds))).alias("events_per_second")
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events_processed", rate, *grouped.columns[2:])


QUANTILES = (0.5, 0.95, 0.99)
SKETCH_K, SKETCH_ERROR = 800, 0.01  # rank error of a KLL sketch of this k: under 0.6 % with 99 % confidence, 1 % is some 4.7 deviations


def lags(silver: DataFrame, now: Column) -> DataFrame:
    """``(timestamp, lag)``: latency in whole seconds, as milliseconds."""
    return silver.select("timestamp", ((F.unix_timestamp(now) - F.unix_timestamp("timestamp")) * 1000).alias("lag"))


def latency_sketches(measured: DataFrame, rules: Rules = RULES, k: int = SKETCH_K) -> DataFrame:
    """``(window_start, events, sketch)``: quantiles of each window in a sketch of bounded size; windows of a stream as well."""
    grouped = measured.groupBy(F.window("timestamp", f"{rules.latency_window_seconds} seconds").alias("w"))
    return grouped.agg(F.count("*").alias("events"), F.expr(f"kll_sketch_agg_bigint(lag, {k})").alias("sketch")).select(F.col("w.start").alias("window_start"), "events", "sketch")


def merged_sketches(sketches: DataFrame, unit: str) -> DataFrame:
    """``(period, events, sketch)`` of longer periods from those of windows, without their values."""
    return sketches.groupBy(F.date_trunc(unit, "window_start").alias("period")).agg(F.sum("events").alias("events"), F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"))


def rank_errors(measured: DataFrame, estimates: DataFrame, unit: str) -> DataFrame:
    """How far each of ``estimates(period, name, p, estimate)`` is from its rank among the values: 0 where it is a quantile for p, else the distance."""
    each = measured.select(F.date_trunc(unit, "timestamp").alias("period"), "lag").groupBy("period", "lag").agg(F.count("*").alias("n"))
    placed = each.join(estimates, "period").groupBy("period", "name", "p").agg(
        F.sum("n").alias("events"), F.sum(F.when(F.col("lag") < F.col("estimate"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("lag") <= F.col("estimate"), F.col("n")).otherwise(0)).alias("upto")
    )
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("events") - F.col("p"), F.col("p") - F.col("upto") / F.col("events"))
    return placed.select("period", "name", "p", "events", error.alias("error"))


def time_dimension(spark: SparkSession, start: str, end: str, rules: Rules = RULES) -> DataFrame:
    """A row for each hour from ``start`` up to, not including, ``end``."""
    hours = spark.sql("SELECT explode(sequence(CAST(:a AS timestamp), CAST(:b AS timestamp) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour_timestamp", args={"a": start, "b": end})
    at = F.col("hour_timestamp")
    hour = F.hour(at)
    return hours.select(
        "hour_timestamp",
        hour.alias("hour_of_day"),
        F.date_format(at, "EEEE").alias("day_of_week"),
        F.dayofweek(at).alias("day_of_week_num"),
        F.dayofmonth(at).alias("day_of_month"),
        F.month(at).alias("month"),
        F.date_format(at, "MMMM").alias("month_name"),
        F.quarter(at).alias("quarter"),
        F.year(at).alias("year"),
        is_weekend(at).alias("is_weekend"),
        is_rush(hour, rules.rush).alias("is_rush_hour"),
        hour.between(*rules.rush.morning).alias("is_morning_rush"),
        hour.between(*rules.rush.evening).alias("is_evening_rush"),
        F.date_format(at, "yyyy-MM-dd").alias("date_key"),
    )


def location_dimension(silver: DataFrame) -> DataFrame:
    """A row for each zone that a trip starts or ends in."""
    zones = silver.select(F.explode(F.array("pickup_location_id", "dropoff_location_id")).alias("location_id")).distinct()
    return zones.select("location_id", F.concat(F.lit("Zone_"), F.col("location_id")).alias("zone_name"), F.lit("Unknown").alias("borough"), F.lit("Unknown").alias("service_zone"))


def star(metrics: DataFrame, locations: DataFrame, times: DataFrame) -> DataFrame:
    """Metrics with the names of both zones and the calendar of their hour, summed by zone pair and weekend."""
    pick = locations.select(F.col("location_id").alias("pickup_location_id"), F.col("zone_name").alias("pickup_zone"))
    drop = locations.select(F.col("location_id").alias("dropoff_location_id"), F.col("zone_name").alias("dropoff_zone"))
    hours = times.select("hour_timestamp", "is_weekend", "day_of_week")
    joined = metrics.withColumn("hour_timestamp", F.date_trunc("hour", "window_start")).join(pick, "pickup_location_id").join(drop, "dropoff_location_id").join(hours, "hour_timestamp")
    return joined.groupBy("pickup_zone", "dropoff_zone", "day_of_week", "is_weekend").agg(F.sum("trip_count").alias("trips"), F.sum("total_revenue").alias("revenue"))
