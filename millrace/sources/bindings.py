"""Test inputs with the shapes of the library's own tables, made from the provided parquet tables.

Each binding is one SELECT that Spark and DuckDB run alike, so a query and its
SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"

BINDINGS = {
    "trips_bronze": (
        "lineitem",
        """
SELECT
  CAST(1704067200000 + (l_orderkey % 7)*86400000 + ((l_orderkey*5 + l_linenumber) % 24)*3600000
       + ((l_linenumber*37 + l_partkey) % 300)*1000 AS BIGINT) AS ts_ms,
  CAST(CASE WHEN l_orderkey % 500 = 2 THEN 0 ELSE (l_partkey % 11 + 1)*23 END AS INT) AS pickup_location_id,
  CAST(CASE WHEN l_orderkey % 500 = 3 THEN 500 ELSE (l_suppkey % 11 + 1)*23 END AS INT) AS dropoff_location_id,
  CASE l_orderkey % 500 WHEN 4 THEN -l_quantity/2 WHEN 5 THEN l_quantity*0 WHEN 6 THEN l_quantity + 250
       ELSE l_quantity/2 END AS trip_distance,
  CASE l_orderkey % 500 WHEN 0 THEN NULL WHEN 7 THEN -floor(l_extendedprice)/1024
       ELSE CAST(2.5 AS DOUBLE) + floor(l_extendedprice)/1024 END AS fare_amount,
  CAST(CASE l_orderkey % 500 WHEN 1 THEN NULL WHEN 8 THEN 0 WHEN 9 THEN 15
       ELSE l_linenumber % 6 + 1 END AS INT) AS passenger_count,
  CAST(l_partkey % 4 AS INT) AS bronze_partition,
  CAST(l_orderkey*8 + l_linenumber AS BIGINT) AS bronze_offset
FROM lineitem
""",
    ),
    "weather_bronze": (
        "events",
        """
SELECT
  CAST(1704067200000 + (event_id*61 % 604800)*1000 AS BIGINT) AS ts_ms,
  CAST(user_id % 263 + 1 AS INT) AS location_id,
  CAST((event_id*37) % 1600 AS DOUBLE)/10 - 30 AS temperature,
  CAST(event_id % 14 AS DOUBLE)/10 - 0.1 AS precipitation,
  CAST((event_id*13) % 600 AS DOUBLE)/10 AS wind_speed,
  CASE event_type WHEN 'click' THEN 'CLEAR' WHEN 'view' THEN 'CLOUDY' WHEN 'purchase' THEN 'RAIN'
       WHEN 'signup' THEN 'SNOW' ELSE CASE WHEN event_id % 2 = 0 THEN 'FOG' ELSE 'STORM' END END AS condition,
  CAST(event_id % 4 AS INT) AS bronze_partition, event_id AS bronze_offset
FROM events
""",
    ),
    "special_bronze": (
        "orders",
        """
SELECT
  CAST(1704067200000 + (o_orderkey*211 % 2592000)*1000 AS BIGINT) AS ts_ms,
  CAST(o_custkey % 265 AS INT) AS location_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'CONCERT' WHEN 1 THEN 'SPORTS' WHEN 2 THEN 'CONFERENCE'
       WHEN 3 THEN 'FESTIVAL' WHEN 4 THEN 'THEATER' ELSE 'OTHER' END AS event_type,
  CAST(floor(o_totalprice/4) AS INT) AS attendance_estimate,
  CAST(1704067200000 + (o_orderkey*211 % 2592000)*1000 + (o_orderkey % 48)*3600000 AS BIGINT) AS start_ms,
  CAST(1704067200000 + (o_orderkey*211 % 2592000)*1000 + (o_orderkey % 48)*3600000
       + ((o_orderkey % 16) - 1)*3600000 AS BIGINT) AS end_ms,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Venue_' || (o_custkey % 10) END AS venue_name,
  CAST(o_orderkey % 4 AS INT) AS bronze_partition, o_orderkey AS bronze_offset
FROM orders
""",
    ),
    "quizzes": (
        "nation",
        """
SELECT n_nationkey AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN NULL ELSE 'topic_' || n_regionkey END AS topic FROM nation WHERE n_nationkey < 24
""",
    ),
    "questions": (
        "supplier",
        """
SELECT s_suppkey AS id, CAST(s_nationkey AS INT) AS quiz_id, s_name AS question_text, CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END AS correct_answer FROM supplier WHERE s_nationkey < 20
""",
    ),
    "session_answers": (
        "orders",
        """
SELECT o_orderkey AS id, o_custkey AS session_id, o_orderkey % 100 AS question_id, o_orderkey % 3 <> 0 AS is_correct, o_orderdate AS answered_at FROM orders
""",
    ),
    "study_sessions": (
        "customer",
        """
SELECT c_custkey AS id, CAST(c_nationkey AS INT) AS quiz_id, c_custkey % 5 <> 0 AS is_completed FROM customer
""",
    ),
    "node_stats": (
        "events",
        """
SELECT CAST(user_id AS INT) AS node, count(CASE WHEN event_type='click' THEN 1 END) AS generated, count(CASE WHEN event_type='view' THEN 1 END) AS pulled, count(CASE WHEN event_type='purchase' THEN 1 END) AS pushed, count(CASE WHEN event_type IN ('signup','error') THEN 1 END) AS completed FROM events GROUP BY user_id
""",
    ),
    "dht_nodes": (
        "supplier",
        """
SELECT s_suppkey AS node, CAST((s_suppkey*40503 + 7) % 65536 AS BIGINT) AS id16 FROM supplier
""",
    ),
    "heartbeats": (
        "events",
        """
SELECT user_id % 12 AS server, ts AS beat_at, event_type FROM events
""",
    ),
    "locations": (
        "part",
        """
SELECT p_partkey % 200 AS file_no, p_partkey % 9 AS fragment, (p_partkey*7) % 12 AS server, p_size*1024 AS data_size FROM part
""",
    ),
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = BINDINGS[name]
    return spark.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def ctes(*names: str) -> str:
    """The same bindings for a SQL twin."""
    return ",\n".join(f"{n} AS ({BINDINGS[n][1]})" for n in names)


def _ingested(df: DataFrame) -> DataFrame:
    return df.withColumn("ingestion_timestamp", F.lit(AS_OF).cast("timestamp"))


def trips_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {
        "ts_ms": "timestamp", "pickup_location_id": "pickupLocationId", "dropoff_location_id": "dropoffLocationId", "trip_distance": "tripDistance",
        "fare_amount": "fareAmount", "passenger_count": "passengerCount", "bronze_partition": "partition", "bronze_offset": "offset",
    }
    return _ingested(bound(spark, sf_dir, "trips_bronze").withColumnsRenamed(names))


def weather_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"ts_ms": "timestamp", "location_id": "locationId", "wind_speed": "windSpeed", "bronze_partition": "partition", "bronze_offset": "offset"}
    return _ingested(bound(spark, sf_dir, "weather_bronze").withColumnsRenamed(names))


def special_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {
        "ts_ms": "timestamp", "location_id": "locationId", "event_type": "eventType", "attendance_estimate": "attendanceEstimate", "start_ms": "startTime",
        "end_ms": "endTime", "venue_name": "venueName", "bronze_partition": "partition", "bronze_offset": "offset",
    }
    return _ingested(bound(spark, sf_dir, "special_bronze").withColumnsRenamed(names))
