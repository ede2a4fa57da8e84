"""Queries of the seeded generators and their faults, with DuckDB twins: 10,000 rows each, which read no table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, silver
from ..sources import generators as G

ROWS, SEED, FAULT_SEED, RATE = 10_000, 1, 2, 0.2


def synth_trips(spark, sf_dir, n=ROWS):
    return G.trips(spark, n, SEED)


def synth_weather(spark, sf_dir, n=ROWS):
    return G.weather(spark, n, SEED)


def synth_events(spark, sf_dir, n=ROWS):
    return G.special_events(spark, n, SEED)


def synth_faults(spark, sf_dir, n=ROWS):
    """Faults put into generated trips, and how many of each kind the gate's constraints catch by row."""
    faulty = G.with_trip_faults(G.trips(spark, n, SEED), RATE, FAULT_SEED)
    bronze = faulty.withColumns({"ingestion_timestamp": F.timestamp_millis("timestamp"), "offset": F.col("id"), "partition": F.lit(0)})
    rows = silver.trips(bronze).join(faulty.select(F.col("id").alias("bronze_offset"), "fault"), "bronze_offset")
    return rows.groupBy("fault").agg(F.count("*").alias("n_rows"), F.count(quality.row_failures(rows, quality.TRIPS)).alias("caught"))


def synth_weather_faults(spark, sf_dir, n=ROWS):
    """Generated weather with faults, row by row."""
    return G.with_weather_faults(G.weather(spark, n, SEED), RATE, FAULT_SEED)


def synth_event_faults(spark, sf_dir, n=ROWS):
    """Generated special events with faults, row by row."""
    return G.with_event_faults(G.special_events(spark, n, SEED), RATE, FAULT_SEED)


QUERIES = {f.__name__: f for f in (synth_trips, synth_weather, synth_events, synth_faults, synth_weather_faults, synth_event_faults)}

# DuckDB twins


def _r(seed: int) -> str:
    return f"(CAST('0x' || substr(md5(id || ':{seed}'), 1, 13) AS BIGINT) * {2.0**-52!r})"


def _of(at: str, shares: dict) -> str:
    edges, total, so_far = [], sum(shares.values()), 0.0
    for value, share in shares.items():
        so_far += share
        edges.append(f"WHEN {at} < {so_far / total!r}e0 THEN {value!r}")
    return f"CASE {' '.join(edges)} ELSE {next(iter(shares))!r} END"


def _between(at: str, low: float, high: float) -> str:
    return f"({low!r}e0 + {at} * {high - low!r}e0)"


def _gauss(seed: int) -> str:
    return f"(sqrt(-2e0 * ln(1e0 - {_r(seed)})) * cos(6.283185307179586e0 * {_r(seed + 1)}))"


def _zone(at: str) -> str:
    return f"CAST(floor({at} * 263) + 1 AS INT)"


def _base(step_seconds: int) -> str:
    return f"id, {G.START_MS} + id * {step_seconds * 1000} AS timestamp"


_S, _W, _E = SEED * 100, SEED * 100 + 20, SEED * 100 + 40
_FROM = f"FROM range({ROWS}) AS t(id)"
_KIND = "CASE WHEN {} < {}e0 THEN {} END AS fault"
_BAD_ZONE = f"CASE WHEN {_r(FAULT_SEED + 11)} < 0.5e0 THEN 0 ELSE CAST(floor({_r(FAULT_SEED + 12)} * 500) + 500 AS INT) END"
_VENUES = "[" + ", ".join(f"{{'zone': {z}, 'name': '{v}', 'kind': '{k}', 'low': {a}, 'high': {b}}}" for z, v, k, a, b in G.VENUES) + "]"
_HOURS = "CASE " + " ".join(f"WHEN \"eventType\" = '{k}' THEN {h}" for k, h in G.HOURS.items()) + " ELSE 4 END"


def _fault(kinds: dict) -> str:
    return _KIND.format(_r(FAULT_SEED), RATE, _of(_r(FAULT_SEED + 1), kinds))


_WEATHER = f"""w AS (SELECT {_base(60)}, {_of(_r(_W), G.CONDITIONS)} AS condition {_FROM}),
  weather AS (SELECT id, timestamp, {_zone(_r(_W + 3))} AS "locationId", round(least(greatest({_gauss(_S + 27)} * 15 + 60, 10e0), 95e0), 1) AS temperature,
    round(CASE condition WHEN 'RAIN' THEN {_between(_r(_W + 1), 0.1, 0.5)} WHEN 'SNOW' THEN {_between(_r(_W + 1), 0.05, 0.3)} WHEN 'STORM' THEN {_between(_r(_W + 1), 0.5, 2.0)} ELSE 0e0 END, 2) AS precipitation,
    round(CASE WHEN condition IN ('CLEAR', 'CLOUDY') THEN {_between(_r(_W + 2), 0.0, 10.0)} WHEN condition = 'STORM' THEN {_between(_r(_W + 2), 20.0, 50.0)} ELSE {_between(_r(_W + 2), 5.0, 20.0)} END, 1) AS "windSpeed", condition FROM w)"""
_EVENTS = f"""e AS (SELECT {_base(600)}, CASE WHEN {_r(_E)} < 0.7e0 THEN {_VENUES}[CAST(floor({_r(_E + 1)} * {len(G.VENUES)}) AS INT) + 1] END AS v {_FROM}),
  k AS (SELECT *, coalesce(v.kind, {_of(_r(_E + 2), G.EVENT_TYPES)}) AS "eventType", timestamp + CAST(floor({_r(_E + 3)} * 48) AS BIGINT) * 3600000 AS "startTime" FROM e),
  events AS (SELECT id, timestamp, coalesce(v.zone, {_zone(_r(_E + 6))}) AS "locationId", "eventType", CAST(floor(coalesce(v.low, 100) + {_r(_E + 4)} * (coalesce(v.high, 5000) + 1 - coalesce(v.low, 100))) AS INT) AS "attendanceEstimate",
    "startTime", "startTime" + greatest(1, CAST(floor({_HOURS} * {_between(_r(_E + 5), 0.5, 1.5)}) AS BIGINT)) * 3600000 AS "endTime", v.name AS "venueName" FROM k)"""
_X = _r(FAULT_SEED + 10)

ORACLE_SQL = {
    "synth_trips": f"""WITH g AS (SELECT {_base(1)}, round(least(greatest({_gauss(_S + 7)} * 2.5e0 + 3.5e0, 0.5e0), 20e0), 2) AS d {_FROM})
      SELECT id, timestamp, {_zone(_r(_S + 2))} AS "pickupLocationId", {_zone(_r(_S + 3))} AS "dropoffLocationId", d AS "tripDistance",
        round((2.5e0 + d * 2.5e0 + CASE WHEN {_r(_S)} < 0.3e0 THEN 2.5e0 ELSE 0e0 END) * {_between(_r(_S + 1), 0.95, 1.05)}, 2) AS "fareAmount", {_of(_r(_S + 4), G.PASSENGERS)} AS "passengerCount" FROM g""",
    "synth_weather": f"WITH {_WEATHER} SELECT * FROM weather",
    "synth_events": f"WITH {_EVENTS} SELECT * FROM events",
    "synth_faults": f"WITH f AS (SELECT {_fault(G.FAULTS)} {_FROM}) SELECT fault, count(*) AS n_rows, CASE WHEN fault IS NULL THEN 0 ELSE count(*) END AS caught FROM f GROUP BY fault",
    "synth_weather_faults": f"""WITH {_WEATHER}, f AS (SELECT *, {_fault(dict.fromkeys(G.WEATHER_FAULTS, 1.0))} FROM weather)
      SELECT id, timestamp, "locationId", CASE fault WHEN 'EXTREME_COLD' THEN -100e0 - {_X} * 50e0 WHEN 'EXTREME_HEAT' THEN 150e0 + {_X} * 50e0 ELSE temperature END AS temperature,
        CASE fault WHEN 'NEGATIVE_PRECIPITATION' THEN -{_X} * 5e0 WHEN 'WET_CLEAR_SKY' THEN 2e0 + {_X} * 3e0 ELSE precipitation END AS precipitation,
        CASE fault WHEN 'NEGATIVE_WIND' THEN -{_X} * 50e0 ELSE "windSpeed" END AS "windSpeed", CASE fault WHEN 'WET_CLEAR_SKY' THEN 'CLEAR' ELSE condition END AS condition, fault FROM f""",
    "synth_event_faults": f"""WITH {_EVENTS}, f AS (SELECT *, {_fault(dict.fromkeys(G.EVENT_FAULTS, 1.0))} FROM events)
      SELECT id, timestamp, CASE fault WHEN 'INVALID_ZONE' THEN {_BAD_ZONE} ELSE "locationId" END AS "locationId", "eventType",
        CASE fault WHEN 'NEGATIVE_CROWD' THEN -CAST(floor({_X} * 10000) AS INT) WHEN 'VAST_CROWD' THEN CAST(floor({_X} * 900000) + 100001 AS INT) ELSE "attendanceEstimate" END AS "attendanceEstimate",
        "startTime", CASE fault WHEN 'ENDS_FIRST' THEN "startTime" - 3600000 ELSE "endTime" END AS "endTime", "venueName", fault FROM f""",
}
