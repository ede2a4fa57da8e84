"""Seeded event generators and faults, as column expressions over a range of ids."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1704067200000

# fixed values: shares of conditions, event types, passengers and faults; known venues (zone, name, type, smallest and largest crowd)
CONDITIONS = {"CLEAR": 0.40, "CLOUDY": 0.30, "RAIN": 0.15, "SNOW": 0.08, "FOG": 0.05, "STORM": 0.02}
EVENT_TYPES = {"CONCERT": 0.30, "SPORTS": 0.25, "CONFERENCE": 0.20, "FESTIVAL": 0.15, "THEATER": 0.05, "OTHER": 0.05}
PASSENGERS = {1: 0.70, 2: 0.15, 3: 0.05, 4: 0.04, 5: 0.03, 6: 0.03}
FAULTS = {
    "NULL_FARE": 0.20, "NULL_PASSENGERS": 0.15, "INVALID_PICKUP_ZONE": 0.15, "INVALID_DROPOFF_ZONE": 0.15, "NEGATIVE_DISTANCE": 0.10, "ZERO_DISTANCE": 0.10,
    "EXCESSIVE_DISTANCE": 0.05, "NEGATIVE_FARE": 0.05, "ZERO_PASSENGERS": 0.03, "EXCESSIVE_PASSENGERS": 0.02,
}
WEATHER_FAULTS = ("EXTREME_COLD", "EXTREME_HEAT", "NEGATIVE_PRECIPITATION", "NEGATIVE_WIND", "WET_CLEAR_SKY")
EVENT_FAULTS = ("NEGATIVE_CROWD", "VAST_CROWD", "ENDS_FIRST", "INVALID_ZONE")
VENUES = [
    (186, "Madison Square Garden", "SPORTS", 15000, 25000), (186, "Madison Square Garden", "CONCERT", 18000, 20000), (132, "Yankee Stadium", "SPORTS", 45000, 55000),
    (125, "Citi Field", "SPORTS", 38000, 45000), (162, "Lincoln Center", "THEATER", 2000, 5000), (164, "Barclays Center", "SPORTS", 17000, 19000),
    (164, "Barclays Center", "CONCERT", 15000, 19000), (162, "Carnegie Hall", "CONCERT", 2800, 2800), (237, "Javits Center", "CONFERENCE", 5000, 40000), (43, "Central Park", "FESTIVAL", 10000, 50000),
]
HOURS = {"CONCERT": 3, "SPORTS": 4, "CONFERENCE": 8, "FESTIVAL": 10, "THEATER": 3, "OTHER": 4}


@dataclass(frozen=True)
class StreamSettings:
    """What a stream of generated events carries: events a second (none at 0), share of faults, number of events (None: no end)."""

    topic: str
    rate: float
    faults: float = 0.0
    total: int | None = None

    def problems(self) -> list[str]:
        checks = {"rate is below 0": self.rate >= 0, "share of faults is outside 0 to 1": 0 <= self.faults <= 1, "number of events is below 1": self.total is None or self.total >= 1}
        return [text for text, holds in checks.items() if not holds]


# fixed values: topics and events a second of the streams, by the prefix of their settings
STREAMS = {"TRIP": StreamSettings("trips.yellow", 500.0), "WEATHER": StreamSettings("weather.updates", 10.0), "EVENT": StreamSettings("special.events", 0.1)}


def stream_settings(given: Mapping[str, str]) -> dict[str, StreamSettings]:
    """Streams as ``given`` (``os.environ``, say) sets them: ``<prefix>_TOPIC``, ``_RATE``, ``_ERROR_RATE`` and ``_TOTAL_EVENTS`` (-1: no end).

    All that is wrong is told in one error: values that aren't numbers or out of range, and that no stream would run.
    """
    made, wrong = {}, []
    for prefix, usual in STREAMS.items():
        try:
            total = int(given.get(f"{prefix}_TOTAL_EVENTS", -1))
            rate, faults = (float(given.get(f"{prefix}_{name}", value)) for name, value in (("RATE", usual.rate), ("ERROR_RATE", usual.faults)))
        except ValueError as e:
            wrong.append(f"{prefix}: {e}")
            continue
        made[prefix] = StreamSettings(given.get(f"{prefix}_TOPIC", usual.topic), rate, faults, None if total == -1 else total)
        wrong += [f"{prefix}: {text}" for text in made[prefix].problems()]
    if not wrong and not any(s.rate for s in made.values()):
        wrong.append("no stream has a rate above 0")
    if wrong:
        raise ValueError("; ".join(wrong))
    return made


def draw(seed: int) -> Column:
    """A number in [0, 1) for each ``id``, the same in every run and however rows are dealt out: the first 52 bits of an MD5, so that other engines draw it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(seed))), 1, 13), 16, 10).cast("long") * F.lit(2.0**-52)


def gauss(seed: int) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - draw(seed))) * F.cos(F.lit(6.283185307179586) * draw(seed + 1))


def weighted(at: Column, shares: dict) -> Column:
    """The choice whose share of [0, 1) holds ``at``; shares are taken in proportion."""
    total, so_far, out = sum(shares.values()), 0.0, None
    for value, share in shares.items():
        so_far += share
        out = F.when(at < so_far / total, value) if out is None else out.when(at < so_far / total, value)
    return out.otherwise(next(iter(shares)))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def between(at: Column, low: float | Column, high: float | Column) -> Column:
    return low + at * (high - low)


def _base(spark: SparkSession, n: int, step_seconds: int) -> DataFrame:
    return spark.range(n).withColumn("timestamp", F.lit(START_MS) + F.col("id") * step_seconds * 1000)


def _zone(at: Column) -> Column:
    return (F.floor(at * 263) + 1).cast("int")


def trips(spark: SparkSession, n: int, seed: int = 0, step_seconds: int = 1) -> DataFrame:
    r = [draw(seed * 100 + i) for i in range(6)]
    drawn = _base(spark, n, step_seconds).withColumn("tripDistance", F.round(clamped(gauss(seed * 100 + 7) * 2.5 + 3.5, 0.5, 20.0), 2))
    fare = (2.5 + F.col("tripDistance") * 2.5 + F.when(r[0] < 0.3, 2.5).otherwise(0.0)) * between(r[1], 0.95, 1.05)
    return drawn.select(
        "id", "timestamp", _zone(r[2]).alias("pickupLocationId"), _zone(r[3]).alias("dropoffLocationId"), "tripDistance", F.round(fare, 2).alias("fareAmount"), weighted(r[4], PASSENGERS).alias("passengerCount")
    )


def weather(spark: SparkSession, n: int, seed: int = 0, step_seconds: int = 60) -> DataFrame:
    r = [draw(seed * 100 + 20 + i) for i in range(4)]
    drawn = _base(spark, n, step_seconds).withColumn("condition", weighted(r[0], CONDITIONS))
    kind = F.col("condition")
    rain = F.when(kind == "RAIN", between(r[1], 0.1, 0.5)).when(kind == "SNOW", between(r[1], 0.05, 0.3)).when(kind == "STORM", between(r[1], 0.5, 2.0)).otherwise(0.0)
    wind = F.when(kind.isin("CLEAR", "CLOUDY"), between(r[2], 0.0, 10.0)).when(kind == "STORM", between(r[2], 20.0, 50.0)).otherwise(between(r[2], 5.0, 20.0))
    heat = F.round(clamped(gauss(seed * 100 + 27) * 15 + 60, 10.0, 95.0), 1)
    return drawn.select("id", "timestamp", _zone(r[3]).alias("locationId"), heat.alias("temperature"), F.round(rain, 2).alias("precipitation"), F.round(wind, 1).alias("windSpeed"), "condition")


def special_events(spark: SparkSession, n: int, seed: int = 0, step_seconds: int = 600) -> DataFrame:
    """Seven in ten at a known venue; lengths vary by half either way, in whole hours."""
    r = [draw(seed * 100 + 40 + i) for i in range(8)]
    venues = F.array(*(F.struct(F.lit(z).alias("zone"), F.lit(v).alias("name"), F.lit(t).alias("kind"), F.lit(a).alias("low"), F.lit(b).alias("high")) for z, v, t, a, b in VENUES))
    drawn = _base(spark, n, step_seconds).withColumn("v", F.when(r[0] < 0.7, F.get(venues, F.floor(r[1] * len(VENUES)).cast("int"))))
    drawn = drawn.withColumn("eventType", F.coalesce("v.kind", weighted(r[2], EVENT_TYPES))).withColumn("startTime", F.col("timestamp") + F.floor(r[3] * 48) * 3600000)
    crowd = F.floor(between(r[4], F.coalesce("v.low", F.lit(100)), F.coalesce("v.high", F.lit(5000)) + 1)).cast("int")
    hours = F.lit(4)
    for kind, h in HOURS.items():
        hours = F.when(F.col("eventType") == kind, h).otherwise(hours)
    end = F.col("startTime") + F.greatest(F.lit(1), F.floor(hours * between(r[5], 0.5, 1.5))) * 3600000
    return drawn.select("id", "timestamp", F.coalesce("v.zone", _zone(r[6])).alias("locationId"), "eventType", crowd.alias("attendanceEstimate"), "startTime", end.alias("endTime"), F.col("v.name").alias("venueName"))


def _broken(df: DataFrame, rate: float, kinds: dict, changes: dict[str, dict[str, Column]], seed: int) -> DataFrame:
    hit = F.when(draw(seed) < rate, weighted(draw(seed + 1), kinds))
    out = df.withColumn("fault", hit)
    columns: dict[str, Column] = {}
    for kind, new in changes.items():
        for column, value in new.items():
            columns[column] = F.when(F.col("fault") == kind, value).otherwise(columns.get(column, F.col(column)))
    return out.withColumns(columns)


def _bad_zone(seed: int) -> Column:
    return F.when(draw(seed) < 0.5, 0).otherwise(F.floor(draw(seed + 1) * 500) + 500).cast("int")


def with_trip_faults(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """``df`` with a ``rate`` of its rows broken, and ``fault``, the kind of each."""
    r, none = draw(seed + 10), F.lit(None)
    return _broken(
        df, rate, FAULTS,
        {
            "NULL_FARE": {"fareAmount": none.cast("double")}, "NULL_PASSENGERS": {"passengerCount": none.cast("int")}, "INVALID_PICKUP_ZONE": {"pickupLocationId": _bad_zone(seed + 11)},
            "INVALID_DROPOFF_ZONE": {"dropoffLocationId": _bad_zone(seed + 13)}, "NEGATIVE_DISTANCE": {"tripDistance": -F.abs("tripDistance")}, "ZERO_DISTANCE": {"tripDistance": F.lit(0.0)},
            "EXCESSIVE_DISTANCE": {"tripDistance": 200.5 + r * 300}, "NEGATIVE_FARE": {"fareAmount": -F.abs("fareAmount")}, "ZERO_PASSENGERS": {"passengerCount": F.lit(0)},
            "EXCESSIVE_PASSENGERS": {"passengerCount": (F.floor(r * 20) + 11).cast("int")},
        },
        seed,
    )


def with_weather_faults(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    r = draw(seed + 10)
    changes = {
        "EXTREME_COLD": {"temperature": -100 - r * 50}, "EXTREME_HEAT": {"temperature": 150 + r * 50}, "NEGATIVE_PRECIPITATION": {"precipitation": -r * 5},
        "NEGATIVE_WIND": {"windSpeed": -r * 50}, "WET_CLEAR_SKY": {"condition": F.lit("CLEAR"), "precipitation": 2 + r * 3},
    }
    return _broken(df, rate, dict.fromkeys(WEATHER_FAULTS, 1.0), changes, seed)


def with_event_faults(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    r = draw(seed + 10)
    changes = {
        "NEGATIVE_CROWD": {"attendanceEstimate": -F.floor(r * 10000).cast("int")}, "VAST_CROWD": {"attendanceEstimate": (F.floor(r * 900000) + 100001).cast("int")},
        "ENDS_FIRST": {"endTime": F.col("startTime") - 3600000}, "INVALID_ZONE": {"locationId": _bad_zone(seed + 11)},
    }
    return _broken(df, rate, dict.fromkeys(EVENT_FAULTS, 1.0), changes, seed)
