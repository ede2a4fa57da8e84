"""Thresholds and streams from settings; rows and views of declared tables."""

import pytest
from millrace import rules as R
from millrace.schemas import TABLES
from millrace.sources import generators, tables


def test_thresholds_from_texts():
    made = R.with_settings({"weather.severe_wind": "25", "rush.morning": "6, 10", "events.major_types": "SPORTS", "rows_in_batch": "5"})
    assert made.weather.severe_wind == 25.0 and made.rush.morning == (6, 10) and made.events.major_types == ("SPORTS",) and made.rows_in_batch == 5
    assert made.weather.extreme_cold == R.RULES.weather.extreme_cold and R.with_settings({}) == R.RULES
    everything = {k: ",".join(map(str, v)) if isinstance(v, tuple) else str(v) for k, v in R.settings_of().items()}
    assert R.with_settings(everything) == R.RULES and R.unset(everything) == []
    assert "weather.severe_wind" in R.unset({"rows_in_batch": "5"})


@pytest.mark.parametrize("given", [{"weather.sever_wind": "25"}, {"weather.severe_wind": "high"}, {"rush.morning": "6"}])
def test_wrong_thresholds_raise(given):
    with pytest.raises(ValueError):
        R.with_settings(given)


def test_streams_from_settings():
    usual = generators.stream_settings({})
    assert usual == generators.STREAMS
    made = generators.stream_settings({"TRIP_RATE": "0", "EVENT_ERROR_RATE": "0.5", "WEATHER_TOTAL_EVENTS": "7", "TRIP_TOPIC": "t", "PATH": "/bin"})
    assert made["TRIP"].rate == 0 and made["TRIP"].topic == "t" and made["EVENT"].faults == 0.5 and made["WEATHER"].total == 7 and made["TRIP"].total is None
    with pytest.raises(ValueError, match="TRIP: rate.*EVENT: share"):
        generators.stream_settings({"TRIP_RATE": "-1", "EVENT_ERROR_RATE": "1.5"})
    for given in ({"TRIP_TOTAL_EVENTS": "0"}, {"TRIP_RATE": "many"}, {f"{p}_RATE": "0" for p in generators.STREAMS}):
        with pytest.raises(ValueError):
            generators.stream_settings(given)


def test_shares_of_generated_values(spark):
    n = 20_000
    for made, column, shares in (
        (generators.trips(spark, n), "passengerCount", generators.PASSENGERS),
        (generators.weather(spark, n), "condition", generators.CONDITIONS),
        (generators.with_trip_faults(generators.trips(spark, n), 1.0), "fault", generators.FAULTS),
        (generators.with_weather_faults(generators.weather(spark, n), 1.0), "fault", dict.fromkeys(generators.WEATHER_FAULTS, 0.2)),
        (generators.with_event_faults(generators.special_events(spark, n), 1.0), "fault", dict.fromkeys(generators.EVENT_FAULTS, 0.25)),
    ):
        found = {r[0]: r["count"] / n for r in made.groupBy(column).count().collect()}
        assert found.keys() == shares.keys() and all(abs(found[k] - shares[k]) < 0.015 for k in shares)


def test_rows_of_an_older_layout(spark):
    old = spark.createDataFrame([(1, "Zone_1", "x")], "location_id int, zone_name string, gone string")
    now = tables.conformed(old, "gold.location_dim")
    assert [(f.name, f.dataType) for f in now.schema] == [(f.name, f.dataType) for f in TABLES["gold.location_dim"].schema]
    assert now.collect() == [(1, "Zone_1", None, None)]


def test_views_of_frames_and_streams(spark, tmp_path):
    assert tables.as_view(spark.range(3), "silver.some_rows") == "silver_some_rows"
    assert spark.sql("SELECT sum(id) AS s FROM silver_some_rows").first()["s"] == 3
    spark.range(4).write.parquet(f"{tmp_path}/in")
    name = tables.as_view(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "bronze.rows")
    query = spark.sql(f"SELECT id * 2 AS twice FROM {name}").writeStream.format("memory").queryName("twice_seen").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted(r[0] for r in spark.table("twice_seen").collect()) == [0, 2, 4, 6]
