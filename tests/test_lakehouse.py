"""Band edges, the gate, dedup and the streaming jobs."""

import datetime as dt

import pytest
from millrace import rules as R
from millrace.functions.columns import band
from millrace.operators import gold, quality, silver
from millrace.schemas import TABLES, TRIP, set_up
from millrace.sources import generators, record_log
from millrace.streaming import jobs
from pyspark.sql import functions as F


@pytest.mark.parametrize("bands", [R.DISTANCE, R.FARE, R.TEMPERATURE, R.PRECIPITATION, R.WIND, R.ATTENDANCE, R.DURATION])
def test_band_edges(spark, bands):
    edges = [float(hi) for hi, _ in bands if hi is not None]
    values = [e + d for e in edges for d in (-0.01, 0.0, 0.01)] + [-1e9, 1e9, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", band(F.col("v"), bands).alias("label")).collect()
    for v, label in got:
        want = next((name for hi, name in bands if v is not None and hi is not None and v < hi), bands[-1][1])
        assert label == want


def bronze(spark, n=400, faults=0.0):
    made = generators.with_trip_faults(generators.trips(spark, n, seed=3, step_seconds=7), faults, seed=4)
    rows = made.withColumns({"kafka_key": F.lit("k"), "topic": F.lit("trips.yellow"), "partition": F.lit(0), "offset": F.col("id"), "kafka_timestamp": F.timestamp_millis("timestamp")})
    return rows.withColumns({"ingestion_timestamp": F.timestamp_millis("timestamp"), "ingestion_date": F.to_date(F.timestamp_millis("timestamp"))}).select(*TABLES["bronze.trips"].schema.fieldNames())


def test_generated_rows_pass_and_faults_are_caught(spark):
    clean = silver.trips(bronze(spark))
    assert clean.where(quality.row_failures(clean, quality.TRIPS).isNotNull()).isEmpty()
    assert quality.report(clean, quality.TRIPS).where("not passed").isEmpty()
    made = generators.with_trip_faults(generators.trips(spark, 2000, seed=3), 0.5, seed=4)
    rows = silver.trips(made.withColumns({"ingestion_timestamp": F.timestamp_millis("timestamp"), "offset": F.col("id"), "partition": F.lit(0)})).join(made.select(F.col("id").alias("bronze_offset"), "fault"), "bronze_offset")
    counted = rows.groupBy("fault").agg(F.count("*").alias("n"), F.count(quality.row_failures(rows, quality.TRIPS)).alias("caught")).collect()
    by = {r["fault"]: (r["n"], r["caught"]) for r in counted}
    assert set(by) == {None, *generators.FAULTS} and by[None][1] == 0 and all(n == c for f, (n, c) in by.items() if f)


def test_gate_by_batch_and_by_row(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, -1.0), (2, None)], "batch_id long, v double")
    checks = [*quality.complete("v"), *quality.within("v", 0.0, 5.0)]
    ok, bad = quality.gate(rows, checks)
    assert {r["batch_id"] for r in ok.collect()} == {0}
    assert {(r["batch_id"], r["failure_reason"]) for r in bad.collect()} == {(1, "min(v, 0)"), (2, "complete(v); min(v, 0); max(v, 5)")}
    ok, bad = quality.gate(rows, checks, mode="row")
    assert ok.count() == 3 and {r["failure_reason"] for r in bad.collect()} == {"min(v, 0)", "complete(v)"}
    assert quality.quarantine_name("lake.silver.trips_cleaned") == "lake.quarantine.trips_quarantined"


def test_dedup_keeps_the_first_whatever_the_order(spark):
    rows = silver.trips(bronze(spark, 50))
    twice = rows.unionByName(rows.withColumn("bronze_offset", F.col("bronze_offset") + 1000)).unionByName(rows.withColumn("bronze_offset", F.col("bronze_offset") - 1000))
    kept = silver.first_of_each(twice, silver.TRIP_KEYS)
    assert kept.count() == 50 and kept.agg(F.max("bronze_offset")).first()[0] < 0


def test_events_overlap(spark):
    base = int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1000)
    hour = 3600000
    data = [(base, 1, "OTHER", 5, base + 5 * hour, base + 12 * hour, " "), (base, 1, "SPORTS", 10001, base + 9 * hour, base + 10 * hour, "x"), (base, 1, "OTHER", 5, base + hour, base + hour, None)]
    frame = spark.createDataFrame(data, "timestamp long, locationId int, eventType string, attendanceEstimate int, startTime long, endTime long, venueName string")
    frame = frame.withColumns({"ingestion_timestamp": F.timestamp_millis("timestamp"), "offset": F.lit(1), "partition": F.lit(0)})
    hours, ends = silver.events(frame, true_overlap=True).collect(), silver.events(frame).collect()
    assert [r["overlaps_rush_hour"] for r in ends] == [False, True] and [r["overlaps_rush_hour"] for r in hours] == [True, True]
    assert [r["has_venue_details"] for r in ends] == [False, True] and [r["is_major_event"] for r in ends] == [False, True]


def test_streams_agree_with_batch(spark, tmp_path):
    root = str(tmp_path)
    rows = bronze(spark, 600).unionByName(bronze(spark, 600).where("offset % 10 = 0").withColumn("offset", F.col("offset") + 5000))
    far = rows.limit(1).withColumn("timestamp", F.col("timestamp") + 86400000)
    rows.coalesce(1).write.parquet(f"{root}/bronze/trips")
    far.withColumns({"ingestion_timestamp": F.timestamp_millis("timestamp")}).coalesce(1).write.mode("append").parquet(f"{root}/bronze/trips")
    jobs.run(spark, root, "trips-cleaned", once=True)
    done = spark.read.parquet(f"{root}/silver/trips_cleaned").select(TABLES["silver.trips_cleaned"].schema.fieldNames())
    assert done.count() == 601
    days = {r[0].isoformat()[:10] for r in spark.read.parquet(f"{root}/silver/trips_cleaned").select("timestamp_day").distinct().collect()}
    assert days == {"2024-01-01", "2024-01-02"}
    metrics = spark.read.parquet(f"{root}/monitoring/silver_quality_metrics")
    assert metrics.agg(F.sum("record_count"), F.min("passed_checks")).first()[:] == (601, 1)
    flat = f"{root}/flat"
    done.coalesce(1).write.parquet(f"{flat}/silver/trips_cleaned")
    jobs.run(spark, flat, "trip-metrics-live", once=True)
    jobs.run(spark, flat, "pipeline-latency", once=True)
    closed = spark.read.parquet(f"{flat}/gold/trip_metrics_live").drop("last_updated", "window_start_day")
    batch = gold.trip_metrics(done).where(F.col("window_end") < F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert sorted(map(repr, closed.collect())) == sorted(map(repr, batch.select(*closed.columns).collect()))
    assert spark.read.parquet(f"{flat}/monitoring/pipeline_latency_metrics").agg(F.sum("events_processed")).first()[0] == 600


def test_the_chain_bears_repeats_restarts_and_lost_metrics(spark, tmp_path):
    """Gold reads the folders that silver writes; a batch that runs again adds nothing, a restart goes on, and metrics that can't be written hold nothing up."""
    root = str(tmp_path)
    (tmp_path / "monitoring").write_text("a file where the metrics' folder should be")
    bronze(spark, 200).coalesce(1).write.parquet(f"{root}/bronze/trips")
    jobs.run(spark, root, "trips-cleaned", once=True)
    job = jobs.jobs()["trips-cleaned"]
    again = spark.read.parquet(f"{root}/silver/trips_cleaned").where("batch = 0").select(TABLES["silver.trips_cleaned"].schema.fieldNames())
    jobs.run(spark, root, "trip-metrics-live", once=True)
    jobs.gated_sink(spark, root, job)(again, 0)
    later = bronze(spark, 50).withColumns({"timestamp": F.col("timestamp") + 86400000, "offset": F.col("offset") + 9000})
    later.withColumn("ingestion_timestamp", F.timestamp_millis("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/bronze/trips")
    jobs.run(spark, root, "trips-cleaned", once=True)
    jobs.run(spark, root, "trip-metrics-live", once=True)
    done = spark.read.parquet(f"{root}/silver/trips_cleaned")
    assert done.count() == 250 and done.agg(F.count_distinct("batch")).first()[0] >= 2
    closed = spark.read.parquet(f"{root}/gold/trip_metrics_live")
    assert closed.where(F.col("window_end") < F.lit("2024-01-01 23:00:00").cast("timestamp")).agg(F.sum("trip_count")).first()[0] == 200
    jobs.load_dimensions(spark, root, "2024-01-01", "2024-01-03")
    assert spark.read.parquet(f"{root}/gold/time_dim").count() == 48
    zones = {r[0] for r in done.selectExpr("explode(array(pickup_location_id, dropoff_location_id))").collect()}
    assert {r["location_id"] for r in spark.read.parquet(f"{root}/gold/location_dim").collect()} == zones


def test_gold_and_latency_tables_hold_what_their_jobs_make(spark):
    rows = silver.trips(bronze(spark, 30))
    made = {
        "gold.trip_metrics_live": gold.trip_metrics(rows).withColumn("last_updated", F.current_timestamp()), "gold.location_dim": gold.location_dimension(rows),
        "gold.time_dim": gold.time_dimension(spark, "2024-01-01", "2024-01-02"), "monitoring.pipeline_latency_metrics": gold.latency(rows, F.current_timestamp()),
    }
    assert set_up(spark, "gold") == ["gold.location_dim", "gold.time_dim", "gold.trip_metrics_live"]
    for name, frame in made.items():
        assert {(f.name, f.dataType) for f in TABLES[name].schema} == {(f.name, f.dataType) for f in frame.schema}, name
    for name in list(made)[:3]:
        spark.sql(f"DROP TABLE {name}")


def test_gate_by_join_is_the_gate_by_broadcast(spark, monkeypatch):
    rows = quality.with_batch(silver.trips(bronze(spark, 400, faults=0.01)), 40)
    halves = [sorted(map(repr, part.collect())) for part in quality.gate(rows, quality.TRIPS)]
    monkeypatch.setattr(quality, "MOST_VERDICTS", 0)
    assert halves == [sorted(map(repr, part.collect())) for part in quality.gate(rows, quality.TRIPS)] and all(halves)


def test_a_bad_batch_goes_to_quarantine_whole(spark, tmp_path):
    root = str(tmp_path)
    bronze(spark, 300, faults=0.1).coalesce(1).write.parquet(f"{root}/bronze/trips")
    jobs.run(spark, root, "trips-cleaned", once=True)
    bad = spark.read.parquet(f"{root}/quarantine/trips_quarantined")
    assert bad.count() == 300 and {"quarantine_timestamp", "batch_id_quarantine", "failure_reason", "validation_status"} <= set(bad.columns)
    assert spark.read.schema(TABLES["silver.trips_cleaned"].schema).parquet(f"{root}/silver/trips_cleaned").isEmpty()


def test_bronze_stream_decodes_records(spark, tmp_path):
    root = str(tmp_path)
    raw = generators.trips(spark, 20, seed=1)
    record_log.append_log(spark, record_log.records_of(raw.drop("id"), F.col("pickupLocationId"), "trips.yellow"), f"{root}/records/trips")
    jobs.run(spark, root, "trips", once=True)
    got = spark.read.parquet(f"{root}/bronze/trips")
    assert sorted(got.select(*TRIP.fieldNames()).collect()) == sorted(raw.select(*TRIP.fieldNames()).collect())


def test_tables_are_created_empty(spark):
    made = set_up(spark, "silver")
    assert made == ["silver.events_cleaned", "silver.trips_cleaned", "silver.weather_cleaned"]
    assert spark.table("silver.trips_cleaned").isEmpty() and spark.catalog.tableExists("silver.trips_cleaned")
    for t in made:
        spark.sql(f"DROP TABLE {t}")


def test_stored_tables(spark, tmp_path):
    from millrace.sources import tables

    path = str(tmp_path / "q")
    rows = silver.trips(bronze(spark, 30))
    tables.write_batch(rows, path, 1)
    tables.write_batch(rows, path, 1)
    tables.write_batch(rows.withColumn("failure_reason", F.lit("x")), path, 2)
    found = tables.read_evolving(spark, path)
    assert found.count() == 60 and found.where("failure_reason is null").count() == 30
    tables.write_partitioned(rows, str(tmp_path / "p"), "silver.trips_cleaned")
    assert spark.read.parquet(str(tmp_path / "p")).select("timestamp_day").distinct().count() == 1
    tables.write_records(generators.trips(spark, 20, seed=1).drop("id"), F.col("pickupLocationId"), "trips.yellow", str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 20
    with pytest.raises(ValueError):
        tables.require_tables(spark, ["silver.nowhere"])
    assert tables.first_records(rows).count() == 10
