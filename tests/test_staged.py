"""Batches published whole, in the declared layout, and merged for readers."""

import pytest
from millrace.operators import quality, silver
from millrace.schemas import TABLES
from millrace.sources import staged
from millrace.streaming import jobs
from pyspark.sql import functions as F

from .test_lakehouse import bronze

TABLE = "silver.trips_cleaned"


def rows(spark, n, day=0, faults=0.0):
    made = silver.trips(bronze(spark, n, faults))
    return made.withColumn("timestamp", (F.col("timestamp").cast("long") + day * 86400).cast("timestamp"))


def sink(spark, root):
    return jobs.gated_sink(spark, root, jobs.jobs()["trips-cleaned"])


def test_a_crash_before_publishing_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(jobs, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sink(spark, root)(rows(spark, 50), 0)
    assert staged.batches(spark, root, TABLE) == [] and staged.read_table(spark, root, TABLE).isEmpty()
    monkeypatch.undo()
    sink(spark, root)(rows(spark, 50), 0)
    sink(spark, root)(rows(spark, 70), 0)  # a repeat of what is there changes nothing
    assert staged.read_table(spark, root, TABLE).count() == 50
    assert spark.read.parquet(f"{root}/monitoring/silver_quality_metrics").count() == 1
    assert staged.folders(spark, f"{root}/silver/trips_cleaned/_staging") == []


def test_failing_and_empty_batches_reach_no_target(spark, tmp_path):
    root = str(tmp_path)
    sink(spark, root)(rows(spark, 80, faults=0.3), 3)
    sink(spark, root)(rows(spark, 80, faults=0.3), 3)
    sink(spark, root)(rows(spark, 5).limit(0), 4)
    assert staged.batches(spark, root, TABLE) == [] and staged.folders(spark, f"{root}/silver/trips_cleaned/_staging") == []
    bad = spark.read.parquet(f"{root}/quarantine/trips_quarantined")
    assert bad.count() == 80 and bad.select("batch_id_quarantine", "validation_status").distinct().collect() == [(3, "FAILED")]
    assert bad.first()["failure_reason"] == quality.verdicts(rows(spark, 80, faults=0.3).withColumn("batch_id", F.lit(3)), quality.TRIPS).first()["failures"]


def test_a_batch_is_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    frame = rows(spark, 60).repartition(3)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    sink(spark, str(tmp_path))(frame.mapInArrow(counted, frame.schema), 0)
    assert calls.value == 60 and staged.read_table(spark, str(tmp_path), TABLE).count() == 60


def test_observed_metrics_judge_as_aggregates_do(spark):
    from pyspark.sql import Observation

    for faults in (0.0, 0.2):
        frame = rows(spark, 90, faults=faults).withColumn("batch_id", F.lit(1))
        seen = Observation()
        frame.observe(seen, *quality.observed(quality.TRIPS)).write.format("noop").mode("overwrite").save()
        want = quality.verdicts(frame, quality.TRIPS).first()
        assert quality.judged(seen.get, quality.TRIPS) == (want["record_count"], want["passed"], want["failures"])


def test_days_are_pruned_and_merged_files_take_the_place_of_batches(spark, tmp_path):
    root = str(tmp_path)
    for b in range(4):
        sink(spark, root)(rows(spark, 20, day=b % 2), b)
    whole = sorted(map(repr, staged.read_table(spark, root, TABLE).collect()))
    day = staged.read_table(spark, root, TABLE, "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(timestamp_day" in plan and day.count() == 40
    assert staged.merge_batches(spark, root, TABLE, 2) == (0, 2) and staged.merge_batches(spark, root, TABLE, 2) is None
    assert sorted(map(repr, staged.read_table(spark, root, TABLE).collect())) == whole
    assert len(list((tmp_path / "merged/silver/trips_cleaned/batches=0-2").glob("*/*.parquet"))) == 2  # a file for each day
    sink(spark, root)(rows(spark, 10, day=5), 4)
    assert staged.merge_batches(spark, root, TABLE, 9) == (3, 4) and staged.drop_merged(spark, root, TABLE, 1) == [0, 1]
    assert staged.read_table(spark, root, TABLE).count() == 90 and staged.batches(spark, root, TABLE) == [2, 3, 4]
    assert staged.read_table(spark, root, TABLE, "2024-01-06").count() == 10


def test_streams_see_each_batch_once_whatever_is_merged(spark, tmp_path):
    root = str(tmp_path)
    sink(spark, root)(rows(spark, 30), 0)
    jobs.run(spark, root, "trip-metrics-live", once=True)
    sink(spark, root)(rows(spark, 30, day=1), 1)
    staged.merge_batches(spark, root, TABLE, 1)
    sink(spark, root)(rows(spark, 1, day=2), 2)
    jobs.run(spark, root, "trip-metrics-live", once=True)
    made = spark.read.parquet(f"{root}/gold/trip_metrics_live")
    assert made.agg(F.sum("trip_count")).first()[0] == 60 and {f.name for f in TABLES["gold.trip_metrics_live"].schema} < set(made.columns)
    assert {r[0].isoformat()[:10] for r in made.select("window_start_day").distinct().collect()} == {"2024-01-01", "2024-01-02"}


def test_every_command_has_one_entry(spark, tmp_path):
    root = str(tmp_path)
    sink(spark, root)(rows(spark, 12), 0)
    jobs.run(spark, root, "load-location-dim")
    jobs.run(spark, root, "load-time-dim", start_at="2024-01-01", end_at="2024-01-02")
    assert spark.read.parquet(f"{root}/gold/time_dim").count() == 24 and not spark.read.parquet(f"{root}/gold/location_dim").isEmpty()
    jobs.run(spark, root, "set-up-monitoring")
    assert spark.catalog.tableExists("monitoring.pipeline_latency_metrics")
    for t in ("pipeline_latency_metrics", "silver_quality_metrics"):
        spark.sql(f"DROP TABLE monitoring.{t}")
    assert {"trips", "weather", "events", "trips-cleaned", "pipeline-latency", "set-up-all"} <= set(jobs.commands())
    with pytest.raises(ValueError, match="is none of"):
        jobs.run(spark, root, "trip")
