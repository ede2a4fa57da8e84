"""The log of records: limits by offsets, restarts, ranges, lost files."""

import json
import os

import pytest
from millrace.sources import record_log as rl
from pyspark.sql import functions as F


def records(spark, n, base=0, keys=37):
    rows = spark.range(base, base + n)
    return rows.select((F.col("id") % keys).cast("string").cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.lit("t").alias("topic"), F.timestamp_millis("id").alias("timestamp"))


def drained(spark, root, most, **options):
    reader = spark.readStream.format("record_log").options(maxOffsetsPerTrigger=most, positions=f"{root}/positions", **options)
    query = reader.load(f"{root}/log").writeStream.option("checkpointLocation", f"{root}/checkpoint").format("parquet").start(f"{root}/out")
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


@pytest.fixture
def registered(spark):
    spark.dataSource.register(rl.RecordLog)


def test_batches_keep_to_the_limit_and_restarts_read_nothing_twice(spark, tmp_path, registered):
    root = str(tmp_path)
    for n, base in ((6000, 0), (3, 6000), (700, 6003)):  # files of uneven size
        rl.append_log(spark, records(spark, n, base), f"{root}/log")
    assert drained(spark, root, 2500) == [2500, 2500, 1703]
    rl.append_log(spark, records(spark, 2600, 6703), f"{root}/log")
    assert drained(spark, root, 2500) == [2500, 100]
    assert drained(spark, root, 2500) == []
    out = spark.read.parquet(f"{root}/out")
    assert out.agg(F.count("*"), F.count_distinct("partition", "offset"), F.count_distinct("value")).first()[:] == (9303, 9303, 9303)
    # a partition's records are in order of time, whatever append they came with
    ends = rl.latest(rl.Log(f"{root}/log").segments())
    assert sum(ends.values()) == 9303 and len(ends) == 4


def test_a_batch_that_failed_is_read_again(spark, tmp_path, registered):
    root = str(tmp_path)
    rl.append_log(spark, records(spark, 900), f"{root}/log")
    seen, fail = [], [True]

    def write(batch, batch_id):
        rows = [r["offset"] * 10 + r["partition"] for r in batch.collect()]
        if batch_id == 1 and fail.pop() if fail else False:
            raise RuntimeError("lost")
        seen.append((batch_id, sorted(rows)))

    def go():
        reader = spark.readStream.format("record_log").options(maxOffsetsPerTrigger=400, positions=f"{root}/positions")
        query = reader.load(f"{root}/log").writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception):
        go()
    go()
    assert [b for b, _ in seen] == [0, 1, 2] and len({x for _, rows in seen for x in rows}) == sum(len(rows) for _, rows in seen) == 900


def test_ranges_and_first_records(spark, tmp_path):
    root = f"{tmp_path}/log"
    assert rl.log_range(spark, root).isEmpty()
    rl.append_log(spark, records(spark, 1000), root, partitions=3, by=F.col("value").cast("string").cast("int"))
    ends = {"0": 334, "1": 333, "2": 333}
    assert rl.latest(rl.Log(root).segments()) == ends
    got = rl.log_range(spark, root, json.dumps({"0": 100, "1": 333}), json.dumps({"0": 250, "1": 333, "2": 5})).collect()
    assert sorted((r["partition"], r["offset"]) for r in got) == [(0, i) for i in range(100, 250)] + [(2, i) for i in range(5)]
    assert {int(r["value"]) % 3 for r in got if r["partition"] == 0} == {0}
    assert rl.log_range(spark, root, rows=10).count() == 10 and rl.log_range(spark, root, "latest").isEmpty()


def test_lost_records(spark, tmp_path, registered):
    root = str(tmp_path)
    for base in (0, 100):
        rl.append_log(spark, records(spark, 100, base, keys=1), f"{root}/log", partitions=1)
    first = rl.Log(f"{root}/log").segments()["0"][0]
    os.remove(first.path)
    with pytest.raises(Exception, match="were to be read"):
        rl.log_range(spark, f"{root}/log", '{"0": 0}').count()
    reader = spark.read.format("record_log").option("startingOffsets", '{"0": 0}').option("failOnDataLoss", "false")
    assert reader.load(f"{root}/log").count() == 200 - first.next
    with pytest.raises(Exception, match="positions"):
        spark.read.format("record_log").option("maxOffsetsPerTrigger", 5).load(f"{root}/log").count()


def test_shares_of_a_limit():
    assert rl.limited({"0": 0, "1": 0}, {"0": 10, "1": 30}, 8) == {"0": 2, "1": 6}
    assert sum(rl.limited({"0": 5, "1": 0, "2": 1}, {"0": 12, "1": 7, "2": 8}, 10).values()) == 16
    assert rl.limited({"0": 5}, {"0": 4}, 10) == {"0": 5}
    assert sum(rl.limited({str(i): 0 for i in range(40)}, {str(i): 1 for i in range(40)}, 3).values()) == 3
