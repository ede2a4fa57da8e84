"""Numbers over a whole table: no task sees all rows, empty and skewed ranges count right."""

import random

import pytest
from millrace.operators import numbering, overlay, study, traffic
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges stay apart, empty ones too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbers(spark, values, order=("v", "w"), **more):
    frame = spark.createDataFrame(list(enumerate(values)), "w long, v long")
    return [(r["v"], r["w"], r["at"]) for r in numbering.numbered(frame, list(order), **more).orderBy("at").collect()]


@pytest.mark.parametrize("values", [[], [7], [5] * 300, [5] * 280 + list(range(20)), list(range(300)), [None, 3, None, 1]])
def test_numbers_follow_the_order(spark, values):
    values = random.Random(1).sample(values, len(values))
    want = sorted(((v, w) for w, v in enumerate(values)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbers(spark, values) == [(v, w, i) for i, (v, w) in enumerate(want)]
    assert [r[2] for r in numbers(spark, values, first=41)] == list(range(41, 41 + len(values)))


def test_rows_are_spread_and_no_window_takes_them_whole(spark):
    frame = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("node"))
    placed = numbering.numbered(frame, ["node"])
    assert placed.count() == 5000 and placed.agg(F.count_distinct("at"), F.min("at"), F.max("at")).first()[:] == (5000, 0, 4999)
    assert placed.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    rows = study.inserted(frame.withColumn("name", F.lit("x")), frame.select(F.col("node").cast("string").alias("name")), key="node")
    for made in (traffic.ring(frame), overlay.regular_edges(frame, 4), rows):
        windows = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
        assert all("sum(_rows" in line for line in windows)  # of counts, a row for each range


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_ring(spark, n):
    ids = [i * 37 % 101 for i in range(n)]
    got = {r["node"]: (r["successor"], r["predecessor"]) for r in traffic.ring(spark.createDataFrame([(i,) for i in ids], "node long")).collect()}
    s = sorted(ids)
    assert got == {x: (s[(i + 1) % n], s[i - 1]) for i, x in enumerate(s)}
