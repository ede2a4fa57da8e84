"""Rounds over tables: each costs what its rows cost, however many came before."""

from millrace.operators import overlay
from pyspark.sql import functions as F


def test_rounds_do_not_grow_plans(spark):
    """What a round hands on has no ordering of its plan: those of checkpoints doubled from round to round."""
    jump = overlay.kept(spark.range(3000).select("id", (F.col("id") + 1).alias("to")))
    with_merge = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("on"))
            jump = overlay.kept(jump.join(ahead, "to").select("id", F.col("on").alias("to")))
            assert jump._jdf.queryExecution().optimizedPlan().outputOrdering().isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_merge)
    assert jump.count() == 2997
