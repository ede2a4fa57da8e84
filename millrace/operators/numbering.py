"""Numbers in order over a whole table, without bringing it into one task.

Rows are dealt into ranges of the order and sorted there.  Ranges are counted;
what lies in the ranges before is added to each row's place in its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

_IN_RANGE = 33  # lower bits of monotonically_increasing_id: the row's place in its partition


def numbered(df: DataFrame, order: list[str], name: str = "at", first: int = 0) -> DataFrame:
    """``df`` with numbers from ``first`` on, in ascending order of ``order``, nulls first.

    Rows that agree in ``order`` are numbered in any order and lie in one
    range; name columns that tell them apart.  The one table that is windowed
    whole has a row for each range.
    """
    if not df.columns:
        raise ValueError("a table without columns has no order")
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright("_id", _IN_RANGE).alias("_range")).agg(F.count("*").alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    placed = ranged.withColumn("_range", F.shiftright("_id", _IN_RANGE)).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << _IN_RANGE) - 1) + first).drop("_id", "_range", "_before")


def running(df: DataFrame, order: str, name: str, fold: Callable[[Column | str], Column], value: Column) -> DataFrame:
    """``df`` with ``fold`` (``F.sum``, ``F.max``) of ``value`` over all rows up to each, in ascending order of the distinct numbers ``order``.

    Each range folds its own rows and adds what the ranges before make in all.
    """
    ranged = kept(df.withColumn("_value", value).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(fold("_value").alias("_total"))
    before = totals.select("_range", fold("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = fold("_value").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    folded = ranged.withColumn("_own", own).join(F.broadcast(before), "_range")
    both = F.col("_own") + F.coalesce("_before", F.lit(0)) if fold is F.sum else F.greatest("_own", "_before")
    return folded.withColumn(name, both).drop("_value", "_range", "_own", "_before")


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """``(key, successor, predecessor)`` of each row in the order of distinct keys, around the end: numbers one apart are joined."""
    placed = kept(numbered(df.select(key), [key]))
    n = placed.count()
    if n == 0:
        return placed.select(key, F.col(key).alias("successor"), F.col(key).alias("predecessor"))
    after = placed.select(F.col(key).alias("successor"), F.pmod(F.col("at") - 1, F.lit(n)).alias("at"))
    before = placed.select(F.col(key).alias("predecessor"), F.pmod(F.col("at") + 1, F.lit(n)).alias("at"))
    return placed.join(after, "at").join(before, "at").select(key, "successor", "predecessor")
