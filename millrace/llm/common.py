"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where all tasks run in the driver's process a local one is made if none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A lost executor then costs a re-read, and values that depend on the order
    of a scan (row numbers given by ``monotonically_increasing_id``) stay fixed.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """A key for each row; callers must ``cut`` before they use it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def broadcast_if_small(df: DataFrame, row_bytes: int, most_bytes: int = 8 << 20) -> DataFrame:
    """``df``, which has been cut, marked for broadcast if it was counted to be small; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def spread(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` of ``rows`` rows, dealt out evenly to a task for each ``each`` rows, but at least as many as there are cores: for maps that make many rows of one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // each)))


def text_key(column: str = "text") -> Column:
    """With doc_id, the name of a row whose id may repeat with another text."""
    return F.xxhash64(F.col(column))


def keep_rows(docs: DataFrame, known: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``firsts(doc_id, h)`` names, each once; rows without a doc_id all stay.

    ``known(doc_id, h)`` has a row for each row of ``docs`` with an id, h its
    ``text_key``.  What goes is joined, not what stays, and of rows that repeat
    only those that do are dealt out, so most texts aren't shuffled.
    """
    mark = fresh("_mark", docs)
    counted = known.groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    judged = cut(counted.join(firsts.withColumn("stays", F.lit(True)), ["doc_id", "h"], "left").where("stays is null or rows > 1"))
    gone = judged.where("stays is null").select("doc_id", F.col("h").alias(mark))
    again = judged.where("stays").select("doc_id", F.col("h").alias(mark))
    named = docs.where("doc_id is not null").withColumn(mark, text_key())
    out = named.join(broadcast_if_small(gone, 24), ["doc_id", mark], "left_anti")
    if not again.isEmpty():
        again = broadcast_if_small(again, 24)
        out = out.join(again, ["doc_id", mark], "left_anti").unionByName(out.join(again, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]))
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
