"""Reading and writing stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


def require_tables(spark: SparkSession, names: list[str]) -> None:
    lost = missing_tables(spark, names)
    if lost:
        raise ValueError(f"tables that a job reads are missing: {', '.join(lost)}")


def as_view(df: DataFrame, table: str) -> str:
    """Bind a frame, a stream too, to a view that SQL can read; its name is the table's with underscores for dots."""
    name = table.replace(".", "_")
    df.createOrReplaceTempView(name)
    return name


def conformed(df: DataFrame, table: str) -> DataFrame:
    """Rows of an older layout as the table is declared now: added columns are null, others cast, further ones left out."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].schema))


def first_records(records: DataFrame, n: int = 10) -> DataFrame:
    """A few records, to look at what a topic holds. Nothing is made from them: schemas are declared."""
    return records.limit(n)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch; writing the same batch again replaces it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, table: str) -> None:
    """Append in the layout of a declared table: one task, and so one file, for each partition value and write."""
    spec = TABLES[table]
    writer = spec.laid_out(df).write.mode("append").option("compression", "zstd")
    (writer.partitionBy(spec.partition_column) if spec.partition_column else writer).parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may lack columns that later ones have; those are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_records(events: DataFrame, key: Column, topic: str, path: str) -> None:
    """Events as broker records with JSON values, those of a key in order in one file."""
    columns = events.columns
    records = events.select(key.cast("string").cast("binary").alias("key"), F.to_json(F.struct(*columns)).cast("binary").alias("value"), F.lit(topic).alias("topic"), F.timestamp_millis("timestamp").alias("timestamp"))
    records.repartition("key").sortWithinPartitions("key", "timestamp").write.mode("append").parquet(path)
