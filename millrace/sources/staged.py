"""Batches that appear in a table whole: written aside, then renamed into place; and merged later for readers.

A table is a folder of ``batch=<id>`` folders, each partitioned by time as the
table is declared.  Streams that read it see every batch's files once, under
names that never change.  Merged files lie beside the table, where streams don't
look.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES

ASIDE = "_staging"  # readers and streams pass over names that begin so


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Put a written folder in its place by one rename; whoever reads sees all of it or nothing."""
    fs, source = _path(spark, staged)
    _, at = _path(spark, target)
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        raise FileExistsError(target)
    if not fs.rename(source, at):
        raise OSError(f"{staged} could not be renamed to {target}")


def stage(df: DataFrame, root: str, table: str, batch_id: int) -> str:
    """Write rows beside the table, in its declared layout; what an earlier try left there is replaced."""
    spec = TABLES[table]
    path = f"{root}/{table.replace('.', '/')}/{ASIDE}/batch={batch_id}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(spec.partition_column) if spec.partition_column else writer).parquet(path)
    return path


def batch_path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table.replace('.', '/')}/batch={batch_id}"


def batches(spark: SparkSession, root: str, table: str) -> list[int]:
    return sorted(int(m[1]) for name in folders(spark, f"{root}/{table.replace('.', '/')}") if (m := re.fullmatch(r"batch=(\d+)", name)))


def _merged(spark: SparkSession, root: str, table: str) -> list[tuple[int, int]]:
    found = (re.fullmatch(r"batches=(\d+)-(\d+)", name) for name in folders(spark, f"{root}/merged/{table.replace('.', '/')}"))
    return sorted((int(m[1]), int(m[2])) for m in found if m)


def merge_batches(spark: SparkSession, root: str, table: str, upto: int) -> tuple[int, int] | None:
    """Rewrite batches up to ``upto`` that aren't merged yet as one file for each time partition; the range merged, or None.

    The batches stay for streams that are still behind; readers take the merged
    files in their place.
    """
    done = _merged(spark, root, table)
    after = done[-1][1] if done else -1
    new = [b for b in batches(spark, root, table) if after < b <= upto]
    if not new:
        return None
    spec, (low, high) = TABLES[table], (new[0], new[-1])
    rows = spark.read.option("basePath", f"{root}/{table.replace('.', '/')}").parquet(*(batch_path(root, table, b) for b in new))
    staged = f"{root}/merged/{table.replace('.', '/')}/{ASIDE}/batches={low}-{high}"
    spec.laid_out(rows.select(spec.schema.fieldNames())).write.mode("overwrite").option("compression", "zstd").partitionBy(spec.partition_column).parquet(staged)
    publish(spark, staged, f"{root}/merged/{table.replace('.', '/')}/batches={low}-{high}")
    return low, high


def drop_merged(spark: SparkSession, root: str, table: str, upto: int) -> list[int]:
    """Remove merged batches up to ``upto``, which every stream has to have read."""
    done = _merged(spark, root, table)
    old = [b for b in batches(spark, root, table) if done and b <= min(upto, done[-1][1])]
    for b in old:
        remove(spark, batch_path(root, table, b))
    return old


def read_table(spark: SparkSession, root: str, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The table's rows, merged where they are; of times from ``start`` up to ``end`` if given, and then only those partitions."""
    spec, base = TABLES[table], f"{root}/{table.replace('.', '/')}"
    done = _merged(spark, root, table)
    live = [b for b in batches(spark, root, table) if not done or b > done[-1][1]]
    parts = []
    if done:
        parts.append(spark.read.option("basePath", f"{root}/merged/{table.replace('.', '/')}").parquet(*(f"{root}/merged/{table.replace('.', '/')}/batches={a}-{b}" for a, b in done)))
    if live:
        parts.append(spark.read.option("basePath", base).parquet(*(batch_path(root, table, b) for b in live)))
    if not parts:
        return spark.createDataFrame([], spec.schema)

    def within(df: DataFrame) -> DataFrame:
        for bound, low in ((start, True), (end, False)):
            if bound is not None and spec.time:
                at, by = F.lit(bound).cast("timestamp"), F.col(spec.partition_column).cast("timestamp")
                df = df.where((F.col(spec.time) >= at) & (by >= F.date_trunc(spec.unit, at))) if low else df.where((F.col(spec.time) < at) & (by <= F.date_trunc(spec.unit, at)))
        return df.select(spec.schema.fieldNames())

    out = within(parts[0])
    return out if len(parts) == 1 else out.unionByName(within(parts[1]))
