"""Files as inputs: record streams, whole texts and binary parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import opened

CHUNK, SLICE = 65536, 8192  # bytes


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 10, form: str = "parquet") -> DataFrame:
    """A stream over files that arrive in a folder, a bounded number of them for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def decoded(records: DataFrame, payload: T.StructType, as_of: Column | None = None) -> DataFrame:
    """Broker records ``(key, value, topic, partition, offset, timestamp)`` to bronze rows; values are JSON of ``payload``."""
    now = F.current_timestamp() if as_of is None else as_of
    return records.select(
        F.col("key").cast("string").alias("kafka_key"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
        F.from_json(F.col("value").cast("string"), payload).alias("v"),
    ).select("kafka_key", "topic", "partition", "offset", "kafka_timestamp", "v.*", now.alias("ingestion_timestamp"), F.to_date(now).alias("ingestion_date"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)``, a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """``files(file, content)`` to ``(file, chunk, data)``, chunks from 1; the last may be short, an empty file has none. For contents that are in rows already."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    each = files.where(n > 0).select("file", "content", F.explode(F.sequence(F.lit(1), n)).alias("chunk"))
    return each.select("file", "chunk", F.substring("content", (F.col("chunk") - 1) * size + 1, F.lit(size)).alias("data"))


STRETCH = 64 << 20  # bytes of a file that one task reads
HELD = 4 << 20  # bytes of chunks that are in memory together


def stretches(spark: SparkSession, path: str, size: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """``(file, first, length)``: the files under ``path`` in stretches of whole chunks; contents aren't read for that."""
    step = max(1, stretch // size) * size
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    each = listed.select("file", F.col("length").alias("whole"), F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("first"))
    return each.select("file", "first", F.least(F.col("whole") - F.col("first"), F.lit(step)).alias("length"))


def ranged_chunks(spark: SparkSession, path: str, size: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """``(file, chunk, data)`` of the files under ``path``: each task reads its stretches of bytes, a few megabytes at a time.

    A file of any size is read by many tasks, and none holds it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = opened(row["file"])
                with fs.open_input_file(at) as f:
                    f.seek(row["first"])
                    done = 0
                    while done < row["length"]:
                        held, number = [], (row["first"] + done) // size + 1
                        while done < row["length"] and sum(map(len, held)) < HELD:
                            held.append(f.read(min(size, row["length"] - done)))
                            if not held[-1]:
                                raise OSError(f"{row['file']} is shorter than it was when it was listed")
                            done += len(held[-1])
                        yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(held)), pa.array(range(number, number + len(held)), pa.int64()), pa.array(held, pa.binary())], ["file", "chunk", "data"])

    ranges = stretches(spark, path, size, stretch)
    n = ranges.count()
    return ranges.repartition(max(1, n), "file", "first").mapInArrow(read, "file string, chunk long, data binary")
