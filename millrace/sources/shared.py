"""Results written to the folder that driver and executors share, to go on from."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path or URI of Spark's is on, and the path there; for tasks, which have no session."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?&=%"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where all tasks run in the driver's process a local one is made if none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: what is lost is read again, not computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, of which later steps read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a ``stored`` whose tables are deleted in the end; what is returned must not read them any more."""
    top = f"{shared_dir(spark)}/passing-{uuid.uuid4().hex}"

    def put(df: DataFrame) -> DataFrame:
        df.write.parquet(path := f"{top}/{uuid.uuid4().hex}")
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(top)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
