"""A log of records in files, read as a stream or in ranges, by offset.

A log is a folder with ``partition=<p>/`` folders of parquet files.  Records of
a partition have offsets that go up; a file holds a stretch of them, and its
footer says which.  Files never change once they are there.

    spark.dataSource.register(RecordLog)
    spark.readStream.format("record_log").option("maxOffsetsPerTrigger", 2500).option("positions", ...).load(path)
    spark.read.format("record_log").option("startingOffsets", '{"0": 100}').option("endingOffsets", '{"0": 250}').load(path)

Options: ``startingOffsets`` and ``endingOffsets`` are ``earliest``, ``latest``
or JSON of offsets by partition (a partition not named there is read from its
beginning, or to its end); ``rows`` ends a batch read after so many records;
``maxOffsetsPerTrigger`` bounds a stream's batch, shared out by how far each
partition lags; ``failOnDataLoss`` (true) raises where records that were to be
read are gone.  ``positions`` is a folder of the stream's own, and needed with
a limit: Spark doesn't tell a source where the last batch ended, so the reader
notes it there as soon as a batch is planned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.numbering import numbered
from .shared import kept, opened

SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
_ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))])
Offsets = dict[str, int]  # by partition, of the next record


class DataLoss(RuntimeError):
    """Records that a reader was to go on from are no longer there."""


@dataclass(frozen=True)
class Segment:
    """A file: records of a partition from ``first`` up to ``next``."""

    partition: str
    first: int
    next: int
    path: str


class Stretch(InputPartition):
    """Offsets ``start`` up to ``end`` of one file."""

    def __init__(self, segment: Segment, start: int, end: int):
        self.partition, self.path, self.start, self.end = segment.partition, segment.path, start, end


class Log:
    """What lies in the folder; each footer is read once."""

    def __init__(self, root: str):
        self.root = root
        self.known: dict[str, Segment | None] = {}

    def open(self) -> tuple[pa.fs.FileSystem, str]:
        return opened(self.root)

    def segments(self) -> dict[str, list[Segment]]:
        """Files by partition, in order."""
        fs, root = self.open()
        found: dict[str, list[Segment]] = {}
        for info in fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True)):
            inner = info.path[len(root) :].strip("/").split("/")
            if info.type != pa.fs.FileType.File or not inner[-1].endswith(".parquet") or any(x[0] in "_." for x in inner) or not inner[0].startswith("partition="):
                continue
            if info.path not in self.known:
                self.known[info.path] = self._footer(fs, info.path, inner[0].split("=")[1])
            if segment := self.known[info.path]:
                found.setdefault(segment.partition, []).append(segment)
        for p, files in found.items():
            files.sort(key=lambda s: s.first)
            for a, b in zip(files, files[1:]):
                if b.first < a.next:
                    raise ValueError(f"{a.path} and {b.path} hold the same offsets of partition {p}")
        return found

    @staticmethod
    def _footer(fs: pa.fs.FileSystem, path: str, partition: str) -> Segment | None:
        meta = pq.read_metadata(path, filesystem=fs)
        at = meta.schema.to_arrow_schema().get_field_index("offset")
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
        if not stats:
            return None
        return Segment(partition, min(s.min for s in stats), max(s.max for s in stats) + 1, path)

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        """Records of a stretch, a batch at a time; row groups outside it aren't read."""
        fs, _ = self.open()
        with fs.open_input_file(stretch.path) as raw:
            file = pq.ParquetFile(raw)
            at = file.schema_arrow.get_field_index("offset")
            groups = [i for i in range(file.num_row_groups) if (s := file.metadata.row_group(i).column(at).statistics) and s.max >= stretch.start and s.min < stretch.end]
            for batch in file.iter_batches(batch_size=8192, row_groups=groups):
                offset = batch.column(at)
                batch = batch.filter(pc.and_(pc.greater_equal(offset, stretch.start), pc.less(offset, stretch.end)))
                if batch.num_rows:
                    columns = [pa.array([int(stretch.partition)] * batch.num_rows, pa.int32()) if f.name == "partition" else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in _ARROW]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def earliest(log: dict[str, list[Segment]]) -> Offsets:
    return {p: files[0].first for p, files in log.items()}


def latest(log: dict[str, list[Segment]]) -> Offsets:
    return {p: files[-1].next for p, files in log.items()}


def named(log: dict[str, list[Segment]], option: str, rest: Offsets) -> Offsets:
    """Offsets that an option names; partitions it leaves out get those of ``rest``."""
    if option in ("earliest", "latest"):
        return earliest(log) if option == "earliest" else latest(log)
    given = {str(p): int(o) for p, o in json.loads(option).items()}
    return {**rest, **given}


def limited(start: Offsets, end: Offsets, most: int) -> Offsets:
    """As far from ``start`` towards ``end`` as ``most`` records go, shared by lag; what rounding leaves goes to those cut most."""
    lag = {p: max(0, end[p] - start.get(p, end[p])) for p in end}
    total = sum(lag.values())
    if total <= most:
        return {p: max(end[p], start.get(p, end[p])) for p in end}
    share = {p: lag[p] * most // total for p in lag}
    for p in sorted(lag, key=lambda p: (-(lag[p] * most % total), p))[: most - sum(share.values())]:
        share[p] += 1
    return {p: start.get(p, end[p]) + share[p] for p in end}


def stretches(log: dict[str, list[Segment]], start: Offsets, end: Offsets, strict: bool) -> list[Stretch]:
    """A stretch for each file that holds offsets from ``start`` up to ``end``."""
    out = []
    for p in sorted(end, key=int):
        files = log.get(p, [])
        low, high = start.get(p, files[0].first if files else 0), end[p]
        if strict and low < high and (not files or low < files[0].first or high > files[-1].next):
            raise DataLoss(f"partition {p}: offsets {low} to {high} were to be read, and there are {f'{files[0].first} to {files[-1].next}' if files else 'none'}")
        out += [Stretch(s, max(low, s.first), min(high, s.next)) for s in files if s.first < high and s.next > low]
    return out


class Positions:
    """Where the last planned batch ended: a file for each, named by the sum of its offsets, which only grows."""

    def __init__(self, root: str):
        self.log = Log(root)

    def _files(self, fs: pa.fs.FileSystem, root: str) -> list[str]:
        return sorted(i.path for i in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)) if i.base_name.endswith(".json"))

    def last(self) -> Offsets | None:
        fs, root = self.log.open()
        files = self._files(fs, root)
        if not files:
            return None
        with fs.open_input_stream(files[-1]) as f:
            return json.loads(f.read())

    def note(self, end: Offsets) -> None:
        if end == self.last():
            return
        fs, root = self.log.open()
        fs.create_dir(root)
        before = self._files(fs, root)
        name = f"{root}/{sum(end.values()):020d}.json"
        with fs.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps(end).encode())
        fs.move(f"{name}.new", name)
        for old in before[:-1]:
            fs.delete_file(old)


class Options:
    def __init__(self, given: dict[str, str]):
        self.path = given["path"]
        self.start, self.end = given.get("startingOffsets", "earliest"), given.get("endingOffsets", "latest")
        self.most = int(given["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in given else None
        self.rows = int(given["rows"]) if "rows" in given else None
        self.strict = given.get("failOnDataLoss", "true").lower() == "true"
        self.positions = given.get("positions")
        if self.most is not None and (self.most < 1 or not self.positions):
            raise ValueError("maxOffsetsPerTrigger has to be positive, and needs a folder for positions")


class RangeReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options, self.log = options, Log(options.path)

    def partitions(self) -> list[InputPartition]:
        o, found = self.options, self.log.segments()
        start = named(found, o.start, earliest(found))
        end = named(found, o.end, latest(found))
        end = {p: max(end[p], start.get(p, end[p])) for p in end}
        if o.rows is not None:
            end = limited({p: start.get(p, earliest(found).get(p, 0)) for p in end}, end, o.rows)
        return stretches(found, start, end, o.strict) or [InputPartition(None)]  # Spark wants one at least

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition) if isinstance(partition, Stretch) else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options, self.log = options, Log(options.path)
        self.positions = Positions(options.positions) if options.positions else None

    def initialOffset(self) -> Offsets:
        found = self.log.segments()
        return named(found, self.options.start, earliest(found))

    def latestOffset(self) -> Offsets:
        found = self.log.segments()
        end = latest(found)
        at = self.positions.last() if self.positions else None
        if at is None:
            at = self.initialOffset()
        # a partition that came later starts at its beginning; one that is gone stays where it was
        at = {**{p: files[0].first for p, files in found.items() if p not in at}, **at}
        end = {p: max(end.get(p, 0), at[p]) for p in at}
        return end if self.options.most is None else limited(at, end, self.options.most)

    def partitions(self, start: Offsets, end: Offsets) -> list[InputPartition]:
        if self.positions:
            self.positions.note(end)
        return stretches(self.log.segments(), start, end, self.options.strict)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(Options(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Options(self.options))


def log_stream(spark: SparkSession, path: str, positions: str, most: int = 2500) -> DataFrame:
    """The log as a stream of at most ``most`` records a batch, from its beginning."""
    spark.dataSource.register(RecordLog)
    return spark.readStream.format("record_log").option("maxOffsetsPerTrigger", most).option("positions", positions).load(path)


def log_range(spark: SparkSession, path: str, start: str = "earliest", end: str = "latest", rows: int | None = None) -> DataFrame:
    """Records by offsets; ``rows`` of them at most, so that a look at a topic reads no more than that."""
    spark.dataSource.register(RecordLog)
    reader = spark.read.format("record_log").option("startingOffsets", start).option("endingOffsets", end)
    return (reader if rows is None else reader.option("rows", rows)).load(path)


def append_log(spark: SparkSession, records: DataFrame, path: str, partitions: int = 4, by: Column | None = None) -> None:
    """Add ``records(key, value, topic, timestamp)`` to a log: a key's records go to one partition, in order of time.

    ``by`` is a number to choose the partition by; left out, it is a hash of the key.

    Offsets go on from those the log has.  Numbers come from two passes over
    ranges, so a partition that most keys fall into is no single task's.
    """
    log = Log(path)
    ends = latest(log.segments())
    p = F.pmod(F.crc32(F.coalesce("key", F.lit(b""))) if by is None else by, F.lit(partitions)).cast("int")
    placed = kept(numbered(records.withColumn("partition", p), ["partition", "timestamp", "key", "value"], "offset"))
    counts = {r["partition"]: r["n"] for r in placed.groupBy("partition").agg(F.count("*").alias("n")).collect()}  # at most ``partitions`` rows
    shift, before = F.lit(0).cast("long"), 0
    for part in sorted(counts):
        shift = F.when(F.col("partition") == part, ends.get(str(part), 0) - before).otherwise(shift)
        before += counts[part]
    out = placed.select("key", "value", "topic", "partition", (F.col("offset") + shift).alias("offset"), "timestamp")
    out.sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").option("compression", "zstd").parquet(path)


def records_of(events: DataFrame, key: Column, topic: str) -> DataFrame:
    """Events as records with JSON values."""
    return events.select(key.cast("string").cast("binary").alias("key"), F.to_json(F.struct(*events.columns)).cast("binary").alias("value"), F.lit(topic).alias("topic"), F.timestamp_millis("timestamp").alias("timestamp"))
