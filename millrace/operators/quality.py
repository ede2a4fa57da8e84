"""Data-quality constraints, the gate over micro-batches, and its metrics.

All constraints of a table are one aggregation over it, whole or by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept, stored

MOST_VERDICTS = 20_000  # rows of a name or two and some constraints' names


@dataclass(frozen=True)
class Constraint:
    """``kind`` is complete, min or max. A bound ignores nulls, and fails where every value is null."""

    kind: str
    column: str
    bound: float | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column}" + (")" if self.bound is None else f", {self.bound:g})")

    def aggregate(self) -> Column:
        c = F.col(self.column)
        return {"complete": F.count_if(c.isNull()), "min": F.min(c), "max": F.max(c)}[self.kind]

    def metric(self) -> Column:
        return self.aggregate().cast("double")

    def holds(self, metric: Column) -> Column:
        test = {"complete": metric == 0, "min": metric >= F.lit(self.bound), "max": metric <= F.lit(self.bound)}[self.kind]
        return F.coalesce(test, F.lit(False))


def complete(*columns: str) -> list[Constraint]:
    return [Constraint("complete", c) for c in columns]


def within(column: str, low: float, high: float) -> list[Constraint]:
    return [Constraint("min", column, low), Constraint("max", column, high)]


# fixed values: what the gate asks of each silver table
TRIPS = [
    *complete("timestamp", "pickup_location_id", "dropoff_location_id", "fare_amount", "passenger_count"),
    *within("trip_distance", 0.1, 200.0), *within("fare_amount", 2.5, 1000.0), *within("passenger_count", 1, 6),
    *within("pickup_location_id", 1, 263), *within("dropoff_location_id", 1, 263),
]
WEATHER = [
    *complete("timestamp", "location_id", "condition"), *within("temperature", -20.0, 120.0), *within("precipitation", 0.0, 10.0), *within("wind_speed", 0.0, 100.0),
]
EVENTS = [*complete("timestamp", "location_id", "event_type", "start_time", "end_time"), *within("attendance_estimate", 1, 100000)]


def _metrics(constraints: list[Constraint]) -> list[Column]:
    return [c.metric().alias(f"_m{i}") for i, c in enumerate(constraints)]


def observed(constraints: list[Constraint]) -> list[Column]:
    """What to observe of rows while they are written: their number and each constraint's metric."""
    return [F.count(F.lit(1)).alias("record_count"), *_metrics(constraints)]


def judged(seen: dict, constraints: list[Constraint]) -> tuple[int, bool, str | None] | None:
    """Rows seen, whether all constraints hold, and those that don't; None where there were no rows."""
    if not seen.get("record_count"):
        return None

    def holds(c: Constraint, value: float | None) -> bool:
        return value is not None and (value == 0 if c.kind == "complete" else value >= c.bound if c.kind == "min" else value <= c.bound)

    failed = [c.name for i, c in enumerate(constraints) if not holds(c, seen[f"_m{i}"])]
    return seen["record_count"], not failed, "; ".join(failed) or None


def report(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """``(constraint, metric, passed)``, a row for each constraint, from one scan."""
    lines = F.array(*(F.struct(F.lit(c.name).alias("constraint"), F.col(f"_m{i}").alias("metric"), c.holds(F.col(f"_m{i}")).alias("passed")) for i, c in enumerate(constraints)))
    return df.agg(*_metrics(constraints)).select(F.explode(lines).alias("r")).select("r.*")


def with_batch(df: DataFrame, rows: int) -> DataFrame:
    """A batch id where there is no stream to give one: runs of ``rows`` bronze offsets."""
    return df.withColumn("batch_id", F.floor(F.col("bronze_offset") / rows))


def verdicts(df: DataFrame, constraints: list[Constraint], batch: str = "batch_id") -> DataFrame:
    """``(batch_id, record_count, passed, failures)``; failures lists the constraints that failed, null if none."""
    failed = F.array_compact(F.array(*(F.when(~c.holds(F.col(f"_m{i}")), c.name) for i, c in enumerate(constraints))))
    by_batch = df.groupBy(batch).agg(F.count("*").alias("record_count"), *_metrics(constraints))
    out = by_batch.select(F.col(batch).alias("batch_id"), "record_count", failed.alias("failed"))
    return out.select("batch_id", "record_count", (F.size("failed") == 0).alias("passed"), F.when(F.size("failed") > 0, F.array_join("failed", "; ")).alias("failures"))


def row_failures(df: DataFrame, constraints: list[Constraint]) -> Column:
    """The constraints that a single row breaks; null if none."""

    def broken(c: Constraint) -> Column:
        v = F.col(c.column)
        return {"complete": v.isNull(), "min": v < F.lit(c.bound), "max": v > F.lit(c.bound)}[c.kind]

    names = F.array_compact(F.array(*(F.when(broken(c), c.name) for c in constraints)))
    return F.when(F.size(names) > 0, F.array_join(names, "; "))


def gate(df: DataFrame, constraints: list[Constraint], mode: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows of ``df(batch_id, ...)``.

    In mode "batch" one bad row sends its whole batch away; in mode "row" only
    rows that break a constraint themselves go.  Quarantined rows get the reason.
    What ``df`` computes is stored once; from there a batch is judged by one
    aggregation over the columns that constraints name, whose verdicts go back to
    the rows: by broadcast, so that no row is shuffled, if they are counted to be
    at most ``MOST_VERDICTS``, else by a join.  Rows without a batch are one batch.
    """
    if mode == "row":
        judged = df.withColumn("failure_reason", row_failures(df, constraints))
    else:
        df = stored(df)
        found = kept(verdicts(df, constraints).select(F.col("batch_id").alias("_batch"), F.col("failures").alias("failure_reason")))
        found = F.broadcast(found) if found.count() <= MOST_VERDICTS else found
        judged = df.join(found, df["batch_id"].eqNullSafe(found["_batch"])).drop("_batch")
    return judged.where("failure_reason is null").drop("failure_reason"), judged.where("failure_reason is not null")


def quarantined(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows with the four columns that a quarantine table adds."""
    return rows.withColumns({"quarantine_timestamp": as_of, "batch_id_quarantine": F.col("batch_id"), "validation_status": F.lit("FAILED")}).drop("batch_id")


def quarantine_name(table: str) -> str:
    return table.replace(".silver.", ".quarantine.").replace("silver.", "quarantine.", 1 if table.startswith("silver.") else 0).replace("_cleaned", "_quarantined")


def quarantined_to(table: Column) -> Column:
    """``quarantine_name`` of a column of names."""
    return F.replace(F.regexp_replace(table, r"(^|\.)silver\.", "$1quarantine."), F.lit("_cleaned"), F.lit("_quarantined"))


def metric_rows(found: DataFrame, table: str, job: str, as_of: Column) -> DataFrame:
    """A monitoring row for each batch's verdict; a table's constraints are one check."""
    passed = F.col("passed")
    return found.select(
        as_of.alias("timestamp"),
        F.lit(table).alias("table_name"),
        F.lit(job).alias("job_name"),
        "batch_id",
        "record_count",
        F.when(passed, "Success").otherwise("Error").alias("status"),
        passed.alias("all_checks_passed"),
        passed.cast("long").alias("passed_checks"),
        (~passed).cast("long").alias("failed_checks"),
        F.col("failures").alias("constraint_failures"),
        (~passed).alias("batch_quarantined"),
    )


def pass_rate(metrics: DataFrame) -> DataFrame:
    """Batches and the share of them that passed, in percent, by table; every table that is named gets a row."""
    return metrics.groupBy("table_name").agg(F.count("*").alias("batches"), F.coalesce(F.avg(F.col("all_checks_passed").cast("int")) * 100, F.lit(0.0)).alias("pass_rate"))
