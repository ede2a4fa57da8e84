"""Bands, clocks and flags used by the silver and gold layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import RushHours


def band(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """The label of the first band whose upper edge lies above ``value``; the last label for everything else, null too."""
    out = F.lit(bands[-1][1])
    for upper, label in reversed(bands[:-1]):
        out = F.when(value < upper, label).otherwise(out)
    return out


def is_rush(hour: Column, rush: RushHours) -> Column:
    return hour.between(*rush.morning) | hour.between(*rush.evening)


def is_weekend(at: Column) -> Column:
    return F.dayofweek(at).isin(1, 7)


def millis(at: Column) -> Column:
    return F.timestamp_millis(at)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null unless ``bottom`` is above zero."""
    return F.when(bottom > 0, top / bottom)


STEPS = float(1 << 30)


def stable_mean(value: Column) -> Column:
    """A mean that doesn't depend on the order of rows: values are cut to multiples of 2^-30 first, whose sums are exact."""
    return F.avg(F.floor(value * F.lit(STEPS))) / F.lit(STEPS)


def flag(condition: Column) -> Column:
    """A condition with unknown counted as false."""
    return F.coalesce(condition, F.lit(False))


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as local date times of the session's zone, for results that are compared across engines."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})
