"""Hash keys on a ring of 2^16, hexadecimal ids and names of stored parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = 1 << 16
DIGITS = 4


def hash16(text: str | Column) -> Column:
    """The low 16 bits of the sum of a text's UTF-16 units times falling powers of 31; as a long."""

    def unit(acc: Column, value: Column) -> Column:
        return (acc * 31 + value).bitwiseAND(F.lit(RING - 1))

    def char(acc: Column, c: Column) -> Column:  # one beyond the basic plane is two units
        point = F.ascii(c).cast("long")
        above = point - 0x10000
        return F.when(point < 0x10000, unit(acc, point)).otherwise(unit(unit(acc, F.shiftright(above, 10) + 0xD800), above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), char)


def hex_id(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), DIGITS, "0")


def is_hex_id(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{4}$")


def ring_distance(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, F.lit(RING) - gap)


def shared_digits(a: Column, b: Column) -> Column:
    """How many leading digits two ids have in common."""
    out = F.lit(DIGITS)
    for n in range(DIGITS, 0, -1):
        out = F.when(F.substring(a, 1, n) != F.substring(b, 1, n), n - 1).otherwise(out)
    return out


def clean_path(path: Column) -> Column:
    """Without a leading ``./``, with a leading slash."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/+", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def part_name(file: Column, chunk: Column, shard: Column | None = None) -> Column:
    name = F.concat(file, F.lit("_chunk"), chunk.cast("string"))
    return name if shard is None else F.concat(name, F.lit("_shard"), shard.cast("string"))


def part_of(name: Column) -> Column:
    """A part's name taken apart: file, chunk, and shard or null."""
    pattern = r"^(.*)_chunk(\d+)(?:_shard(\d+))?$"
    pick = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
    return F.struct(pick[0].alias("file"), F.nullif(pick[1], F.lit("")).cast("int").alias("chunk"), F.nullif(pick[2], F.lit("")).cast("int").alias("shard"))


def host_port(text: Column) -> Column:
    return F.struct(F.split_part(text, F.lit(":"), F.lit(1)).alias("host"), F.split_part(text, F.lit(":"), F.lit(2)).cast("int").alias("port"))
