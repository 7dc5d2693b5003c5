"""Column rules for data that comes from, or goes to, a SQL database."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LONG_DIGITS = 18  # digits that always fit 64 bits


def _normal_number(field: T.StructField, strict: bool) -> Column:
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.DecimalType) and not strict:
        if kind.scale > 0:
            return column.cast("double")
        return column.cast("bigint") if kind.precision <= LONG_DIGITS else column
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return column.cast("bigint")
    if isinstance(kind, T.FloatType):
        return column.cast("double")
    return column


def normalise_numbers(df: DataFrame, strict: bool = False) -> DataFrame:
    """Widen numbers: scaled decimals to double, whole ones to bigint, floats to double.

    Doubles lose digits beyond 15.  Whole decimals that may not fit 64 bits stay decimals, as all do
    with ``strict``.
    """
    return df.select(*[_normal_number(f, strict).alias(f.name) for f in df.schema.fields])


def booleans_to_bits(df: DataFrame) -> DataFrame:
    """Booleans as 0/1 integers, the form in which they are bound to a statement."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("int").alias(f.name)
        if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def empty_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty strings as NULL, as some databases store them."""
    chosen = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    }
    return df.select(*[
        F.nullif(F.col(f"`{name}`"), F.lit("")).alias(name) if name in chosen else F.col(f"`{name}`")
        for name in df.columns
    ])


def to_instant(wall: Column, zone: str) -> Column:
    """A wall-clock time without a zone, read in ``zone``, as an instant."""
    return F.to_utc_timestamp(wall, zone)


def to_wall_clock(instant: Column, zone: str) -> Column:
    """An instant as the wall-clock time shown in ``zone``."""
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def interval_months(interval: Column) -> Column:
    """A year-month interval as whole months."""
    years = F.extract(F.lit("YEAR"), interval).cast("bigint")
    return years * 12 + F.extract(F.lit("MONTH"), interval).cast("bigint")


def interval_nanos(interval: Column) -> Column:
    """A day-time interval as nanoseconds."""
    def part(name: str) -> Column:
        return F.extract(F.lit(name), interval)

    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    micros = (part("SECOND") * F.lit(1_000_000)).cast("bigint")
    return (minutes * 60_000_000 + micros) * 1000


# How many months or seconds one unit has.
MONTHS_PER = {"YEAR": 12, "MONTH": 1}
SECONDS_PER = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def number_to_months_interval(number: Column, unit: str) -> Column:
    """A number of years or months as a year-month interval, rounded to whole months."""
    months = F.round(number * MONTHS_PER[unit.upper()]).cast("int")
    return F.make_ym_interval(F.lit(0), months)


def number_to_seconds_interval(number: Column, unit: str) -> Column:
    """A number of days, hours, minutes or seconds as a day-time interval."""
    seconds = (number * SECONDS_PER[unit.upper()]).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, nullability and the longest value seen.

    ``length`` is NULL for types without one.  All lengths come from a single aggregate.
    """
    fields = df.schema.fields
    sized = (T.StringType, T.BinaryType)
    lengths = df.agg(*[
        (F.max(F.length(F.col(f"`{f.name}`"))) if isinstance(f.dataType, sized)
         else F.lit(None).cast("int")).alias(f"l{i}")
        for i, f in enumerate(fields)
    ])
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"),
            F.col(f"l{i}").alias("length"),
        )
        for i, f in enumerate(fields)
    ]
    return lengths.select(F.inline(F.array(*rows)))


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Configured columns in configured order; an unknown name is an error."""
    return df.select(*columns)


def odd_rows(left: DataFrame, right: DataFrame, surplus: str = "surplus") -> DataFrame:
    """Distinct rows that the frames hold in different numbers; ``surplus`` is what the left has more."""
    names = left.columns
    signed = left.select(*names, F.lit(1).alias(surplus)).unionByName(
        right.select(*names, F.lit(-1).alias(surplus))
    )
    return signed.groupBy(*names).agg(F.sum(surplus).alias(surplus)).where(F.col(surplus) != 0)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames hold the same rows, order aside and counting duplicates."""
    return sorted(left.columns) == sorted(right.columns) and odd_rows(left, right, "__n").isEmpty()


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
