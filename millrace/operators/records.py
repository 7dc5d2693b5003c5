"""Delimited lines to typed records and back, by record type, with a reject path."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.coerce import SPARK_TYPES, zero_default

WRONG_ARITY = "field_count"
UNKNOWN_TYPE = "unknown_record_type"
NO_LINE = "no_line"  # the line is NULL


@dataclass(frozen=True)
class RecordSchema:
    """Ordered ``(column, cell type)`` pairs of one record type."""

    fields: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        for name, kind in self.fields:
            if kind not in SPARK_TYPES:
                raise ValueError(f"column {name}: unknown cell type {kind!r}")

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.fields]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[k]) for n, k in self.fields])

    def only(self, columns: Sequence[str]) -> RecordSchema:
        """The configured columns, in configured order; an unknown name is an error."""
        kinds = dict(self.fields)
        unknown = [c for c in columns if c not in kinds]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        return RecordSchema(tuple((c, kinds[c]) for c in columns))


PERSON = RecordSchema((("name", "string"), ("age", "int32"), ("sex", "string")))

# The record types and their (identical) layout.
RECORD_TYPES: dict[str, RecordSchema] = {"sms": PERSON, "gsm": PERSON, "gprs": PERSON}


def cells(line: Column, separator: str = ",") -> Column:
    """All cells of a line: no quoting, empty cells kept."""
    if not separator:
        raise ValueError("the separator must not be empty")
    return F.split(line, re.escape(separator), -1)


def record_fields(parts: Column, schema: RecordSchema) -> list[Column]:
    return [zero_default(parts[i], kind).alias(name) for i, (name, kind) in enumerate(schema.fields)]


def parse_lines(lines: DataFrame, schema: RecordSchema, separator: str = ",",
                value: str = "value") -> DataFrame:
    """Parse lines of one record type.

    Adds the record columns and ``reject_reason`` (NULL for good lines).  A line whose number of
    cells differs from the schema is rejected as a whole; a bad cell only turns into a zero value.
    """
    parts = lines.withColumn("__cells", cells(F.col(value), separator))
    fits = F.coalesce(F.size("__cells"), F.lit(-1)) == len(schema.fields)
    return parts.select(
        *lines.columns,
        F.when(F.col("__cells").isNull(), F.lit(NO_LINE)).when(~fits, F.lit(WRONG_ARITY)).alias("reject_reason"),
        *[F.when(fits, c).alias(n) for n, c in zip(schema.names, record_fields(F.col("__cells"), schema))],
    )


def parse_by_type(lines: DataFrame, record_type: Column, separator: str = ",",
                  registry: Mapping[str, RecordSchema] = RECORD_TYPES,
                  value: str = "value") -> DataFrame:
    """Parse a mix of record types in one pass over the lines.

    Each type fills its own struct column; the structs of the other types stay NULL.  Types that
    are not registered, and lines of the wrong length, get a ``reject_reason``.
    """
    parts = lines.withColumn("record_type", record_type).withColumn(
        "__cells", cells(F.col(value), separator)
    )
    reason = F.lit(UNKNOWN_TYPE)
    for name, schema in registry.items():
        short = F.size("__cells") != len(schema.fields)
        reason = F.when(F.col("record_type") == name, F.when(short, F.lit(WRONG_ARITY))).otherwise(reason)
    parts = parts.withColumn("reject_reason", F.when(F.col("__cells").isNull(), F.lit(NO_LINE)).otherwise(reason))
    good = F.col("reject_reason").isNull()
    return parts.select(
        *lines.columns,
        "record_type",
        "reject_reason",
        *[
            F.when(
                good & (F.col("record_type") == name),
                F.struct(*record_fields(F.col("__cells"), schema)),
            ).alias(name)
            for name, schema in registry.items()
        ],
    )


def merge_same_layout(parsed: DataFrame, registry: Mapping[str, RecordSchema] = RECORD_TYPES) -> DataFrame:
    """Flatten the struct columns of record types that share one layout."""
    layouts = {schema.fields for schema in registry.values()}
    if len(layouts) != 1:
        raise ValueError("the record types do not share one layout")
    names = next(iter(registry.values())).names
    others = [c for c in parsed.columns if c not in registry]
    return parsed.select(
        *others,
        *[F.coalesce(*[F.col(kind)[name] for kind in registry]).alias(name) for name in names],
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``; persist the input first when both sides are written."""
    reason = F.col("reject_reason")
    return parsed.where(reason.isNull()).drop("reject_reason"), parsed.where(reason.isNotNull())


def reject_summary(parsed: DataFrame, *by: str) -> DataFrame:
    """Lines per reject reason; good lines count under ``ok``."""
    reason = F.coalesce("reject_reason", F.lit("ok")).alias("reject_reason")
    return parsed.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n_lines"))


def record_line(columns: Sequence[str], separator: str = ",") -> Column:
    """A record as a delimited line, in configured column order (an absent cell is empty)."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def to_payload(columns: Sequence[str]) -> Column:
    """A record as payload bytes (JSON; absent cells are kept as null)."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")


def from_payload(payload: Column, schema: T.StructType) -> Column:
    return F.from_json(payload.cast("string"), schema)


def to_protobuf_payload(columns: Sequence[str], message: str, descriptor: str) -> Column:
    """A record as protobuf bytes; needs Spark's protobuf module and a descriptor file."""
    from pyspark.sql.protobuf.functions import to_protobuf

    return to_protobuf(F.struct(*columns), message, descriptor)


def from_protobuf_payload(payload: Column, message: str, descriptor: str) -> Column:
    from pyspark.sql.protobuf.functions import from_protobuf

    return from_protobuf(payload, message, descriptor)
