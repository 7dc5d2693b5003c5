"""Text cells to typed values, where a bad cell becomes the zero value of its type and never NULL.

Every function is one column expression, so a parse stays inside whole-stage code generation.
``try_cast`` alone is too lenient (it trims blanks, takes 'yes' as true, lets '1e400' overflow to
infinity), hence a pattern guards each cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted spellings of each kind of cell.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
SIGNED = r"\A[+-]?[0-9]+\z"
UNSIGNED = r"\A[0-9]+\z"
DECIMAL_FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
HEX_FLOAT = r"\A[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+\z"
SPECIAL_FLOAT = r"\A([+-]?(inf|infinity)|nan)\z"
UINT64_MAX = "18446744073709551615"

# Width in bits of the integer names a record schema may use; unsigned ones land in the next
# wider signed Spark type.
SIGNED_BITS = {"int8": 8, "int16": 16, "int32": 32, "int": 64, "int64": 64}
UNSIGNED_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "uint": 64, "uint64": 64}

SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int": T.LongType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint": T.DecimalType(20, 0),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
}


def to_signed(cell: Column, kind: str) -> Column:
    """64-bit parse, then wrapped to the width of ``kind``."""
    number = F.coalesce(F.when(cell.rlike(SIGNED), cell.try_cast("bigint")), F.lit(0).cast("bigint"))
    spare = 64 - SIGNED_BITS[kind]
    if spare:
        number = F.shiftright(F.shiftleft(number, spare), spare)
    return number.cast(SPARK_TYPES[kind])


def to_unsigned(cell: Column, kind: str) -> Column:
    """Unsigned 64-bit parse, then reduced modulo the width of ``kind``."""
    zero = F.lit(0).cast("decimal(20,0)")
    number = F.when(cell.rlike(UNSIGNED), cell.try_cast("decimal(20,0)"))
    number = F.coalesce(F.when(number <= F.lit(UINT64_MAX).cast("decimal(20,0)"), number), zero)
    bits = UNSIGNED_BITS[kind]
    if bits < 64:
        number = number % F.lit(2**bits).cast("decimal(20,0)")
    return number.cast(SPARK_TYPES[kind])


def to_float(cell: Column, kind: str) -> Column:
    """Decimal and hexadecimal numbers that fit a double, plus the spelled infinities and NaN."""
    value = cell.try_cast("double")
    finite = cell.rlike(DECIMAL_FLOAT) | cell.rlike(HEX_FLOAT)
    number = F.when(F.lower(cell).rlike(SPECIAL_FLOAT), value).when(
        finite & (F.abs(value) < F.lit(float("inf"))), value
    )
    return F.coalesce(number, F.lit(0.0)).cast(SPARK_TYPES[kind])


def to_bool(cell: Column) -> Column:
    return F.coalesce(cell.isin(*TRUE_WORDS), F.lit(False))


def zero_default(cell: Column, kind: str) -> Column:
    """Coerce a text cell to ``kind`` (a key of ``SPARK_TYPES``)."""
    if kind not in SPARK_TYPES:
        raise ValueError(f"unknown cell type {kind!r}")
    if kind == "string":
        return F.coalesce(cell, F.lit(""))
    if kind == "bool":
        return to_bool(cell)
    if kind in SIGNED_BITS:
        return to_signed(cell, kind)
    if kind in UNSIGNED_BITS:
        return to_unsigned(cell, kind)
    return to_float(cell, kind)
