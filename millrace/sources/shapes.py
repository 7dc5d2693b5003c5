"""The example messages: rectangles, and their areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sides of the example load.
FIRST_SIDE, END_SIDE = 2000, 10000


def rectangle_range(spark: SparkSession, start: int = FIRST_SIDE, stop: int = END_SIDE) -> DataFrame:
    """``Rectangle(i, i)`` for i in [start, stop)."""
    return rectangles(spark.range(start, stop), F.col("id"), F.col("id"))


def rectangles(df: DataFrame, length: Column, height: Column, *keep: str) -> DataFrame:
    return df.select(*keep, length.cast("bigint").alias("length"), height.cast("bigint").alias("height"))


def area(length: Column, height: Column) -> Column:
    return height * length


def rectangle_payload(length: Column, height: Column) -> Column:
    """The JSON payload of a rectangle, as bytes."""
    shape = F.struct(length.alias("Length"), height.alias("Height"))
    return F.to_json(shape).cast("binary")
