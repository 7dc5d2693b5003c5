"""SQL databases by environment name.  Secrets come from environment variables only."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.normalise import normalise_numbers, to_instant

# URL patterns by driver, and the isolation names the driver options may carry.
URL_PATTERNS = {
    "postgres": "jdbc:postgresql://{host}:{port}/{dbname}?sslmode={sslmode}",
    "mysql": "jdbc:mysql://{host}:{port}/{dbname}",
    "oracle": "jdbc:oracle:thin:@{tns}",
}
ISOLATION = {"READONLY": "READ_COMMITTED", "SERIALIZABLE": "SERIALIZABLE", "DEFAULT": "READ_COMMITTED"}
WITHOUT_MEANING = ("prefetch_memory", "questionph", "stmt_cache_size", "as")


@dataclass(frozen=True)
class Environment:
    """Where a database is.  ``user_var`` and ``password_var`` name environment variables."""

    name: str
    driver: str
    properties: Mapping[str, str]
    user_var: str
    password_var: str
    driver_options: Mapping[str, str] = field(default_factory=dict)

    def url(self) -> str:
        if self.driver not in URL_PATTERNS:
            raise ValueError(f"environment {self.name}: unknown driver {self.driver!r}")
        try:
            return URL_PATTERNS[self.driver].format(**self.properties)
        except KeyError as missing:
            raise ValueError(f"environment {self.name}: property {missing} is missing") from None

    def options(self) -> dict[str, str]:
        for variable in (self.user_var, self.password_var):
            if variable not in os.environ:
                raise ValueError(f"environment {self.name}: variable {variable} is not set")
        return {
            "url": self.url(),
            "user": os.environ[self.user_var],
            "password": os.environ[self.password_var],
            **driver_options(self.driver_options),
        }


def driver_options(given: Mapping[str, str]) -> dict[str, str]:
    """Translate driver options to JDBC options; those without a Spark meaning raise a warning."""
    options: dict[str, str] = {}
    for name, value in given.items():
        if name == "prefetch_rows":
            if not value.isdigit():
                raise ValueError(f"invalid prefetch_rows: {value}")
            options["fetchsize"] = value
        elif name == "isolation":
            if value not in ISOLATION:
                raise ValueError(f"invalid isolation: {value}")
            options["isolationLevel"] = ISOLATION[value]
        elif name == "loc":
            options["loc"] = value
        elif name in WITHOUT_MEANING:
            warnings.warn(f"option {name} has no meaning for Spark and is ignored", stacklevel=2)
    return options


def read_table(spark: SparkSession, environment: Environment, table: str,
               partition_column: str | None = None, bounds: Sequence[int] | None = None,
               partitions: int = 8, predicates: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Read a table; with a numeric column and its bounds, or with predicates, the read runs in parallel.

    ``slice_predicates`` makes predicates for slices of like size.  Numbers are widened and times get
    the zone of the environment, as ``database_rows`` does.
    """
    options = environment.options()
    zone = options.pop("loc", None)
    if zone:
        options["preferTimestampNTZ"] = "true"  # the wall clock as it is stored
    if predicates is not None:
        url = options.pop("url")
        rows = spark.read.jdbc(url, table, predicates=list(predicates), properties=options)
        return database_rows(rows, zone, strict)
    options["dbtable"] = table
    if partition_column:
        if bounds is None:
            raise ValueError("a partitioned read needs the bounds of its column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return database_rows(spark.read.format("jdbc").options(**options).load(), zone, strict)


def database_rows(rows: DataFrame, zone: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of a database as the pipelines want them.

    Numbers are widened (``strict`` leaves decimals as they are).  With a zone, times without one are
    read in it and become instants.
    """
    rows = normalise_numbers(rows, strict)
    if zone is None:
        return rows
    return rows.select(*[
        to_instant(F.col(f"`{f.name}`").cast("timestamp_ntz"), zone).alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`")
        for f in rows.schema.fields
    ])


def write_table(df: DataFrame, environment: Environment, table: str, commit_rows: int = 500,
                mode: str = "append") -> None:
    """Write a table.  Spark commits once per task; ``commit_rows`` is the size of one batch."""
    options = environment.options()
    options.pop("loc", None)
    writer = df.write.format("jdbc").mode(mode).options(**options)
    writer.option("dbtable", table).option("batchsize", str(commit_rows)).save()
