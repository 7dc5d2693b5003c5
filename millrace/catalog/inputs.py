"""The registry of queries, and the inputs they derive from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lag
from millrace.session import ship
from millrace.sources import queue, shapes, spool

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its own name; clocks are read in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    REGISTRY[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


SPOOL_NAMES = {"signup": "sms", "purchase": "gsm", "error": "gprs", "view": "fax", "click": "tmp"}
SPOOL_RULE = "^(sms|gsm|gprs|fax)[[:alnum:]]+"


def person_line() -> Column:
    """``name,age,sex`` of an event: every 11th age is no number, every 7th line has a cell too many."""
    age = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.floor("value").cast("string"))
    sex = F.when(F.col("user_id") % 2 == 0, "female").otherwise("male")
    line = F.concat_ws(",", F.concat(F.lit("u"), F.col("user_id").cast("string")), age, sex)
    return F.when(F.col("event_id") % 7 == 0, F.concat(line, F.lit(",extra"))).otherwise(line)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", person_line().alias("value"))


def record_type_of_event() -> Column:
    pairs = [F.lit(word) for pair in SPOOL_NAMES.items() for word in pair]
    return F.create_map(*pairs)[F.col("event_type")]


def land_spool(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Write the event lines as spool files, one name prefix per event type."""
    lines = event_lines(spark, sf_dir)
    for kind, name in SPOOL_NAMES.items():
        spool.write_spool(lines.where(F.col("event_type") == kind), path, f"{name}1")
    return path


def file_type() -> Column:
    """The record type a spool file name starts with."""
    return F.regexp_extract("file_name", "^([a-z]+)", 1)


def as_messages(events: DataFrame, partitions: int) -> DataFrame:
    """Events as messages; the event number serves as a (sparse) offset."""
    return queue.envelope(
        events, F.col("user_id"), F.col("props"), F.col("event_type"),
        F.col("user_id") % partitions, F.col("event_id"), F.col("value").alias("amount"), "ts",
    )


def handled() -> Column:
    """Messages above this amount count as handled."""
    return F.col("amount") > 50


def event_lags(spark: SparkSession, sf_dir: str, partitions: int = 64) -> DataFrame:
    messages = as_messages(table(spark, sf_dir, "events"), partitions)
    return lag.lag_report(lag.progress(messages, handled()))


def nation_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("worker"))


def supplier_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("worker"))


def rectangle_of_event() -> Column:
    """A rectangle payload; every 13th is damaged."""
    payload = shapes.rectangle_payload(F.col("event_id") % 1000 + 1, F.col("user_id") % 100 + 1)
    return F.when(F.col("event_id") % 13 == 0, F.lit("{broken").cast("binary")).otherwise(payload)


def rectangle_messages(events: DataFrame) -> DataFrame:
    """Rectangle payloads by event."""
    return events.select("event_id", rectangle_of_event().alias("value"))


def square_of_payload(payload: bytes) -> bytes:
    """The example user function: rectangle in, square out."""
    import json

    shape = json.loads(payload)
    return json.dumps({"S": shape["Height"] * shape["Length"]}).encode()


def squares_of_payloads(payloads: list[bytes]) -> list:
    answers: list = []
    for payload in payloads:
        try:
            answers.append(square_of_payload(payload))
        except ValueError as problem:
            answers.append(problem)
    return answers


def deal_messages(events: DataFrame, partitions: int = 4) -> DataFrame:
    """Events as messages with rectangle payloads; every 97th makes the call that gets it fail."""
    payload = F.when(F.col("event_id") % 97 == 0, F.lit("stop").cast("binary")).otherwise(rectangle_of_event())
    return events.select(
        F.col("event_type").alias("topic"), (F.col("user_id") % partitions).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), payload.alias("value"), "ts")


def squares_or_stop(payloads: list[bytes]) -> list:
    if b"stop" in payloads:
        raise RuntimeError("stop")
    return squares_of_payloads(payloads)


def square_column() -> Column:
    return F.get_json_object(F.col("result").cast("string"), "$.S").cast("bigint")
