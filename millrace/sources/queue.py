"""Queue topics: the message envelope, reading it from Kafka, and building it from a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.numbering import dense_index
from millrace.staging import Staging

ENVELOPE = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("deal_tag", T.BooleanType()),
    T.StructField("result", T.BinaryType()),
])


def kafka_read_options(servers: str | Sequence[str], topics: Sequence[str], group: str | None = None,
                       start: str = "earliest", max_offsets: int | None = None) -> dict[str, str]:
    """Options of the Kafka source.  ``start`` is ``earliest``, ``latest`` or a JSON of offsets."""
    if not topics:
        raise ValueError("no topics")
    options = {
        "kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
        "subscribe": ",".join(topics),
        "startingOffsets": start,
    }
    if group:
        options["groupIdPrefix"] = group
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_queue(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """The envelope columns of a Kafka source (needs the connector on the class path)."""
    source = spark.readStream if streaming else spark.read
    messages = source.format("kafka").options(**options).load()
    return undealt(messages.select("key", "value", "topic", "partition", "offset"))


def undealt(messages: DataFrame) -> DataFrame:
    """Add the empty outcome columns of messages nobody has dealt with yet."""
    return messages.withColumn("deal_tag", F.lit(None).cast("boolean")).withColumn(
        "result", F.lit(None).cast("binary")
    )


def envelope(df: DataFrame, key: Column, value: Column, topic: Column, partition: Column,
             offset: Column, *keep: str | Column) -> DataFrame:
    """Shape any table as messages; ``keep`` carries extra columns along."""
    return df.select(
        key.cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        topic.alias("topic"),
        partition.cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        *keep,
    )


def with_dense_offsets(messages: DataFrame, order_by: Sequence[str],
                       staging: Staging | None = None) -> DataFrame:
    """Number the messages of each (topic, partition) from 0, as a broker would on arrival."""
    return dense_index(messages.drop("offset"), order_by, ["topic", "partition"], "offset", staging)


def topic_partitions(messages: DataFrame) -> DataFrame:
    """The (topic, partition) pairs that occur."""
    return messages.select("topic", "partition").distinct()
