"""Streaming queries: each runs over all available files and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import (
    SPOOL_NAMES, as_messages, deal_messages, file_type, handled, land_spool, nation_workers, query, rectangle_messages,
    square_column, square_of_payload, squares_of_payloads, squares_or_stop, stream_table, table,
)
from millrace.operators import allot, deal
from millrace.operators.records import PERSON, from_payload
from millrace.plans.channels import resolve
from millrace.sinks.outputs import outcome_handlers
from millrace.sources import queue
from millrace.staging import Staging
from millrace.streaming import batches, flows, folders


def _deal_stream(spark: SparkSession, dealt: DataFrame, staging: Staging) -> DataFrame:
    good, bad = staging.folder("success"), staging.folder("failed")
    handle = outcome_handlers(flows.batch_table(good), flows.batch_table(bad))
    flows.run_to_end(dealt, handle, staging.folder("checkpoint"))
    both = spark.read.parquet(good).unionByName(spark.read.parquet(bad))
    return both.select("event_id", "deal_tag", square_column().alias("square"))


@query
def stream_single_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of messages through a user function, split into two tables."""
    messages = rectangle_messages(stream_table(spark, sf_dir, "events"))
    return _deal_stream(spark, deal.deal_each(messages, square_of_payload), Staging(spark))


@query
def stream_batch_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream through a function that takes batches."""
    messages = rectangle_messages(stream_table(spark, sf_dir, "events"))
    return _deal_stream(spark, deal.deal_batches(messages, squares_of_payloads, 30), Staging(spark))


@query
def stream_partition_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of messages through a function in batches of 20 of one topic partition; the closed batches."""
    staging = Staging(spark)
    messages = deal_messages(stream_table(spark, sf_dir, "events"))
    path = staging.folder("dealt")
    dealt = batches.deal_partition_batches(messages, squares_or_stop, max_rows=20, max_wait=10**6)
    batches.run_available(dealt, flows.batch_table(path), staging.folder("checkpoint"))
    written = spark.read.parquet(path).drop("batch").withColumnRenamed("deal_batch", "batch")
    return deal.run_summary(written, ["topic", "partition", "batch"])


@query
def stream_offset_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offset progress per topic partition; its final state."""
    staging = Staging(spark)
    path = staging.folder("progress")
    messages = as_messages(stream_table(spark, sf_dir, "events"), 64)
    flows.run_to_end(flows.offset_progress(messages, handled()), flows.batch_table(path),
                     staging.folder("checkpoint"), mode="complete")
    return flows.newest_batch(spark, path)


@query
def stream_reallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag check and re-allotment on a stream; the allotment in force at the end."""
    staging = Staging(spark)
    published = staging.folder("allotment")
    items = queue.topic_partitions(as_messages(table(spark, sf_dir, "events"), 64))
    flows.batch_table(published)(allot.round_robin(items, nation_workers(spark, sf_dir), staging), -1)

    def current() -> DataFrame:
        return flows.newest_batch(spark, published)

    handle = flows.reallot_writer(current, flows.batch_table(published))
    messages = as_messages(stream_table(spark, sf_dir, "events"), 64)
    flows.run_to_end(flows.offset_progress(messages, handled()), handle,
                     staging.folder("checkpoint"), mode="complete")
    return current()


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels from spool files to typed payloads and dead letters, counted by outcome."""
    staging = Staging(spark)
    spool_dir = land_spool(spark, sf_dir, staging.folder("spool"))
    table_dir, fail_dir = staging.folder("sent"), staging.folder("fail")
    types = [name for name in SPOOL_NAMES.values() if name in ("sms", "gsm", "gprs")]
    channels = resolve({
        "sources": {t: {
            "record_type": t, "directory": spool_dir, "delete_policy": "immediate",
            "name_rule": f"^{t}[[:alnum:]]+", "separator": ",", "columns": "name,age,sex",
        } for t in types},
        "sinks": {t: {"table": f"{table_dir}/record_type={t}", "fail_path": f"{fail_dir}/record_type={t}"}
                  for t in types},
        "channels": {t: {"source": t, "sink": t} for t in types},
    })
    files = {name: flows.IngestedFiles(spark, channel, staging.folder("ingested")) for name, channel in channels.items()}
    running = {
        name: flows.start(flows.ingest_lines(spark, channel), flows.ingest_writer(channel, files=files[name]),
                          staging.folder("checkpoint"))
        for name, channel in channels.items()
    }
    for name, stream in running.items():
        stream.awaitTermination()
        files[name].settle()
    sent = spark.read.parquet(table_dir)
    record = from_payload(F.col("value"), PERSON.struct())
    good = sent.select("record_type", F.lit("sent").alias("outcome"), record["age"].alias("age"))
    bad = spark.read.text(fail_dir).select(
        "record_type", F.col("fail_class").alias("outcome"), F.lit(None).cast("int").alias("age"))
    return good.unionByName(bad).groupBy("record_type", "outcome").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("age").alias("sum_age"))


@query
def stream_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of one folder in one stream, counted by outcome; the last joins later and gets what lands then."""
    staging = Staging(spark)
    spool_dir, checkpoint = staging.folder("spool"), staging.folder("checkpoint")
    table_dir, fail_dir = staging.folder("sent"), staging.folder("fail")
    rules = {"sms": "^sms[[:alnum:]]+", "gsm": "^gsm[[:alnum:]]+", "mobile": "^(sms|gsm)[[:alnum:]]+", "gprs": "^gprs[[:alnum:]]+"}
    channels = list(resolve({
        "sources": {name: {
            "record_type": "sms", "directory": spool_dir, "delete_policy": "off",
            "name_rule": rule, "separator": ",", "columns": "name,age,sex",
        } for name, rule in rules.items()},
        "sinks": {name: {"table": f"{table_dir}/channel={name}", "fail_path": f"{fail_dir}/channel={name}"} for name in rules},
        "channels": {name: {"source": name, "sink": name} for name in rules},
    }).values())
    for taken in (channels[:-1], channels):
        land_spool(spark, sf_dir, spool_dir)
        folders.ingest_folder(spark, taken, checkpoint)
    record = from_payload(F.col("value"), PERSON.struct())
    good = spark.read.parquet(table_dir).select("channel", F.lit("sent").alias("outcome"), record["age"].alias("age"))
    bad = spark.read.text(fail_dir).select("channel", F.col("fail_class").alias("outcome"), F.lit(None).cast("int").alias("age"))
    return good.unionByName(bad).groupBy("channel", "outcome").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("age").alias("sum_age"))


@query
def stream_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files that neither of two channels on one folder wants, recorded once."""
    staging = Staging(spark)
    spool_dir, skip_dir = land_spool(spark, sf_dir, staging.folder("spool")), staging.folder("skipped")
    channels = resolve({
        "sources": {t: {
            "record_type": t, "directory": spool_dir, "delete_policy": "off",
            "name_rule": f"^{t}[[:alnum:]]+", "separator": ",", "columns": "name,age,sex",
        } for t in ("sms", "gsm")},
        "sinks": {"k": {"skip_path": skip_dir}},
        "channels": {t: {"source": t, "sink": "k"} for t in ("sms", "gsm")},
    })
    for _ in range(2):
        flows.record_skipped(spark, channels["sms"], [channels["gsm"]])
    return spark.read.parquet(skip_dir).groupBy(file_type().alias("prefix")).agg(F.sum("length").alias("n_bytes"))
