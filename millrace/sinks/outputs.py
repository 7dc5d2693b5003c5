"""Where records go: queue topics, dead letters, success and fail tables, manifests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.days import HOME_ZONE
from millrace.operators.batching import count_or_time, null_safe_join
from millrace.operators.deal import split_outcomes
from millrace.sinks.roll_files import read_rolls, write_rolls
from millrace.sources.spool import list_files, route
from millrace.staging import Staging

# A dead-letter file rolls after this many rows or seconds.
ROLL_ROWS, ROLL_SECONDS = 3000, 60

PARSE, SEND = "parse", "send"


def kafka_write_options(servers: str | Sequence[str], topic: str) -> dict[str, str]:
    """Options of the Kafka sink: wait for all replicas; without a key partitions are picked freely."""
    return {
        "kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
        "kafka.acks": "all",
        "topic": topic,
    }


def write_queue(df: DataFrame, options: dict[str, str] | None, fallback: str | None = None) -> None:
    """Send payloads to Kafka, or append them to a table when there is no connector."""
    payload = df.select(F.lit(None).cast("binary").alias("key"), "value")
    if options is not None:
        payload.write.format("kafka").options(**options).save()
    elif fallback is not None:
        payload.write.mode("append").parquet(fallback)
    else:
        raise ValueError("neither a queue nor a fallback table is given")


def dead_letters(rejected: DataFrame, line: str | Column, fail_class: str | Column = PARSE,
                 origin: Sequence[str] = ()) -> DataFrame:
    """``(fail_class, value)`` rows of what could not be parsed or sent, and where it came from.

    ``origin`` names columns to keep, like the file name and line number; a text file has no room for them.
    """
    line = F.col(line) if isinstance(line, str) else line
    kind = F.lit(fail_class) if isinstance(fail_class, str) else fail_class
    return rejected.select(kind.alias("fail_class"), line.alias("value"), *origin)


def _stamp() -> str:
    """The driver's clock in the home zone."""
    return datetime.now(datetime.strptime(HOME_ZONE, "%z").tzinfo).strftime("%Y%m%d%H%M%S")


def _letter_writer(letters: DataFrame, channel: str, roll_rows: int, mode: str):
    name = f"err_{channel}_{_stamp()}"
    writer = letters.write.mode(mode).option("maxRecordsPerFile", str(roll_rows))
    return writer.option("mapreduce.output.basename", name)


def write_dead_letters(letters: DataFrame, path: str, channel: str, roll_rows: int = ROLL_ROWS) -> None:
    """Append dead letters as text, one folder per class and files of at most ``roll_rows`` lines.

    File names start with ``err_<channel>_<yyyyMMddHHmmss>``.
    """
    _letter_writer(letters, channel, roll_rows, "append").partitionBy("fail_class").text(path)


def write_batch_letters(letters: DataFrame, path: str, channel: str, fail_class: str, batch_id: int,
                        roll_rows: int = ROLL_ROWS) -> None:
    """The dead letters of one class and micro-batch; a replayed batch replaces its own files.

    Time-based rolling is the trigger interval of the stream.
    """
    folder = f"{path}/fail_class={fail_class}/batch={batch_id}"
    _letter_writer(letters.select("value"), channel, roll_rows, "overwrite").text(folder)


def roll_letters(letters: DataFrame, channel: Sequence[str], clock: str, order: str, roll_rows: int = ROLL_ROWS,
                 seconds: int = ROLL_SECONDS, staging: Staging | None = None) -> DataFrame:
    """Add the number of the file each letter belongs to, counted from one roll to the next, per channel.

    A file is full with the letter that makes it ``roll_rows`` long, or that comes at least ``seconds`` after
    the file before it was full; the clock of the first starts with the first letter.  ``order`` must have no ties
    within a channel.
    """
    rolls = count_or_time(letters, channel, clock, order, roll_rows, seconds, staging=staging)
    rolls = rolls.select(*channel, order, F.col("batch").alias("roll"))
    return null_safe_join(letters, rolls, [*channel, order])


def write_rolled_letters(letters: DataFrame, path: str, channel: Sequence[str], order: str) -> None:
    """One JSON file per channel and roll, lines in order; every column of a letter is kept.

    A channel with a third of all letters is many rolls, which spread over the tasks.  The channel names the
    folder of a file, the other columns and the roll are in its lines.
    """
    write_rolls(letters, path, channel, order)


def read_rolled_letters(spark: SparkSession, path: str, schema: StructType, channel: Sequence[str]) -> DataFrame:
    """The letters of all files that ``write_rolled_letters`` made."""
    return read_rolls(spark, path, schema, channel)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("fail_class", "value")


def roll_buckets(rows: DataFrame, ts: Column, seconds: int = ROLL_SECONDS,
                 roll_rows: int = ROLL_ROWS) -> DataFrame:
    """Rows and files per roll interval: a new file after ``roll_rows`` rows or ``seconds``."""
    bucket = F.floor(F.unix_timestamp(ts) / seconds) * seconds
    counts = rows.groupBy(bucket.alias("bucket_start")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("n_files", F.ceil(F.col("n_rows") / roll_rows))


def skip_manifest(spark: SparkSession, path: str, rule: str, recursive: bool = False) -> DataFrame:
    """Files of a spool directory that no rule wants; they are listed, not opened."""
    return route(list_files(spark, path, recursive), rule)[1]


def write_outcomes(dealt: DataFrame, success: str | None = None, failed: str | None = None) -> None:
    """Append successes and failures to their tables; the input is evaluated once."""
    dealt = dealt.persist()
    try:
        good, bad = split_outcomes(dealt)
        if success:
            good.write.mode("append").parquet(success)
        if failed:
            bad.write.mode("append").parquet(failed)
    finally:
        dealt.unpersist()


Handler = Callable[[DataFrame, int], None]


def outcome_handlers(on_success: Handler | None = None, on_fail: Handler | None = None) -> Handler:
    """One ``foreachBatch`` function that feeds a success and a fail handler."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_outcomes(batch)
            if on_success:
                on_success(good, batch_id)
            if on_fail:
                on_fail(bad, batch_id)
        finally:
            batch.unpersist()

    return handle
