"""Structured Streaming flows: file ingest, message dealing, offset progress, re-allotment.

Each flow is the batch operator applied to a stream; what is stateful or has several outputs goes
through ``foreachBatch``.  The checkpoint is the source of truth for progress, so a restart
resumes; the outputs are appended under the batch number, so a replayed batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import allot, lag
from millrace.operators.records import parse_lines, record_line, split_rejects, to_payload
from millrace.plans.channels import Channel, Sink
from millrace.sinks.outputs import (
    PARSE, SEND, dead_letters, kafka_write_options, skip_manifest, write_batch_letters, write_queue,
)
from millrace.sources.spool import clean_options, name_matches, number_lines, stream_lines
from millrace.staging import Staging, batch_folders, delete, exists, move_file

Writer = Callable[[DataFrame, int], None]

# faults of the program, not of a queue that can't be reached: they stop the stream
FAULTS = (AnalysisException, AttributeError, NameError, TypeError)


def batch_table(path: str) -> Writer:
    """Append-only table with one folder per micro-batch; a replay overwrites its own folder."""

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def start(stream: DataFrame, handle: Writer, checkpoint: str, every: str | None = None,
          mode: str = "append") -> StreamingQuery:
    """Start a flow; without an interval it takes what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(handle).start()


def run_to_end(stream: DataFrame, handle: Writer, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available and wait for it."""
    start(stream, handle, checkpoint, mode=mode).awaitTermination()


def ingest_lines(spark: SparkSession, channel: Channel, max_files: int | None = None) -> DataFrame:
    """The parsed stream of a channel's spool directory: position, record columns, reject reason."""
    source = channel.source
    lines = stream_lines(spark, source.directory, source.name_rule, max_files=max_files)
    return parse_lines(lines, source.schema(), source.separator)


def channel_sender(sink: Sink) -> Writer:
    """Where a channel sends its payloads: its queue topic when one is named, else its table."""
    if sink.servers and sink.topic:
        options = kafka_write_options(sink.servers, sink.topic)
        return lambda frame, batch_id: write_queue(frame, options)
    if sink.table:
        return batch_table(sink.table)
    raise ValueError("the sink names neither a queue topic nor a table")


def record_skipped(spark: SparkSession, channel: Channel, others: Iterable[Channel] = (),
                   aside: str | None = None) -> None:
    """Append the files that no channel wants to the table at the channel's skip path, once each.

    ``others`` are the channels that share the directory.  With ``aside`` the files move there after
    their row is written.
    """
    manifest = skip_manifest(spark, channel.source.directory, channel.source.name_rule)
    for other in others:
        if other.source.directory == channel.source.directory:
            manifest = manifest.where(~name_matches(F.col("file_name"), other.source.name_rule))
    path = channel.sink.skip_path
    if exists(spark, path):
        known = spark.read.parquet(path).select(F.col("file_path").alias("__path"), F.col("modified").alias("__at"))
        seen = (F.col("file_path") == F.col("__path")) & (F.col("modified") == F.col("__at"))
        manifest = manifest.join(known, seen, "left_anti")
    with Staging(spark) as staging:
        new = staging.keep(manifest, "skipped")
        new.write.mode("append").parquet(path)
        if aside:
            for row in new.select("file_path").toLocalIterator():
                move_file(spark, row["file_path"], aside)


class IngestedFiles:
    """The files that a channel's micro-batches read, removed once their batch is committed.

    Every batch notes its files before it writes anything.  They are deleted or archived when a later
    batch starts or the run ends, so a batch that has to be replayed still finds them, and a file
    that the channel never read is never touched.
    """

    def __init__(self, spark: SparkSession, channel: Channel, folder: str, archive: str | None = None):
        self.policy = clean_options(channel.source.delete_policy, archive)["cleanSource"]
        self.spark, self.folder, self.archive = spark, folder, archive

    def note(self, batch: DataFrame, batch_id: int) -> None:
        if self.policy != "off":
            batch.select("file_path").distinct().write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def settle(self, before: int | None = None) -> None:
        """Clean up after the batches below ``before`` (all, without it), which must be committed."""
        if self.policy == "off" or not exists(self.spark, self.folder):
            return
        for batch_id, folder in batch_folders(self.spark, self.folder):
            if before is None or batch_id < before:
                for row in self.spark.read.parquet(folder).toLocalIterator():
                    move_file(self.spark, row["file_path"], self.archive)
                delete(self.spark, folder)


def ingest(spark: SparkSession, channel: Channel, checkpoint: str, max_files: int | None = None,
           archive: str | None = None, send: Writer | None = None) -> None:
    """Ingest what is there, then clean up after it as the channel's policy says."""
    files = IngestedFiles(spark, channel, f"{checkpoint}/ingested", archive)
    run_to_end(ingest_lines(spark, channel, max_files), ingest_writer(channel, send, files), checkpoint)
    files.settle()


def ingest_writer(channel: Channel, send: Writer | None = None, files: IngestedFiles | None = None) -> Writer:
    """Number the parsed lines of a micro-batch and write the outputs of its channel."""
    send = send or channel_sender(channel.sink)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if files:
            files.settle(before=batch_id)
            files.note(batch, batch_id)
        with Staging(batch.sparkSession) as staging:
            # numbering writes the parsed lines once, so all outputs read that table
            write_outcomes(channel, number_lines(batch, staging), batch_id, send)

    return handle


def write_outcomes(channel: Channel, parsed: DataFrame, batch_id: int, send: Writer | None = None) -> None:
    """Send the good records of numbered lines as payloads and write the two classes of dead letters.

    When sending fails, the records of the micro-batch go to the ``send`` dead letters as delimited
    lines.  Faults of the sender's own code are raised.
    """
    sink, source = channel.sink, channel.source
    send = send or channel_sender(sink)
    good, rejected = split_rejects(parsed)
    columns = ["file_name", "line_num", *source.schema().names]
    if sink.fail_path:
        write_batch_letters(dead_letters(rejected, "value", PARSE), sink.fail_path, channel.name, PARSE, batch_id)
    payloads = good.select(*columns, to_payload(columns).alias("value"))
    try:
        send(payloads, batch_id)
    except FAULTS:
        raise
    except Exception:
        if not sink.fail_path:
            raise
        line = record_line(source.schema().names, source.separator)
        write_batch_letters(dead_letters(good, line, SEND), sink.fail_path, channel.name, SEND, batch_id)


def offset_progress(messages: DataFrame, ok: Column) -> DataFrame:
    """Running last-ok and newest offset per partition.

    The state has one row per topic partition.  Use complete mode, so that every micro-batch
    writes the whole table and readers need the newest batch only.
    """
    return lag.progress(messages, ok)


def newest_batch(spark: SparkSession, path: str) -> DataFrame:
    """What the last micro-batch wrote with ``batch_table``; older folders are listed, not read."""
    return spark.read.parquet(max(batch_folders(spark, path))[1])


def reallot_writer(current: Callable[[], DataFrame], publish: Writer,
                   changes: Writer | None = None, limit: int = lag.LAG_LIMIT) -> Writer:
    """Per micro-batch of ``offset_progress``: check the lag and re-allot when the guards say so.

    ``current`` reads the allotment in force; ``publish`` writes a new one and ``changes`` the rows
    that were added or removed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with Staging(spark) as staging:
            report = lag.lag_report(batch, limit)
            before = current()
            changed, after = allot.rebalance(report, before, limit, staging=staging)
            if changed:
                publish(after, batch_id)
                if changes:
                    changes(allot.table_diff(before.select(*after.columns), after), batch_id)

    return handle
