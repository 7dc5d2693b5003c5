"""One stream for all channels of a folder.

A folder is listed and its files are read once, whatever the number of channels that take files from
it.  Every file goes to each channel whose rule fits its name; files that no rule wants are never
opened.  The lines of a micro-batch are numbered and written once, and each channel with files in it
reads its own from there.

Every channel notes its progress when its outputs of a micro-batch are written.  A micro-batch that is
replayed, because a later channel failed or the driver was lost, skips the channels that are done.
A channel that joins later gets the files that land from then on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.records import parse_lines
from millrace.plans.channels import Channel
from millrace.sources.spool import name_matches, number_lines, stream_lines
from millrace.staging import Staging, batch_folders, delete, exists
from millrace.streaming.flows import IngestedFiles, Writer, run_to_end, write_outcomes

TAKERS = "__takers"
ORIGIN = "__origin"


def by_folder(channels: Iterable[Channel]) -> dict[str, list[Channel]]:
    """The channels by the directory that they read."""
    folders: dict[str, list[Channel]] = {}
    for channel in channels:
        folders.setdefault(channel.source.directory, []).append(channel)
    return folders


def routed_lines(spark: SparkSession, channels: Sequence[Channel], max_files: int | None = None) -> DataFrame:
    """The lines of all files that some channel wants; ``__takers`` lists the channels by number."""
    folders = by_folder(channels)
    if len(folders) != 1:
        raise ValueError(f"the channels of one stream read one folder, not {sorted(folders)}")
    lines = stream_lines(spark, *folders, max_files=max_files)
    wanted = [name_matches(F.col("file_name"), c.source.name_rule) for c in channels]
    takers = F.concat_ws(",", *[F.when(fits, F.lit(str(i))) for i, fits in enumerate(wanted)])
    # said on its own, so that it reaches the scan as a filter on file metadata
    some = wanted[0]
    for fits in wanted[1:]:
        some = some | fits
    return lines.where(some).select("*", takers.alias(TAKERS), F.col("file_path").alias(ORIGIN))


class Progress:
    """What each channel has written: the newest micro-batch and the lines so far.

    Only the newest note of a channel stays; one that is being replaced is deleted after the new one
    is there, so there is always one to go on from.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _notes(self, channel: Channel) -> list[tuple[int, str]]:
        path = f"{self.folder}/{quote(channel.name, safe='')}"
        return batch_folders(self.spark, path) if exists(self.spark, path) else []

    def done(self, channel: Channel, batch_id: int) -> bool:
        return any(noted == batch_id for noted, _ in self._notes(channel))

    def note(self, channel: Channel, batch_id: int, n_lines: int) -> None:
        before = [(noted, folder) for noted, folder in self._notes(channel) if noted < batch_id]
        known = self.spark.read.parquet(before[-1][1]).first()["total_lines"] if before else 0
        row = self.spark.createDataFrame(
            [(channel.name, batch_id, n_lines, known + n_lines)],
            "channel string, batch bigint, n_lines bigint, total_lines bigint")
        path = f"{self.folder}/{quote(channel.name, safe='')}/batch={batch_id}"
        row.coalesce(1).write.mode("overwrite").parquet(path)
        for _, folder in before:
            delete(self.spark, folder)

    def table(self, channels: Sequence[Channel]) -> DataFrame:
        """``(channel, batch, n_lines, total_lines)`` of the channels that have written anything."""
        newest = [notes[-1][1] for notes in map(self._notes, channels) if notes]
        schema = "channel string, batch bigint, n_lines bigint, total_lines bigint"
        if not newest:
            return self.spark.createDataFrame([], schema)
        # each folder is read as a table of its own, without a column for its place
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*newest)


def folder_writer(channels: Sequence[Channel], progress: Progress, senders: Mapping[str, Writer] | None = None,
                  files: Mapping[str, IngestedFiles] | None = None) -> Writer:
    """Route a micro-batch of ``routed_lines`` to the outputs of its channels."""
    senders, files = senders or {}, files or {}

    def handle(batch: DataFrame, batch_id: int) -> None:
        for kept in files.values():
            kept.settle(before=batch_id)
        with Staging(batch.sparkSession) as staging:
            lines = number_lines(batch, staging)
            # one row per set of channels that share files
            counts = {r[TAKERS]: r["n"] for r in lines.groupBy(TAKERS).agg(F.count(F.lit(1)).alias("n")).collect()}
            for i, channel in enumerate(channels):
                own = [takers for takers in counts if str(i) in takers.split(",")]
                if not own or progress.done(channel, batch_id):
                    continue
                rows = lines.where(F.col(TAKERS).isin(own))
                if channel.name in files:
                    files[channel.name].note(rows.select(F.col(ORIGIN).alias("file_path")), batch_id)
                source = channel.source
                parsed = parse_lines(rows.drop(TAKERS, ORIGIN), source.schema(), source.separator)
                write_outcomes(channel, parsed, batch_id, senders.get(channel.name))
                progress.note(channel, batch_id, sum(counts[takers] for takers in own))

    return handle


def ingest_folder(spark: SparkSession, channels: Sequence[Channel], checkpoint: str, max_files: int | None = None,
                  archive: str | None = None, senders: Mapping[str, Writer] | None = None) -> DataFrame:
    """Ingest what is there for all channels, clean up as their policies say, and return their progress.

    A file that several channels take is cleaned up when one of them says so.
    """
    names = [c.name for c in channels]
    if len(set(names)) < len(names):
        raise ValueError("channels of one stream need names of their own")
    progress = Progress(spark, f"{checkpoint}/channels")
    files = {c.name: IngestedFiles(spark, c, f"{checkpoint}/ingested/{quote(c.name, safe='')}", archive) for c in channels}
    handle = folder_writer(channels, progress, senders, files)
    run_to_end(routed_lines(spark, channels, max_files), handle, checkpoint)
    for kept in files.values():
        kept.settle()
    return progress.table(channels)
