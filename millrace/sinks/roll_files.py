"""One file per channel and roll, for any number of rolls.

The rows come sorted, a file in one task.  A task writes its files below a hidden folder of this call, each under
another name until it is whole; a file that an earlier attempt of the task has made stays, as it holds the same lines.
Once all tasks are done the folders of the channels are moved into place, so a failed call leaves nothing to readers.
A channel is a folder and a file goes by its roll, so that a listing takes a call a channel and not one a roll.
A reading task opens many files, one after the other.

Workers write through ``pyarrow.fs``, so the folder is a mounted one or has a scheme that pyarrow knows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.session import ship
from millrace.sinks.chunks import _file_system

ROLL, LINE, MARK = "roll", "line", "mark"
TASK_FILES, TASK_BYTES = 4096, 64 << 20  # what a task reads, but one file at least
BATCH_LINES = 4096
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # the folder of NULL, as Spark names it
_ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^\x7f"}


def _folder(names: Sequence[str], values: Sequence[str | None]) -> str:
    """``name=value/...`` as Spark names the folders of partitions."""

    def plain(word: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in word)

    return "/".join(f"{plain(n)}={plain(v) if v else NO_VALUE}" for n, v in zip(names, values))


@dataclass
class Files(WriterCommitMessage):
    """How many files a task wrote."""

    written: int = 0


class _RollWriter(DataSourceArrowWriter):
    """Columns: the values of the channel as text, their mark, the roll, and the line.

    The mark tells channels apart whose values read the same as text, like NULL and the empty text.
    """

    def __init__(self, options: dict[str, str], names: Sequence[str]):
        self.path, self.run, self.names = options["path"], options["run"], list(names)

    def _drafts(self, root: str) -> str:
        return f"{root}/_rolls-{self.run}"

    def _files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
        """Runs of lines that go to one file; a file may take several."""
        for batch in batches:
            *keys, lines = (c.to_pylist() for c in batch.columns)
            at = 0
            for key, own in groupby(zip(*keys)):
                stop = at + sum(1 for _ in own)
                yield key, lines[at:stop]
                at = stop

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        files, root = _file_system(self.path)
        made: dict[str, None] = {}
        counts = Files()
        draft = f"{self._drafts(root)}/_open/{uuid.uuid4().hex}"
        for (*values, mark, roll), runs in groupby(self._files(iterator), key=lambda run: run[0]):
            folder = f"{self._drafts(root)}/{_folder(self.names, values)}"
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made[folder] = None
            with files.open_output_stream(draft, compression=None) as out:
                for _, lines in runs:
                    out.write(("\n".join(lines) + "\n").encode())
            name = f"{folder}/roll-{roll:012d}-{mark}-{self.run}.json"
            try:
                files.move(draft, name)
            except OSError:
                if files.get_file_info(name).type == fs.FileType.NotFound:
                    raise
            counts.written += 1
        return counts

    def commit(self, messages) -> None:
        """All files are there: move the folders of the channels, or their files where a folder exists."""
        files, root = _file_system(self.path)
        files.delete_dir(f"{self._drafts(root)}/_open")
        self._move_into(files, self._drafts(root), root)

    def _move_into(self, files: fs.FileSystem, source: str, target: str) -> None:
        for entry in files.get_file_info(fs.FileSelector(source)):
            place = f"{target}/{entry.base_name}"
            if entry.type == fs.FileType.Directory and files.get_file_info(place).type == fs.FileType.Directory:
                self._move_into(files, entry.path, place)
            else:
                files.move(entry.path, place)

    def abort(self, messages) -> None:
        """The caller drops the folder of the call, also when it fails before its writer is asked."""


class _RollReader(DataSourceReader):
    """Columns: the values of the channel as text, and the line."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.names = options["path"], schema.names

    def partitions(self) -> list[InputPartition]:
        files, root = _file_system(self.path)
        found = [f for f in files.get_file_info(fs.FileSelector(root, recursive=True))
                 if f.type == fs.FileType.File and f.path.endswith(".json")
                 and not any(part.startswith("_rolls-") for part in f.path.removeprefix(root).split("/"))]
        parts, held = [[]], 0
        for file in sorted(found, key=lambda f: f.path):
            if parts[-1] and (len(parts[-1]) == TASK_FILES or held + file.size > TASK_BYTES):
                parts.append([])
                held = 0
            parts[-1].append(file.path)
            held += file.size
        return [InputPartition(part) for part in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(self.path)
        rows: list[tuple] = []
        for path in partition.value:
            values = [v.partition("=")[2] for v in path.split("/")[-len(self.names):-1]]
            values = [None if v == NO_VALUE else unquote(v) for v in values]
            with files.open_input_stream(path, compression=None) as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as lines:
                for line in lines:
                    rows.append((*values, line))
                    if len(rows) == BATCH_LINES:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], self.names)


class RollSource(DataSource):
    """The files of ``write_rolls``; rows to write have to be sorted by file, a file in one task."""

    @classmethod
    def name(cls) -> str:
        return "millrace_rolls"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RollReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("rolls are only appended")
        return _RollWriter(dict(self.options), schema.names[:-3])


def write_rolls(df: DataFrame, path: str, channel: Sequence[str], order: str) -> None:
    """Append one JSON file per ``channel`` and ``roll``, lines in order; the channel names the folder."""
    spark = df.sparkSession
    ship(spark)
    files, root = _file_system(path)
    run = uuid.uuid4().hex
    files.create_dir(f"{root}/_rolls-{run}/_open", recursive=True)
    spark.dataSource.register(RollSource)
    taken = {name.lower() for name in channel}
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]))
    own = [F.col(f"`{c}`") for c in channel]
    group = [*own, F.col(ROLL)]
    mark = F.lower(F.hex(F.xxhash64(*own)))
    rows = df.repartition(*group).sortWithinPartitions(*group, F.col(f"`{order}`")).select(
        *[c.cast("string").alias(n) for c, n in zip(own, channel)], mark.alias(MARK), F.col(ROLL).cast("bigint").alias(ROLL), line.alias(LINE))
    try:
        rows.write.format(RollSource.name()).mode("append").options(path=path, run=run).save()
    finally:
        files.delete_dir(f"{root}/_rolls-{run}")


def read_rolls(spark: SparkSession, path: str, schema: StructType, channel: Sequence[str]) -> DataFrame:
    """The lines of all files with the columns of ``schema``, of which the folders tell those of ``channel``."""
    ship(spark)
    spark.dataSource.register(RollSource)
    taken = {name.lower() for name in channel}
    told = StructType([f for f in schema.fields if f.name.lower() not in taken])
    kinds = ", ".join([*[f"`{c}` string" for c in channel], f"`{LINE}` string"])
    lines = spark.read.format(RollSource.name()).schema(kinds).option("path", path).load()
    lines = lines.select(*[f"`{c}`" for c in channel], F.from_json(LINE, told).alias("__told"))
    return lines.select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name.lower() in taken else F.col(f"__told.`{f.name}`")
        for f in schema.fields])
