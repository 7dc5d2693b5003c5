"""Writes with a commit every N rows, and an outcome for every record.

Rows get dense chunk numbers in a given order, and a chunk lies in one task, whole and sorted.  The task
hands it to a sender in one call and then commits it: one file per chunk, moved to its final name in one
step, that holds the rows of the chunk and what became of each.  That file is data, outcome and ledger:

* an error in the sender rolls back the open chunk only; chunks before it stay committed;
* a task that is tried again, and a second call with the same ``run``, skip the chunks that are committed;
* a record that the sender refuses comes back as a row with its error, the others of its chunk are committed.

Nothing of a chunk goes through the driver; commit messages carry counts.  A sender is called once for a
chunk unless a task dies after the call and before the move, or is run twice at a time (speculation): then
it is called again with the same rows, run and chunk number, by which a receiver can tell them apart.

Workers write through ``pyarrow.fs``, so the folder is a mounted one or has a scheme that pyarrow knows.

Defined results: an empty table commits no chunk; repeated rows are records like others (but ``order_by`` must
have no ties, or a second run may cut the chunks elsewhere); NULL values are sent as they are.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructType

from millrace.operators.numbering import chunk_number
from millrace.session import ship
from millrace.staging import Staging

COMMIT_ROWS = 500
RUN, CHUNK, STATE, ERROR = "run", "chunk", "state", "error"
SENT, REFUSED, ROLLED_BACK = "sent", "refused", "rolled_back"

# takes run, chunk number and rows; returns nothing, or one error or None per row
Sender = Callable[[str, int, pa.Table], Sequence[str | None] | None]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Counts(WriterCommitMessage):
    """What one task did, in chunks and rows."""

    committed: int = 0
    skipped: int = 0
    rolled_back: int = 0
    sent: int = 0
    refused: int = 0

    def __add__(self, other: Counts) -> Counts:
        return Counts(*(a + b for a, b in zip(asdict(self).values(), asdict(other).values())))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole chunks of batches that come sorted by chunk; at most one chunk and one batch is held."""
    held: list[pa.RecordBatch] = []
    open_chunk = None
    for batch in batches:
        numbers = batch.column(CHUNK).to_numpy()
        start = 0
        while start < len(numbers):
            end = start + int((numbers[start:] == numbers[start]).sum())
            if open_chunk is not None and numbers[start] != open_chunk:
                yield open_chunk, pa.Table.from_batches(held)
                held = []
            open_chunk = int(numbers[start])
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield open_chunk, pa.Table.from_batches(held)


class _ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], options["run"]
        self.go_on = options["on_error"] == "go_on"
        self.sender = options["sender"]

    def _file(self, chunk: int, ending: str) -> str:
        return f"run={self.run}/chunk-{chunk:015d}.{ending}"

    def _put(self, files, root: str, name: str, rows: pa.Table, states: list[str], errors: list[str | None]) -> None:
        """All of a chunk in one file, under another name until it is whole."""
        rows = rows.append_column(STATE, pa.array(states, pa.string())).append_column(ERROR, pa.array(errors, pa.string()))
        draft = f"{root}/_drafts/{uuid.uuid4().hex}"
        pq.write_table(rows, draft, filesystem=files, compression="zstd")
        files.move(draft, f"{root}/{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Counts:
        send: Sender | None = cloudpickle.loads(base64.b64decode(self.sender)) if self.sender else None
        files, root = _file_system(self.path)
        counts = Counts()
        for chunk, rows in _cut(iterator):
            done, back = self._file(chunk, "done.parquet"), self._file(chunk, "back.parquet")
            known = files.get_file_info([f"{root}/{done}", f"{root}/{back}"])
            if known[0].type != fs.FileType.NotFound:
                counts.skipped += 1
                continue
            try:
                errors = list(send(self.run, chunk, rows.drop_columns([CHUNK])) or ()) if send else []
                errors = errors or [None] * rows.num_rows
                if len(errors) != rows.num_rows:
                    raise ValueError(f"{len(errors)} outcomes for {rows.num_rows} records")
            except Exception as error:
                if not self.go_on:
                    raise
                self._put(files, root, back, rows, [ROLLED_BACK] * rows.num_rows,
                          [f"{type(error).__name__}: {error}"] * rows.num_rows)
                counts.rolled_back += 1
                continue
            self._put(files, root, done, rows, [SENT if e is None else REFUSED for e in errors], errors)
            if known[1].type != fs.FileType.NotFound:
                files.delete_file(f"{root}/{back}")  # an earlier run had to roll it back
            refused = sum(e is not None for e in errors)
            counts += Counts(committed=1, sent=rows.num_rows - refused, refused=refused)
        return counts

    def commit(self, messages) -> None:
        """All tasks are done: note the sums of this call."""
        files, root = _file_system(self.path)
        total = sum((m for m in messages if m is not None), Counts())
        with files.open_output_stream(f"{root}/_runs/{self.run}.json") as out:
            out.write(json.dumps(asdict(total)).encode())

    def abort(self, messages) -> None:
        """Committed chunks stay; the next call with this run goes on behind them."""


class ChunkSource(DataSource):
    """The write side of ``write_chunks``; its rows have to be sorted by chunk, a chunk in one task."""

    @classmethod
    def name(cls) -> str:
        return "millrace_chunks"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("chunks are only appended")
        return _ChunkWriter(dict(self.options))


def write_chunks(df: DataFrame, path: str, run: str, order_by: Sequence[str | Column], size: int = COMMIT_ROWS,
                 sender: Sender | None = None, on_error: str = "stop", staging: Staging | None = None) -> dict[str, int]:
    """Send ``df`` in chunks of ``size`` rows in the given order (without ties) and commit each by itself.

    ``on_error="stop"`` fails the job at the first error of the sender; what was committed stays, and another call
    with the same ``run`` and rows goes on.  ``"go_on"`` keeps the rows of such a chunk as rolled back.
    Returns the counts of this call: chunks ``committed``, ``skipped``, ``rolled_back``; rows ``sent``, ``refused``.
    """
    if on_error not in ("stop", "go_on"):
        raise ValueError(f"on_error is stop or go_on, not {on_error!r}")
    if not run or not all(c.isalnum() or c in "-_." for c in run):
        raise ValueError(f"a run is named by letters, digits and -_. only, not {run!r}")
    taken = {RUN, CHUNK, STATE, ERROR} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names of the outcome")
    spark = df.sparkSession
    ship(spark)
    files, root = _file_system(path)
    for folder in (f"run={run}", "_drafts", "_runs"):
        files.create_dir(f"{root}/{folder}", recursive=True)
    spark.dataSource.register(ChunkSource)
    numbered = chunk_number(df, order_by, size, CHUNK, staging)
    keys = [F.col(o) if isinstance(o, str) else o for o in order_by]
    numbered = numbered.repartitionByRange(CHUNK).sortWithinPartitions(CHUNK, *keys)
    packed = base64.b64encode(cloudpickle.dumps(sender)).decode() if sender else ""
    numbered.write.format(ChunkSource.name()).mode("append").options(
        path=path, run=run, on_error=on_error, sender=packed).save()
    with files.open_input_stream(f"{root}/_runs/{run}.json") as told:
        return json.loads(told.read())


def read_outcomes(spark: SparkSession, path: str, schema: StructType, run: str | None = None) -> DataFrame:
    """Every record with its ``chunk``, ``state`` and ``error``; ``schema`` is that of the rows that were sent.

    Of a chunk that was rolled back and committed later only the committed rows are there.
    """
    full = StructType([*schema.fields]).add(CHUNK, LongType())
    for name in (STATE, ERROR, RUN):
        full.add(name, StringType())
    rows = spark.read.schema(full).parquet(path)
    return rows if run is None else rows.where(F.col(RUN) == run)


def batch_sender(path: str, name: str, order_by: Sequence[str | Column], size: int = COMMIT_ROWS,
                 sender: Sender | None = None, on_error: str = "go_on") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a replayed micro-batch sends no chunk again that was committed."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with Staging(batch.sparkSession) as staging:
            write_chunks(batch, path, f"{name}-{batch_id}", order_by, size, sender, on_error, staging)

    return handle
