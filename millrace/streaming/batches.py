"""Messages of a stream handed to a user function in batches of one topic partition.

A batch closes when it is ``max_rows`` long, or ``max_wait`` seconds after the batch before it closed (the
first clock starts at the partition's first message).  Seconds are the processing time of Spark: they are
looked at when messages arrive, and a timer closes a batch that nothing follows.

What is open lives in keyed state, so it survives a restart from the checkpoint and a lost executor: the
messages of a partition that are in no closed batch yet, fewer than ``max_rows``, and the clock.  A
partition is one key, as order within it demands; partitions are spread over the tasks.

The function is called when a batch closes.  If it raises, that batch has failed and no other.  A
micro-batch that is run again after a failure calls it again for the same batches, with the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.operators.batching import BATCH_ROWS, BATCH_WAIT
from millrace.operators.deal import OUTCOME, BatchFunction, call_batch
from millrace.streaming.flows import Writer, start

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BY_ROWS, BY_TIME = "rows", "time"

_CLOCK = "closed_at long, timer long, next_batch long"


def _plain(value):
    """A cell of a pandas frame as a Python value; gaps are NULL."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


class PartitionBatches(StatefulProcessor):
    """The open batch of every key, closed by count or by time."""

    def __init__(self, function: BatchFunction, key: Sequence[str], schema: StructType, order: str, value: str, max_rows: int, max_wait: float):
        self.function, self.key, self.value = function, list(key), value
        self.fields = [f for f in schema.fields if f.name not in key]
        self.order = [f.name for f in self.fields].index(order)
        self.payload = [f.name for f in self.fields].index(value)
        self.max_rows, self.wait = max_rows, int(max_wait * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", StructType(self.fields))
        self.clock = handle.getValueState("clock", _CLOCK)

    def _closed(self, key: tuple, rows: list[tuple], number: int, why: str) -> pd.DataFrame:
        outcomes = call_batch(self.function, [r[self.payload] for r in rows])
        return pd.DataFrame([(*key, *r, number, why, *o) for r, o in zip(rows, outcomes)],
                            columns=[*self.key, *[f.name for f in self.fields], "deal_batch", "closed_by", "deal_tag", "result", "error"])

    def _keep(self, rows: list[tuple], closed_at: int, timer: int, number: int) -> None:
        """Write the state of a key; its timer goes off when the open batch has waited long enough."""
        due = closed_at + self.wait if rows else 0
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        self.clock.update((closed_at, due, number))
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        names = [f.name for f in self.fields]
        arrived = [tuple(map(_plain, r)) for frame in rows for r in frame[names].itertuples(index=False)]
        arrived.sort(key=lambda r: r[self.order])
        state = self.clock.get()
        closed_at, timer, number = (now, 0, 0) if state is None else state
        waiting = list(map(tuple, self.open.get())) if self.open.exists() else []
        for row in arrived:
            waiting.append(row)
            late = now - closed_at >= self.wait
            if len(waiting) >= self.max_rows or late:
                yield self._closed(key, waiting, number, BY_ROWS if len(waiting) >= self.max_rows else BY_TIME)
                waiting, closed_at, number = [], now, number + 1
        self._keep(waiting, closed_at, timer, number)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, number = self.clock.get()
        waiting = list(map(tuple, self.open.get())) if self.open.exists() else []
        if waiting:
            yield self._closed(key, waiting, number, BY_TIME)
            number += 1
        self._keep([], timerValues.getCurrentProcessingTimeInMs(), 0, number)

    def close(self) -> None:
        pass


def deal_partition_batches(
    messages: DataFrame,
    function: BatchFunction,
    key: Sequence[str] = ("topic", "partition"),
    order: str = "offset",
    value: str = "value",
    max_rows: int = BATCH_ROWS,
    max_wait: float = BATCH_WAIT,
) -> DataFrame:
    """The messages of a stream, once their batch is closed, with its number (``deal_batch``), what closed it, and their outcome.

    ``order`` must grow within a key from micro-batch to micro-batch and have no NULLs.
    """
    if max_rows < 1 or max_wait <= 0:
        raise ValueError("max_rows and max_wait must be positive")
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)  # keyed state needs it
    columns = [*key, *[c for c in messages.columns if c not in key]]
    given = messages.select(*columns)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    processor = PartitionBatches(function, key, given.schema, order, value, max_rows, max_wait)
    return given.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{out}, deal_batch long, closed_by string, {OUTCOME}",
        outputMode="append", timeMode="processingTime")


def run_available(dealt: DataFrame, handle: Writer, checkpoint: str) -> None:
    """Deal what is there and stop; batches that are still open stay in the checkpoint for the next run.

    Batches without new messages are switched off for this query: they only drive timers, and with
    timers registered they would follow each other without end.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    conf = dealt.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "false")
    try:
        running = start(dealt, handle, checkpoint)  # takes the settings as they are now
    finally:
        conf.set(key, before)
    running.awaitTermination()
