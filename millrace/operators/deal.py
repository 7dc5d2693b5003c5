"""User functions on messages, with a success tag, a result and an error for each message."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME = "deal_tag boolean, result binary, error string"

DealFunction = Callable[[bytes], bytes]
BatchFunction = Callable[[Sequence[bytes]], Sequence["bytes | Exception"]]
Outcome = tuple[bool, bytes | None, str | None]


def _attach(messages: DataFrame, outcome: Column) -> DataFrame:
    """Call the function once per message: callers mark it as not deterministic, so that a filter on
    the outcome is not pushed below it, which would call it again on other batches."""
    kept = [c for c in messages.columns if c not in ("deal_tag", "result", "error")]
    return messages.select(*kept, outcome.alias("__o")).select(*kept, "__o.*")


def deal_native(messages: DataFrame, result: Column) -> DataFrame:
    """A function written as a column expression; NULL means the message failed."""
    kept = [c for c in messages.columns if c not in ("deal_tag", "result", "error")]
    answered = messages.select(*kept, result.alias("__r"))  # evaluated once, used three times below
    return answered.select(
        *kept,
        F.col("__r").isNotNull().alias("deal_tag"),
        F.col("__r").alias("result"),
        F.when(F.col("__r").isNull(), F.lit("no result")).alias("error"),
    )


def deal_each(messages: DataFrame, function: DealFunction, value: str = "value") -> DataFrame:
    """One call per message.  An exception tags that message as failed and nothing else.

    Only the payload column travels to Python, in Arrow batches.
    """

    @F.pandas_udf(OUTCOME)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in values:
            outcomes = []
            for payload in payloads:
                try:
                    outcomes.append((True, function(payload), None))
                except Exception as problem:  # the user function may fail in any way
                    outcomes.append((False, None, str(problem)))
            yield pd.DataFrame(outcomes, columns=["deal_tag", "result", "error"])

    return _attach(messages, run.asNondeterministic()(F.col(value)))


def deal_batches(messages: DataFrame, function: BatchFunction, batch_rows: int = 30,
                 value: str = "value") -> DataFrame:
    """One call per batch of at most ``batch_rows`` messages.

    The function answers each message with bytes or an exception; when the call itself raises,
    every message of the batch has failed.
    """

    @F.pandas_udf(OUTCOME)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in values:
            outcomes = []
            for start in range(0, len(payloads), batch_rows):
                outcomes += call_batch(function, list(payloads.iloc[start:start + batch_rows]))
            yield pd.DataFrame(outcomes, columns=["deal_tag", "result", "error"])

    return _attach(messages, run.asNondeterministic()(F.col(value)))


def call_batch(function: BatchFunction, payloads: list[bytes]) -> list[Outcome]:
    """The outcome of every message of one call; a call that raises fails all of them."""
    try:
        answers = list(function(payloads))
        if len(answers) != len(payloads):
            raise ValueError(f"{len(answers)} answers for {len(payloads)} messages")
    except Exception as problem:  # the user function may fail in any way
        answers = [problem] * len(payloads)
    return [(False, None, str(a)) if isinstance(a, Exception) else (True, a, None) for a in answers]


def deal_runs(messages: DataFrame, function: BatchFunction, group: Sequence[str], order: Sequence[str],
              value: str = "value") -> DataFrame:
    """One call per group, with the payloads of the group in order.

    Groups are batches that were numbered before (``batching.count_or_time``), so they are small; a
    topic partition with a third of all messages is many groups and spreads over tasks.  A task
    reads its sorted groups as a stream and holds one of them and an Arrow batch.
    """
    kept = [c for c in messages.columns if c not in ("deal_tag", "result", "error")]
    placed = messages.select(*kept).repartition(*group).sortWithinPartitions(*group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

    def dealt(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tags, results, errors = zip(*call_batch(function, rows.column(value).to_pylist()))
        rows = rows.append_column("deal_tag", pa.array(tags, pa.bool_())).append_column(
            "result", pa.array(results, pa.binary())).append_column("error", pa.array(errors, pa.string()))
        yield from rows.combine_chunks().to_batches()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group that may go on
        last = None
        for batch in stream:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group)))
            start = 0
            for at, key in enumerate(keys):
                if key != last and (held or at > start):
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    yield from dealt(pa.Table.from_batches(held))
                    held, start = [], at
                last = key
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from dealt(pa.Table.from_batches(held))

    return placed.mapInArrow(run, f"{schema}, {OUTCOME}")


def split_outcomes(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(success, failed)`` rows; an untagged message counts as failed."""
    ok = F.coalesce("deal_tag", F.lit(False))
    return dealt.where(ok), dealt.where(~ok)


def deal_summary(dealt: DataFrame, amount: Column) -> DataFrame:
    """Messages and an exact total per outcome."""
    return dealt.groupBy(F.coalesce("deal_tag", F.lit(False)).alias("deal_tag")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(amount).alias("total")
    )


def run_summary(dealt: DataFrame, group: Sequence[str], order: str = "offset") -> DataFrame:
    """First and last offset, messages and failed messages of every batch."""
    return dealt.groupBy(*group).agg(
        F.min(order).alias("first_offset"), F.max(order).alias("last_offset"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.coalesce("deal_tag", F.lit(False))).alias("n_failed"))
