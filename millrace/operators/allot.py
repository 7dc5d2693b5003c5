"""Handing out topic partitions to workers, and comparing allotments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lag import LAG_LIMIT, PARTITION_KEY
from millrace.operators.numbering import dense_index, index_and_count
from millrace.staging import Staging


def _hand_out(items: DataFrame, workers: DataFrame, slot: Callable[[Column, int], Column],
              staging: Staging) -> DataFrame:
    """Give the item at ``row_index`` to the worker (sorted by name) that ``slot`` names."""
    seats, n_workers = index_and_count(workers.select("worker"), ["worker"], "__seat", staging)
    if n_workers == 0:
        raise ValueError("no workers to hand out partitions to")
    placed = items.withColumn("__seat", slot(F.col("row_index"), n_workers))
    return placed.join(seats, "__seat").select("worker", *PARTITION_KEY)


def round_robin(items: DataFrame, workers: DataFrame, staging: Staging | None = None) -> DataFrame:
    """``(worker, topic, partition)``: the i-th partition goes to worker ``i mod n``."""
    staging = staging or Staging(items.sparkSession)
    indexed = dense_index(items.select(*PARTITION_KEY), PARTITION_KEY, staging=staging)
    return _hand_out(indexed, workers, lambda i, n: i % n, staging)


def _snake_slot(index: Column, n: int) -> Column:
    step = index % (2 * n)
    return F.least(step, F.lit(2 * n - 1) - step)


def snake(lags: DataFrame, workers: DataFrame, ascending: bool = False,
          staging: Staging | None = None) -> DataFrame:
    """Hand out partitions by lag, walking the workers forth and back: 0 1 2 2 1 0 0 1 …

    The largest lag goes first (``ascending`` turns that round); ties go by topic and partition.
    """
    staging = staging or Staging(lags.sparkSession)
    by_lag = F.col("lag").asc() if ascending else F.col("lag").desc()
    indexed = dense_index(
        lags.select(*PARTITION_KEY, "lag"), [by_lag, *PARTITION_KEY], staging=staging
    )
    return _hand_out(indexed, workers, _snake_slot, staging)


def rebalance(lags: DataFrame, current: DataFrame, limit: int = LAG_LIMIT, ascending: bool = False,
              staging: Staging | None = None) -> tuple[bool, DataFrame]:
    """``(changed, allotment)``.

    The current allotment stays when there are as many workers as partitions, or when no partition
    lags above the limit.  The guards need three numbers, taken from one-row aggregates.
    """
    staging = staging or Staging(lags.sparkSession)
    lags = staging.keep(lags.select(*PARTITION_KEY, "lag"), "lags")
    workers = staging.keep(current.select("worker").distinct(), "workers")
    facts = lags.agg(F.count(F.lit(1)).alias("items"), F.max("lag").alias("worst")).first()
    settled = facts["items"] == workers.count()
    if settled or facts["worst"] is None or facts["worst"] <= limit:
        return False, current.select("worker", *PARTITION_KEY)
    return True, snake(lags, workers, ascending, staging)


def route_to_worker(messages: DataFrame, allotment: DataFrame) -> DataFrame:
    """Attach the worker that owns each message's partition.

    No hint: an allotment read from a table is broadcast when its measured size allows it, and
    otherwise a skewed partition is split by adaptive execution.
    """
    return messages.join(allotment, PARTITION_KEY)


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset difference with a ``change`` column: ``added`` or ``removed`` rows.

    One shuffle: both sides are counted with opposite signs and the remainder is repeated as often
    as it is in surplus.
    """
    names = old.columns
    signed = new.select(*names, F.lit(1).alias("__n")).unionByName(
        old.select(*names, F.lit(-1).alias("__n"))
    )
    surplus = signed.groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return surplus.select(
        *names,
        F.when(F.col("__n") > 0, "added").otherwise("removed").alias("change"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("__n"))).alias("__copy"),
    ).drop("__copy")


def changed_workers(old: DataFrame, new: DataFrame) -> bool:
    """Whether the worker set differs; an empty new set never counts as a change."""
    if new.isEmpty():
        return False
    return not table_diff(old.select("worker"), new.select("worker")).isEmpty()
