"""Offset progress and lag per (topic, partition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a partition counts as lagging above this many messages.
LAG_LIMIT = 100

PARTITION_KEY = ["topic", "partition"]


def last_ok_offset(messages: DataFrame, ok: Column) -> DataFrame:
    """Last successfully handled offset; failures do not advance it, a later success does."""
    return messages.groupBy(*PARTITION_KEY).agg(F.max(F.when(ok, F.col("offset"))).alias("offset_commit"))


def newest_offset(messages: DataFrame) -> DataFrame:
    """The offset the next message will get."""
    return messages.groupBy(*PARTITION_KEY).agg((F.max("offset") + 1).alias("offset_newest"))


def progress(messages: DataFrame, ok: Column) -> DataFrame:
    """Committed and newest offset from one pass over the messages (nothing handled: 0)."""
    return messages.groupBy(*PARTITION_KEY).agg(
        F.coalesce(F.max(F.when(ok, F.col("offset"))), F.lit(0).cast("bigint")).alias("offset_commit"),
        (F.max("offset") + 1).alias("offset_newest"),
    )


def join_progress(newest: DataFrame, commits: DataFrame) -> DataFrame:
    """Put the two offsets side by side when they come from different places."""
    joined = newest.join(commits, PARTITION_KEY, "left")
    return joined.withColumn("offset_commit", F.coalesce("offset_commit", F.lit(0).cast("bigint")))


def lag_report(offsets: DataFrame, limit: int = LAG_LIMIT) -> DataFrame:
    """Lag, pending messages and an over-limit flag for each row of an offset table.

    The committed offset is the last one handled and the newest is the next one to come, so ``lag``
    is one above the number of messages that wait; ``pending`` is that number.
    """
    lag = F.col("offset_newest") - F.col("offset_commit")
    return offsets.select(
        *PARTITION_KEY, "offset_commit", "offset_newest",
        lag.alias("lag"), (lag - 1).alias("pending"), (lag > limit).alias("over"),
    )


def worker_load(allotment: DataFrame, lags: DataFrame, workers: DataFrame | None = None) -> DataFrame:
    """Partitions and total lag per worker; a partition without a lag counts with lag 0.

    With ``workers`` the ones that have no partition are listed too.
    """
    known = lags.select(*[F.col(c).alias(f"__{c}") for c in PARTITION_KEY], "lag")
    same = (F.col("topic") == F.col("__topic")) & (F.col("partition") == F.col("__partition"))
    load = (
        allotment.select("worker", *PARTITION_KEY).join(known, same, "left")
        .groupBy("worker")
        .agg(F.count(F.lit(1)).alias("n_partitions"), F.coalesce(F.sum("lag"), F.lit(0)).alias("total_lag"))
    )
    if workers is None:
        return load
    load = load.withColumnRenamed("worker", "__worker")
    return workers.select("worker").distinct().join(load, F.col("worker") == F.col("__worker"), "left").select(
        "worker", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_partitions", "total_lag")])


def first_registrant(candidates: DataFrame, candidate: str, order_by: list[str], *group_by: str) -> DataFrame:
    """The earliest candidate per group.

    The smallest first order value comes from a hash aggregate over plain columns; only the rows that
    have it, few per group, go through the tie-break.
    """
    first = candidates.groupBy(*group_by).agg(F.min(order_by[0]).alias("__first"))
    first = first.select(*[F.col(g).alias(f"__g_{g}") for g in group_by], "__first")
    same = F.col(order_by[0]).eqNullSafe(F.col("__first"))
    for g in group_by:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return candidates.join(first, same, "left_semi").groupBy(*group_by).agg(
        F.min_by(F.col(candidate), F.struct(*order_by)).alias(candidate)
    )
