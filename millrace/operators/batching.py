"""Count-or-time batches per key, exact and without running a whole key in one task.

A batch closes on the arrival that makes it ``max_rows`` long, or that comes at least ``max_wait``
seconds after the previous close.  The clock of the first batch starts at the key's first message.
The messages after the last close form an open batch.

The close of a batch that starts at position s depends only on s: the previous close was the
arrival at s - 1.  At any cut of the key's positions the open batch started at one of the last
``max_rows`` positions, so a segment between two cuts is a function from at most ``max_rows``
entry positions to exit positions.  That gives three steps:

1. every segment, in parallel, maps each possible entry to its exit and the batches closed on the way;
2. those small maps are chained: blocks of segments are composed in parallel to maps of their own,
   until one block per key is left, and the real entries are then handed back down;
3. every segment, in parallel, replays its rows from the one entry that is real.

A group handed to Python holds ``segment_rows`` + ``max_rows`` rows, or ``max_rows`` map rows for
each of ``block_segments`` segments (a million by default), at most - whatever the key's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.numbering import dense_index
from millrace.staging import Staging

# The default batch length and wait in seconds.
BATCH_ROWS, BATCH_WAIT = 30, 3
BLOCK_ENTRIES = 1_000_000  # map rows of a block of segments


def _closes(clock: np.ndarray, starts: np.ndarray, max_rows: int, max_wait: int) -> np.ndarray:
    """Index of the arrival that closes a batch starting at each index (len(clock) or more: open)."""
    last_close = clock[np.maximum(starts - 1, 0)]
    by_time = np.maximum(np.searchsorted(clock, last_close + max_wait, side="left"), starts)
    return np.minimum(starts + max_rows - 1, by_time)


def _segment_map(clock: np.ndarray, own: int, max_rows: int, max_wait: int) -> list[tuple[int, int, int]]:
    """``(entry, exit, closed)`` for every index a batch open at ``own`` may have started at.

    ``clock`` is the halo (before ``own``) followed by the segment's own rows.
    """
    size = len(clock)
    first = own - max_rows + 1 if own else 0
    entries = range(max(first, 1) if own else 0, own + 1)
    following = _closes(clock, np.arange(size), max_rows, max_wait) + 1
    known: dict[int, tuple[int, int]] = {}
    for entry in entries:
        path, at = [], entry
        while at not in known:
            if at >= size or following[at] > size:
                known[at] = (at, 0)
                break
            path.append(at)
            at = int(following[at])
        end, closed = known[at]
        for step in reversed(path):
            closed += 1
            known[step] = (end, closed)
    return [(entry, *known[entry]) for entry in entries]


def _batch_numbers(clock: np.ndarray, own: int, entry: int, base: int, max_rows: int,
                   max_wait: int) -> np.ndarray:
    """Batch number of each own row, for a segment entered with an open batch at ``entry``."""
    size = len(clock)
    following = _closes(clock, np.arange(size), max_rows, max_wait) + 1
    numbers = np.empty(size, dtype=np.int64)
    at, number = entry, base
    while at < size:
        end = min(int(following[at]), size)
        numbers[at:end] = number
        number += 1
        at = end
    return numbers[own:]


def _walk(pieces: pd.DataFrame, entry: int, base: int) -> list[tuple[int, int, int, int]]:
    """``(segment, entry, base, done)`` along a run of segments entered at ``entry``."""
    steps = {
        (segment, at): (leave, closed)
        for segment, at, leave, closed in pieces[["__segment", "__entry", "__exit", "__closed"]].itertuples(
            index=False, name=None)
    }
    path = []
    for segment in sorted(set(pieces["__segment"])):
        if (segment, entry) not in steps:  # a halo that no rows follow
            break
        leave, closed = steps[segment, entry]
        path.append((segment, entry, base, base + closed))
        entry, base = leave, base + closed
    return path


def _real_entries(maps: DataFrame, key: list[str], key_ddl: str, block_segments: int,
                  staging: Staging) -> DataFrame:
    """``(*key, __segment, __entry, __base, __done)``: where each segment is really entered.

    ``maps`` is a written table of ``(*key, __segment, __entry, __exit, __closed)``.
    """
    found = f"{key_ddl}, __segment long, __entry long, __base long, __done long"

    def rows(group: pd.DataFrame, path: list[tuple], columns: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(path, columns=columns)
        for name in key:
            out[name] = group[name].iat[0]
        return out[[*key, *columns]]

    def from_start(group: pd.DataFrame) -> pd.DataFrame:
        return rows(group, _walk(group, 0, 0), ["__segment", "__entry", "__base", "__done"])

    last = maps.agg(F.max("__segment")).first()[0]
    if last is None or last < block_segments:
        return maps.groupBy(*key).applyInPandas(from_start, found)

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        first = group["__segment"].min()
        leaves = {(s, e): x for s, e, x in group[["__segment", "__entry", "__exit"]].itertuples(index=False, name=None)}
        whole = []
        for entry in group.loc[group["__segment"] == first, "__entry"]:
            segment, at, _, done = _walk(group, entry, 0)[-1]
            whole.append((int(group["__block"].iat[0]), entry, leaves[segment, at], done))
        return rows(group, whole, ["__segment", "__entry", "__exit", "__closed"])

    def from_entry(group: pd.DataFrame) -> pd.DataFrame:
        path = _walk(group, int(group["__at"].iat[0]), int(group["__from"].iat[0]))
        return rows(group, path, ["__segment", "__entry", "__base", "__done"])

    blocked = maps.withColumn("__block", F.floor(F.col("__segment") / block_segments))
    composed = staging.keep(
        blocked.groupBy(*key, "__block").applyInPandas(
            compose, f"{key_ddl}, __segment long, __entry long, __exit long, __closed long"),
        "blocks",
    )
    solved = staging.keep(_real_entries(composed, key, key_ddl, block_segments, staging), "solved")
    given = solved.select(
        *key, F.col("__segment").alias("__block"), F.col("__entry").alias("__at"), F.col("__base").alias("__from"))
    met = null_safe_join(blocked, given, [*key, "__block"])
    return met.groupBy(*key, "__block").applyInPandas(from_entry, found)


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on equal names, where NULL equals NULL."""
    other = right.select(*[F.col(n).alias(f"__r_{n}") if n in names else F.col(n) for n in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names])
    return left.join(other, same).drop(*[f"__r_{n}" for n in names])


def count_or_time(
    messages: DataFrame,
    key: Sequence[str] = ("topic", "partition"),
    clock: str = "clock",
    order: str = "offset",
    max_rows: int = BATCH_ROWS,
    max_wait: int = BATCH_WAIT,
    segment_rows: int = 500_000,
    block_segments: int | None = None,
    staging: Staging | None = None,
) -> DataFrame:
    """``(*key, order, clock, batch, closed)`` for every message.

    ``clock`` holds whole seconds; messages arrive in the order (clock, order).
    """
    # a block holds a map row per segment and possible entry: bounded whatever the batch size
    block_segments = block_segments or max(2, min(1000, BLOCK_ENTRIES // max(1, max_rows)))
    if max_rows < 1 or segment_rows <= max_rows or block_segments < 2:
        raise ValueError("need 1 <= max_rows < segment_rows and at least 2 segments in a block")
    staging = staging or Staging(messages.sparkSession)
    key = list(key)
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    rows = dense_index(
        messages.select(*key, F.col(clock).cast("bigint").alias("__clock"), F.col(order).alias("__order")),
        ["__clock", "__order"], key, "__pos", staging,
    )
    segment = F.expr(f"__pos div {segment_rows}")
    in_halo = F.col("__pos") % segment_rows >= segment_rows - max_rows
    pieces = rows.select(
        *key, "__clock", "__order", "__pos",
        F.explode(
            F.when(in_halo, F.array(segment, segment + 1)).otherwise(F.array(segment))
        ).alias("__segment"),
    )

    def place(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int, int]:
        group = group.sort_values("__pos")
        first = int(group["__pos"].iat[0])
        cut = int(group["__segment"].iat[0]) * segment_rows
        return group, group["__clock"].to_numpy(), cut - first, first

    def transfer(group: pd.DataFrame) -> pd.DataFrame:
        group, times, own, first = place(group)
        out = pd.DataFrame(
            [(e + first, x + first, n) for e, x, n in _segment_map(times, own, max_rows, max_wait)],
            columns=["__entry", "__exit", "__closed"],
        )
        for name in [*key, "__segment"]:
            out[name] = group[name].iat[0]
        return out[[*key, "__segment", "__entry", "__exit", "__closed"]]

    maps = pieces.select(*key, "__segment", "__pos", "__clock").groupBy(*key, "__segment").applyInPandas(
        transfer, f"{key_ddl}, __segment long, __entry long, __exit long, __closed long"
    )

    entries = staging.keep(
        _real_entries(staging.keep(maps, "maps"), key, key_ddl, block_segments, staging), "entries")
    totals = entries.groupBy(*key).agg(F.max("__done").alias("__total"))
    entered = staging.keep(null_safe_join(entries.drop("__done"), totals, key), "entered")

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group, times, own, first = place(group)
        numbers = _batch_numbers(
            times, own, int(group["__entry"].iat[0]) - first, int(group["__base"].iat[0]),
            max_rows, max_wait,
        )
        mine = group.iloc[own:]
        closed = numbers < group["__total"].iat[0]
        return mine.assign(batch=numbers, closed=closed)[[*key, "__order", "__clock", "batch", "closed"]]

    batches = (
        null_safe_join(pieces, entered, [*key, "__segment"])
        .groupBy(*key, "__segment")
        .applyInPandas(replay, f"{key_ddl}, __order {kinds[order]}, __clock long, batch long, closed boolean")
    )
    return batches.select(
        *key, F.col("__order").alias(order), F.col("__clock").alias(clock), "batch", "closed")


def batch_summary(batched: DataFrame, key: Sequence[str] = ("topic", "partition"),
                  order: str = "offset") -> DataFrame:
    """One row per batch: first and last offset, length, and whether it was closed."""
    return batched.groupBy(*key, "batch", "closed").agg(
        F.min(order).alias("first_offset"),
        F.max(order).alias("last_offset"),
        F.count(F.lit(1)).alias("n_rows"),
    )
