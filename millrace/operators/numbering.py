"""Dense row numbers that never gather one group, or the whole table, in a single task.

``row_number()`` over a window puts every row of a group on one task, which fails when one source
or topic holds a third of the data.  Here the rows are range-partitioned on (group, order) instead,
so a hot group is spread over many tasks; each task numbers its own sorted run and a prefix sum
over the *run lengths* - at most one row per task and group - gives the offset of each run.

The sorted runs are written to the shared folder before they are counted.  Range bounds come from a
sample, so computing them twice could cut the data at different places; the written table makes the
count and the final read agree, also when tasks are retried.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.staging import Staging

_MARK = "__mark"
_RUN = "__run"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above the low 33 bits


def _order(column: str | Column) -> Column:
    return F.col(column).asc() if isinstance(column, str) else column


def _sorted_runs(df: DataFrame, keys: Sequence[Column], staging: Staging) -> DataFrame:
    """Write the table in globally sorted runs, one per task, with consecutive marks in each run."""
    runs = staging.keep(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_MARK, F.monotonically_increasing_id()),
        "runs",
    )
    return runs.withColumn(_RUN, F.shiftright(_MARK, _LOCAL_BITS))


def dense_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    group_by: Sequence[str] = (),
    out: str = "row_index",
    staging: Staging | None = None,
) -> DataFrame:
    """Add a 0-based dense ``out`` per group in the given order (which must have no ties)."""
    staging = staging or Staging(df.sparkSession)
    if not group_by:
        return index_and_count(df, order_by, out, staging)[0]
    keys = [F.col(g).asc() for g in group_by] + [_order(o) for o in order_by]
    runs = _sorted_runs(df, keys, staging)
    return add_run_offsets(runs, group_by, [_RUN], out, staging).drop(_RUN)


def index_and_count(df: DataFrame, order_by: Sequence[str | Column], out: str = "row_index",
                    staging: Staging | None = None) -> tuple[DataFrame, int]:
    """Number a whole table and tell its length.

    The run lengths come to the driver: one row per written task, whatever the number of rows.
    """
    staging = staging or Staging(df.sparkSession)
    runs = _sorted_runs(df, [_order(o) for o in order_by], staging)
    lengths = (
        runs.groupBy(_RUN)
        .agg(F.count(F.lit(1)).alias("n"), F.min(_MARK).alias("first"))
        .orderBy(_RUN)
        .collect()
    )
    starts = [0, *accumulate(row["n"] for row in lengths)]
    shifts = [0] * (lengths[-1][_RUN] + 1 if lengths else 1)
    for row, start in zip(lengths, starts):
        shifts[row[_RUN]] = start - row["first"]
    # a constant array looked up by run, so the rows need no join
    table = F.split(F.lit(",".join(map(str, shifts))), ",").cast("array<bigint>")
    shift = F.get(table, F.col(_RUN).cast("int"))
    return runs.withColumn(out, F.col(_MARK) + shift).drop(_MARK, _RUN), starts[-1]


def add_run_offsets(
    marked: DataFrame,
    group_by: Sequence[str],
    run_keys: Sequence[str],
    out: str,
    staging: Staging,
) -> DataFrame:
    """Number rows whose runs are named by ``run_keys`` (in order) inside each group.

    ``marked`` must be a written table, and the marks must be consecutive within a run.  The table
    of run lengths is written as well, so the planner joins it by its measured size.
    """
    before = (
        Window.partitionBy(*group_by)
        .orderBy(*run_keys)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lengths = marked.groupBy(*group_by, *run_keys).agg(
        F.count(F.lit(1)).alias("__length"), F.min(_MARK).alias("__first")
    )
    offsets = staging.keep(
        lengths.select(
            *group_by,
            *run_keys,
            (F.coalesce(F.sum("__length").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        ),
        "offsets",
    )
    names = [*group_by, *run_keys]
    offsets = offsets.select(*[F.col(n).alias(f"__o_{n}") for n in names], "__shift")
    same = reduce(
        lambda a, b: a & b, [marked[n].eqNullSafe(offsets[f"__o_{n}"]) for n in names]
    )
    return marked.join(offsets, same).withColumn(out, F.col(_MARK) + F.col("__shift")).drop(
        _MARK, "__shift", *[f"__o_{n}" for n in names]
    )


def chunk_number(df: DataFrame, order_by: Sequence[str | Column], size: int, out: str = "chunk",
                 staging: Staging | None = None) -> DataFrame:
    """Number the commit chunk of each row: ``size`` consecutive rows share a chunk."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    indexed = dense_index(df, order_by, out="__row", staging=staging)
    return indexed.withColumn(out, F.expr(f"__row div {int(size)}")).drop("__row")


def assign_sequence(df: DataFrame, order_by: Sequence[str | Column], start: int = 1, step: int = 1,
                    out: str = "seq", dense: bool = True, staging: Staging | None = None) -> DataFrame:
    """Sequence values.  ``dense=False`` skips the ordering and only promises unique, growing values."""
    if not dense:
        return df.withColumn(out, F.lit(start) + F.monotonically_increasing_id() * step)
    indexed = dense_index(df, order_by, out="__row", staging=staging)
    return indexed.withColumn(out, F.lit(start) + F.col("__row") * step).drop("__row")
