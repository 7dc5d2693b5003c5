"""Row-at-a-time cursor work as set operations: delete, upsert, update, loop and override.

The small side of each join - the distinct keys, or the last row per key - is written to the shared
folder first.  Duplicates are removed before any shuffle, so a key that fills the cursor costs one
row; the planner broadcasts the written table only when its size in bytes allows it; and otherwise
the join reads two plain shuffles, which adaptive execution can split where the target is skewed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.normalise import all_of
from millrace.staging import Staging


def _with_key(cursor: DataFrame, key: Sequence[str]) -> Column:
    """Rows that can match at all: SQL equality never holds for a NULL key."""
    return all_of([F.col(k).isNotNull() for k in key])


def _keys(cursor: DataFrame, key: Sequence[str], staging: Staging | None) -> DataFrame:
    staging = staging or Staging(cursor.sparkSession)
    return staging.keep(cursor.select(*key).where(_with_key(cursor, key)).distinct(), "keys")


def matching(target: DataFrame, cursor: DataFrame, key: Sequence[str],
             staging: Staging | None = None) -> DataFrame:
    """Target rows whose key a cursor row carries."""
    return target.join(_keys(cursor, key, staging), list(key), "left_semi").select(*target.columns)


def delete_matching(target: DataFrame, cursor: DataFrame, key: Sequence[str],
                    staging: Staging | None = None) -> DataFrame:
    """Target rows whose key no cursor row carries."""
    return target.join(_keys(cursor, key, staging), list(key), "left_anti")


def last_per_key(cursor: DataFrame, key: Sequence[str], order_by: Sequence[str],
                 keep_loose: bool = False) -> DataFrame:
    """The last cursor row of each key; ``keep_loose`` keeps every row with a NULL in its key.

    An aggregate with a map-side part, so a key that holds most of the cursor never meets in one
    task.  The order columns must decide: a tie would leave the winner open.
    """
    rest = [c for c in cursor.columns if c not in key]
    group, rows = list(key), cursor
    if keep_loose:  # a number of its own keeps such a row apart
        own = F.when(~_with_key(cursor, key), F.monotonically_increasing_id())
        group, rows = [*key, "__own"], cursor.withColumn("__own", own)
    winner = F.max_by(F.struct(*rest, F.lit(0).alias("__pad")), F.struct(*order_by)).alias("__last")
    return rows.groupBy(*group).agg(winner).select(*key, "__last.*").select(*cursor.columns)


def upsert(target: DataFrame, cursor: DataFrame, key: Sequence[str], order_by: Sequence[str],
           staging: Staging | None = None) -> DataFrame:
    """For each cursor row in order: delete its key from the target, insert the row.

    A row with a NULL key deletes nothing and is never deleted, so all of those are inserted.
    """
    staging = staging or Staging(cursor.sparkSession)
    last = staging.keep(last_per_key(cursor, key, order_by, keep_loose=True), "last")
    kept = target.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last.select(*target.columns))


def update_matching(target: DataFrame, cursor: DataFrame, key: Sequence[str], order_by: Sequence[str],
                    assign: Mapping[str, str], staging: Staging | None = None) -> DataFrame:
    """For each cursor row in order: set target columns (to cursor columns) where the key is equal."""
    joined = _with_last(target, cursor, key, order_by, assign, staging, "left")
    return joined.select(*[
        F.when(F.col("__hit"), F.col(f"__new_{c}").cast(target.schema[c].dataType))
        .otherwise(F.col(c)).alias(c) if c in assign else F.col(c)
        for c in target.columns
    ])


def updated_rows(target: DataFrame, cursor: DataFrame, key: Sequence[str], order_by: Sequence[str],
                 assign: Mapping[str, str], staging: Staging | None = None) -> DataFrame:
    """Only the rows that ``update_matching`` sets, with their new values."""
    joined = _with_last(target, cursor, key, order_by, assign, staging, "inner")
    return joined.select(*[
        F.col(f"__new_{c}").cast(target.schema[c].dataType).alias(c) if c in assign else F.col(c)
        for c in target.columns
    ])


def _with_last(target: DataFrame, cursor: DataFrame, key: Sequence[str], order_by: Sequence[str],
               assign: Mapping[str, str], staging: Staging | None, how: str) -> DataFrame:
    staging = staging or Staging(cursor.sparkSession)
    usable = cursor.where(_with_key(cursor, key))
    last = staging.keep(last_per_key(usable, key, order_by), "last")
    fresh = last.select(*key, F.lit(True).alias("__hit"),
                        *[F.col(source).alias(f"__new_{column}") for column, source in assign.items()])
    return target.join(fresh, list(key), how)


def rows_affected(target: DataFrame, cursor: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(updated, inserted)``: target rows an upsert replaces, and rows that are new to the target.

    One aggregate over both sides, combined before the shuffle, instead of two joins.
    """
    usable = _with_key(target, key)
    sides = target.where(usable).select(*key, F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(
        cursor.where(usable).select(*key, F.lit(0).alias("t"), F.lit(1).alias("c")))
    per_key = sides.groupBy(*key).agg(F.sum("t").alias("t"), F.max("c").alias("c")).where("c = 1")
    counts = per_key.select(F.col("t").alias("updated"), (F.col("t") == 0).cast("bigint").alias("inserted"))
    loose = cursor.where(~usable).select(
        F.lit(0).cast("bigint").alias("updated"), F.lit(1).cast("bigint").alias("inserted"))
    return counts.unionByName(loose).agg(
        F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"),
        F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"),
    )


def loop_expand(df: DataFrame, name: str, values: Sequence[int | str]) -> DataFrame:
    """The body once per enumerated value: a narrow explode of the list in the job text."""
    return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def override_expand(groups: DataFrame, clusters: DataFrame, details: DataFrame,
                    names: Sequence[str] | None = None, staging: Staging | None = None) -> DataFrame:
    """Members per group: those of its cluster, unless the group has detailed rows of its own.

    ``groups(group, cluster, login)``, ``clusters(cluster, member)``, ``details(group, member, login)``.
    Groups with an unknown cluster vanish; ``names`` only matters by being empty, which empties
    the result.
    """
    plain = (
        delete_matching(groups, details, ["group"], staging)
        .join(clusters, "cluster")
        .select("group", "member", "login")
    )
    members = plain.unionByName(details.select("group", "member", "login"))
    if names is not None and len(names) == 0:
        return members.where(F.lit(False))
    return members


def delete_where(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows a DELETE leaves: those where the condition is not true (NULL keeps the row)."""
    if condition is None:
        return df.where(F.lit(False))
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, assign: Mapping[str, Column], condition: Column | None = None) -> DataFrame:
    """Set columns where the condition is true; types of the table are kept."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return df.select(*[
        F.when(hit, assign[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in assign else F.col(f.name)
        for f in df.schema.fields
    ])


def fitted_rows(schema: StructType, rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by position in the named columns of a table (all by default); the others become NULL."""
    names = list(columns) if columns is not None else schema.names
    if len(names) != len(rows.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(names)} columns")
    named = rows.toDF(*names)
    return named.select(*[
        (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def insert_rows(df: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Append rows by position to the named columns (all by default); the others become NULL."""
    return df.unionByName(fitted_rows(df.schema, rows, columns))
