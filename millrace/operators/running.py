"""State that runs along an ordered cursor, where each row depends on the row before, in parallel.

A body that changes one value per row, like a balance with a floor, looks sequential.  But what a row does to
the value is a small *map*, and two maps in a row are one map of the same kind.  So a key is cut into
segments: every segment composes its maps in its own task, the segments' maps are scanned the same way (a
table as much smaller as a segment is long), and every segment replays its rows from the value that enters
it.  A key that holds most of the rows is many segments; no task sees more than one.

Two kinds of maps:

* ``Clamped``: ``value = least(greatest(value + add, low), high)``, exact on whole numbers and decimals.
  It covers running sums, sums with limits, resets (``low = high``), and running minima and maxima.
* ``Carried``: the last value that was not NULL, of any type.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.numbering import dense_index
from millrace.staging import Staging

SEGMENT_ROWS = 200_000
LEAST, MOST = -(1 << 62), 1 << 62  # no limit


@dataclass(frozen=True)
class Clamped:
    """SQL expressions over the row.  ``add`` is NULL or missing: nothing is added; ``low`` or ``high`` is NULL:
    no limit there.

    Where ``low`` is above ``high``, ``high`` holds.  ``start`` is the value before the first row of a key.
    """

    add: str | None = None
    low: str | None = None
    high: str | None = None
    start: int = 0
    scale: int = 0  # decimal places of the value

    state = pa.struct([("add", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    ddl = "struct<add:bigint,low:bigint,high:bigint>"

    def column(self) -> Column:
        def whole(value: str | None, missing: int) -> Column:
            if value is None:
                return F.lit(missing).cast("bigint")
            return F.coalesce((F.expr(value).cast(f"decimal(38,{self.scale})") * 10 ** self.scale).cast("bigint"), F.lit(missing))

        high = whole(self.high, MOST)
        return F.struct(whole(self.add, 0).alias("add"), F.least(whole(self.low, LEAST), high).alias("low"), high.alias("high"))

    def result(self, value: Column) -> Column:
        """The stored value as the user sees it."""
        if not self.scale:
            return value
        return (value.cast("decimal(20,0)") / F.lit(10 ** self.scale)).cast(f"decimal(20,{self.scale})")

    @staticmethod
    def _parts(maps: pa.Array) -> list[np.ndarray]:
        return [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in maps.flatten()]

    @staticmethod
    def _then(first: Sequence[np.ndarray], second: Sequence[np.ndarray]) -> list[np.ndarray]:
        """One map for ``first`` and ``second`` after it."""
        add, low, high = second

        def bound(limit: np.ndarray, none: int, other: np.ndarray) -> np.ndarray:
            return np.where(limit == none, other, np.minimum(np.maximum(limit + add, low), high))

        return [first[0] + add, bound(first[1], LEAST, low), bound(first[2], MOST, high)]

    def prefixes(self, maps: pa.Array) -> pa.Array:
        """What all rows up to each one do together; doubles the reach of every map until it is whole."""
        parts = self._parts(maps)
        if np.abs(parts[0].astype(np.float64)).sum() >= MOST:
            raise OverflowError("a running value leaves the range of 62 bits")
        reach = 1
        while reach < len(maps):
            joined = self._then([p[:-reach] for p in parts], [p[reach:] for p in parts])
            parts = [np.concatenate([p[:reach], j]) for p, j in zip(parts, joined)]
            reach *= 2
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=list(self.state))

    def initial(self) -> pa.Array:
        start = self.start * 10 ** self.scale
        return pa.StructArray.from_arrays([pa.array([0]), pa.array([start]), pa.array([start])], fields=list(self.state))

    def entered(self, entry: pa.Array, prefixes: pa.Array) -> pa.Array:
        """The prefixes behind what came before the segment."""
        before = [np.repeat(p, len(prefixes)) for p in self._parts(entry)]
        return pa.StructArray.from_arrays([pa.array(p) for p in self._then(before, self._parts(prefixes))], fields=list(self.state))

    def values(self, states: pa.Array) -> pa.Array:
        """A map behind the start gives one value: both limits are it."""
        return states.field("low")

    def value_ddl(self) -> str:
        return "bigint"


@dataclass(frozen=True)
class Carried:
    """The last value that was not NULL; NULL before the first."""

    value: str  # an SQL expression over the row
    kind: str  # its type, as Spark writes it

    @property
    def ddl(self) -> str:
        return f"struct<value:{self.kind}>"

    def column(self) -> Column:
        return F.struct(F.expr(self.value).cast(self.kind).alias("value"))

    def result(self, value: Column) -> Column:
        return value

    def prefixes(self, maps: pa.Array) -> pa.Array:
        return self._filled(maps.flatten()[0])

    @staticmethod
    def _filled(values: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.fill_null_forward(values)], names=["value"])

    def initial(self) -> None:
        return None

    def entered(self, entry: pa.Array | None, prefixes: pa.Array) -> pa.Array:
        if entry is None or not entry.field("value")[0].is_valid:
            return prefixes
        return pa.StructArray.from_arrays([pc.fill_null(prefixes.field("value"), entry.field("value")[0])], names=["value"])

    def values(self, states: pa.Array) -> pa.Array:
        return states.field("value")

    def value_ddl(self) -> str:
        return self.kind


Body = Clamped | Carried


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _before_segments(maps: DataFrame, body: Body, key_ddl: str, segment_rows: int, staging: Staging) -> DataFrame:
    """``(__key, __segment, __entry)``: what all segments before each one do together, for ``(__key, __at, __map)``."""

    def whole(table: pa.Table) -> pa.Table:
        maps = _one(table.sort_by("__at").column("__map"))
        return pa.table({"__key": table.column("__key").slice(0, 1), "__at": table.column("__segment").slice(0, 1),
                         "__map": body.prefixes(maps).slice(len(maps) - 1)})

    def spread(table: pa.Table, entry: pa.Array | None) -> pa.Table:
        """Each segment of a group of segments with the map of all before it."""
        table = table.sort_by("__at")
        states = body.prefixes(_one(table.column("__map")))
        if entry is not None:
            states = body.entered(entry, states)
        first = entry if entry is not None else pa.nulls(1, states.type)
        shifted = pa.concat_arrays([first.cast(states.type), states.slice(0, len(states) - 1)])
        return pa.table({"__key": table.column("__key"), "__segment": table.column("__at"), "__entry": shifted})

    grouped = maps.withColumn("__segment", F.expr(f"__at div {segment_rows}"))
    schema = f"__key {key_ddl}, __segment bigint, __entry {body.ddl}"
    if (maps.agg(F.max("__at")).first()[0] or 0) < segment_rows:
        return staging.keep(grouped.groupBy("__key", "__segment").applyInArrow(lambda t: spread(t.drop_columns("__segment"), None), schema), "entries")
    above = staging.keep(grouped.groupBy("__key", "__segment").applyInArrow(whole, f"__key {key_ddl}, __at bigint, __map {body.ddl}"), "maps")
    entries = _before_segments(above, body, key_ddl, segment_rows, staging)

    def handed(table: pa.Table, given: pa.Table) -> pa.Table:
        entry = _one(given.column("__entry"))
        return spread(table.drop_columns("__segment"), entry if entry[0].is_valid else None)

    return staging.keep(grouped.groupBy("__key", "__segment").cogroup(entries.groupBy("__key", "__segment")).applyInArrow(handed, schema), "entries")


def run_along(df: DataFrame, key: Sequence[str], order_by: Sequence[str], body: Body, out: str = "state",
              before: str | None = None, segment_rows: int = SEGMENT_ROWS, staging: Staging | None = None) -> DataFrame:
    """Add the value after each row as ``out`` (and the one before it as ``before``), per key, in the given order.

    The order must have no ties.  Rows with a NULL key are a key of their own.
    """
    if segment_rows < 2:
        raise ValueError("a segment has two rows at least")
    staging = staging or Staging(df.sparkSession)
    group = F.struct(*[F.col(f"`{k}`") for k in key]) if key else F.struct(F.lit(0).alias("all"))
    rows = df.select("*", group.alias("__key"), body.column().alias("__map"))
    rows = dense_index(rows, list(order_by), ["__key"], "__at", staging)
    key_ddl = rows.schema["__key"].dataType.simpleString()
    pieces = rows.withColumn("__segment", F.expr(f"__at div {segment_rows}"))

    def whole(table: pa.Table) -> pa.Table:
        maps = _one(table.sort_by("__at").column("__map"))
        return pa.table({"__key": table.column("__key").slice(0, 1), "__at": table.column("__segment").slice(0, 1),
                         "__map": body.prefixes(maps).slice(len(maps) - 1)})

    maps = staging.keep(pieces.select("__key", "__segment", "__at", "__map").groupBy("__key", "__segment").applyInArrow(
        whole, f"__key {key_ddl}, __at bigint, __map {body.ddl}"), "maps")
    entries = _before_segments(maps, body, key_ddl, segment_rows, staging)
    names = df.columns

    def replay(table: pa.Table, given: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        states = body.prefixes(_one(table.column("__map")))
        entry, start = _one(given.column("__entry")), body.initial()
        if entry[0].is_valid:
            start = entry if start is None else body.entered(start, entry)
        if start is not None:
            states = body.entered(start, states)
        after = body.values(states)
        first = body.values(start) if start is not None else pa.nulls(1, after.type)
        done = table.select(names).append_column("__after", after)
        return done.append_column("__before", pa.concat_arrays([first.cast(after.type), after.slice(0, len(after) - 1)]))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    done = pieces.groupBy("__key", "__segment").cogroup(entries.groupBy("__key", "__segment")).applyInArrow(
        replay, f"{ddl}, __after {body.value_ddl()}, __before {body.value_ddl()}")
    kept = [F.col(f"`{c}`") for c in names if c not in (out, before)]
    added = [body.result(F.col("__after")).alias(out)] + ([body.result(F.col("__before")).alias(before)] if before else [])
    return done.select(*kept, *added)
