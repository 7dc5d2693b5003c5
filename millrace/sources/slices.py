"""Slices of like size for the parallel read of a table whose bounds nobody gave.

The points between slices are quantiles of the key (Spark's mergeable sketch), with NULL as the
lowest value.  A key that holds more than its share is cut further by a second column, so points are
pairs in lexicographic order.  The predicates of the slices cover every row exactly once, whatever
the table holds when it is read: a stale or sampled set of keys only makes slices uneven.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 100  # ranks of the sketch are off by one in so many of a slice
KINDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType)

Point = tuple[object, object]  # values of the key and of the second column; no second one: None


def _literal(value: object) -> str:
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (int, Decimal)):
        return format(value, "f") if isinstance(value, Decimal) else str(value)
    raise TypeError(f"no literal for {value!r}")


def _quantiles(column: Column, shares: list[float], slices: int) -> Column:
    return F.percentile_approx(column, shares, ACCURACY * slices)


def split_points(keys: DataFrame, key: str, then: str | None, slices: int) -> list[Point]:
    """Up to ``slices - 1`` rising points that cut the rows of ``keys`` into parts of like size.

    ``keys`` may be a sample.  It is aggregated only; what comes to the driver are points and counts.
    """
    if slices < 1:
        raise ValueError("there must be at least one slice")
    for name in filter(None, (key, then)):
        if not isinstance(keys.schema[name].dataType, KINDS):
            raise ValueError(f"{name}: keys are whole numbers, decimals or dates")
    column = F.col(f"`{key}`")
    sizes = keys.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("known")).first()
    total, nulls = sizes["n"], sizes["n"] - sizes["known"]
    ranks = [total * i / slices for i in range(1, slices)]
    shares = [(r - nulls) / sizes["known"] for r in ranks if r >= nulls and sizes["known"]]
    values = keys.agg(_quantiles(column, shares, slices).alias("v")).first()["v"] if shares else []
    firsts = [None] * (len(ranks) - len(values)) + list(values)
    if not then or not firsts or not total:
        return _rising([(v, None) for v in firsts])

    # how many rows hold each of the values, and how many come before
    known = sorted({v for v in firsts if v is not None})
    steps = F.array(*[F.lit(v).cast(keys.schema[key].dataType) for v in known])
    place = F.size(F.filter(steps, lambda p: p < column)) if known else F.lit(0)
    at = F.array_contains(steps, column) if known else F.lit(False)
    counts = keys.where(column.isNotNull()).groupBy(place.alias("place"), at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    hold = {known[r["place"]]: r["n"] for r in counts if r["at"]} | {None: nulls}
    before = {v: nulls + sum(r["n"] for r in counts if r["place"] < i or (r["place"] == i and not r["at"]))
              for i, v in enumerate(known)} | {None: 0}

    wanted: dict[object, list[float]] = {}
    for value, rank in zip(firsts, ranks):
        share = (rank - before[value]) / hold[value] if hold.get(value) else 0.0
        wanted.setdefault(value, []).append(min(1.0, max(0.0, share)))
    second = F.col(f"`{then}`")
    found = keys.agg(*[
        _quantiles(F.when(column.eqNullSafe(F.lit(v)), second), shares, slices).alias(f"q{i}")
        for i, (v, shares) in enumerate(wanted.items())
    ]).first()
    return _rising([(v, b) for i, v in enumerate(wanted) for b in (found[f"q{i}"] or [None])])


def _rising(points: list[Point]) -> list[Point]:
    """Without repeated points, and without the one that comes before every row."""
    return [p for i, p in enumerate(points) if p != (None, None) and p not in points[:i]]


def slice_predicates(keys: DataFrame, key: str, then: str | None = None, slices: int = 8,
                     quote: Callable[[str], str] = str) -> list[str]:
    """One condition per slice; together they hold every row of the table once.

    ``quote`` writes a column name as the database wants it.
    """
    k, t = quote(key), quote(then) if then else ""

    def from_on(point: Point) -> str:
        value, other = point
        if value is None:
            return f"({k} IS NOT NULL OR {t} >= {_literal(other)})"
        if other is None:
            return f"({k} >= {_literal(value)})"
        return f"({k} > {_literal(value)} OR ({k} = {_literal(value)} AND {t} >= {_literal(other)}))"

    def before(point: Point) -> str:
        value, other = point
        low = f"({t} < {_literal(other)} OR {t} IS NULL)" if other is not None else ""
        if value is None:
            return f"({k} IS NULL AND {low})"
        same = f" OR ({k} = {_literal(value)} AND {low})" if low else ""
        return f"({k} < {_literal(value)} OR {k} IS NULL{same})"

    points = split_points(keys, key, then, slices)
    if not points:
        return ["1 = 1"]
    middle = [f"{from_on(a)} AND {before(b)}" for a, b in zip(points, points[1:])]
    return [before(points[0]), *middle, from_on(points[-1])]


def slice_sizes(df: DataFrame, predicates: list[str]) -> DataFrame:
    """``(slice, n_rows)``: how many rows each condition holds, in one pass."""
    sums = df.agg(*[F.count_if(F.expr(p)).alias(f"s{i}") for i, p in enumerate(predicates)])
    each = F.array(*[F.struct(F.lit(i).alias("slice"), F.col(f"s{i}").alias("n_rows")) for i in range(len(predicates))])
    return sums.select(F.inline(each))
