"""Connected components: merged inside tasks first, then by alternating large and small stars.

Edges are read in runs of at most ``LOCAL_EDGES``, and every run is reduced to the stars of its own components
(one edge a node).  Where one run holds all edges that is the answer.  Otherwise rounds of stars over the
reduced edges go on until nothing changes; every round writes the edges to the shared folder and starts
from the written table.  Nothing but row counts reaches the driver.  Stars are built with minimum aggregates
(combined before the shuffle) and joins.  Labels are the smallest members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.staging import Staging

MAX_ROUNDS = 100
LOCAL_EDGES = 1 << 20  # edges of a run: 16 MB, and some times that while it is merged


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges with the smallest node it is connected to."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[:len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots of both ends: the larger hangs on the smaller
        while not np.array_equal(root, root[root]):
            root = root[root]


def _merged(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            edges = pa.Table.from_batches(held)
            nodes, roots = local_stars(*(edges.column(c).to_numpy() for c in ("u", "v")))
            yield pa.RecordBatch.from_pydict({"u": nodes, "v": roots})

    held, size = [], 0
    for batch in stream:
        for at in range(0, batch.num_rows, LOCAL_EDGES):
            piece = batch.slice(at, LOCAL_EDGES)
            if size + piece.num_rows > LOCAL_EDGES:
                yield from stars(held)
                held, size = [], 0
            held.append(piece)
            size += piece.num_rows
    yield from stars(held)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("c"), F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("c"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == F.col("c"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``(node, label)`` of every node of the edges ``(a, b)``, which are a written table; loops and repeats do no harm."""
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    runs = max(1, ceil(edges.count() / LOCAL_EDGES))
    stars = edges.coalesce(runs).mapInArrow(_merged, "u bigint, v bigint")
    if runs == 1:
        return staging.keep(stars.select(F.col("u").alias("node"), F.col("v").alias("label")), "stars")
    now = staging.keep(stars.where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        large = _large_star(now).where("u <> v").distinct()
        now = staging.keep(_small_star(large).where("u <> v").distinct(), "edges")
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops)
