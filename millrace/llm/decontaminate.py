"""Benchmark passages in documents, by SimHash of item-sized windows.

An item of ``l`` words is looked for in every window of ``l`` words of every document (the whole
document where it is shorter).  Window and item are alike when the weights of their shared five-word
shingles make up 0.8 or more of the weights of all; a shingle weighs ``1 / (1 + log2(d))`` where ``d``
items hold it, and 1 outside the benchmark.

Windows get a 64-bit SimHash from running sums of their shingles' bits.  The items of one length
form a multi-index: fingerprints are cut into blocks, and a pair within ``RADIUS`` bits has a block
that differs in ``RADIUS // BLOCKS`` bits at most, so looking up the neighbours of each block finds
every fingerprint within the radius.  Exact similarity decides.  Only windows that could be similar
are fingerprinted: the benchmark shingles in a window must weigh 0.8 of the lightest item of its
length.  That bound loses nothing.  A pair at similarity 0.8 differs in some ten bits of 64, with a
deviation of three, and a passage lies in several windows, so a radius of 24 loses next to none.

The benchmark is compiled with Spark and read by the driver in slices of at most ``SLICE_ITEMS``
items (shortened where items are long), one pass over the documents per slice.  Shingles of two items
or more weigh less in every slice, so where there are several slices their weights go to all of them, as one table of 16 bytes
a shingle: what is found does not depend on how the items are sliced.

Defined results: shingles of items or documents with fewer than five words are their whole word
sequence, which then has to be met exactly; NULL and empty items match nothing; NULL and empty
documents are clean; repeated items and rows are looked at each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import ROW, with_row
from millrace.staging import Staging

SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
SLICE_ITEMS = 20_000
SLICE_SHINGLES = 2_000_000
SLICE_BYTES = 4 << 20
SPAN = 1 << 15  # windows fingerprinted at a time

_U = np.uint64


def _shingled(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Shingle size and the shingles of an item, in order."""
    size = min(hashing.SHINGLE, len(words))
    return size, hashing.ngram_hashes(words, size)[:len(words) - size + 1] if size else words


def _explode_items(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        words, bounds = hashing.word_hashes(*hashing.column_bytes(batch.column("text")))
        for row, item, a, b in zip(batch.column(ROW).to_pylist(), batch.column("item_id"), bounds[:-1], bounds[1:]):
            if b > a:
                size, shingles = _shingled(words[a:b])
                n = len(shingles)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * n), pa.array([item.as_py()] * n, item.type), pa.array([int(b - a)] * n), pa.array(range(n)),
                    pa.array(shingles.view(np.int64))], [ROW, "item_id", "n_words", "at", "shingle"])


def compile_items(items: DataFrame, item_id: str, text: str, staging: Staging) -> DataFrame:
    """``(row, item_id, n_words, shingles, held_by)``: the shingles of each item in order."""
    kind = items.schema[item_id].dataType.simpleString()
    source = with_row(items).select(ROW, F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    each = staging.keep(source.mapInArrow(
        _explode_items, f"{ROW} bigint, item_id {kind}, n_words bigint, at bigint, shingle bigint"), "item_shingles")
    held = each.select(ROW, "shingle").distinct().groupBy(F.col("shingle").alias("s")).agg(F.count(F.lit(1)).alias("d"))
    found = each.join(held, F.col("shingle") == F.col("s")).groupBy(ROW, "item_id", "n_words").agg(
        F.sort_array(F.collect_list(F.struct("at", "shingle", "d"))).alias("x"))
    return staging.keep(found.select(ROW, "item_id", "n_words", F.col("x.shingle").alias("shingles"), F.col("x.d").alias("held_by")), "items")


class Weights:
    """Weights of shingles, in a sorted table with a filter before it."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = keys, weights
        self.filter = np.zeros(1 << 20, bool)
        self.filter[keys >> _U(44)] = True

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are in the table, and where."""
        at = np.flatnonzero(self.filter[shingles >> _U(44)])
        where = np.minimum(np.searchsorted(self.keys, shingles[at]), len(self.keys) - 1)
        hit = self.keys[where] == shingles[at] if len(at) else np.zeros(0, bool)
        return at[hit], where[hit]


class Index:
    """The items of a slice: shingle weights, and a multi-index of fingerprints per item length."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        shingles = [np.array(r["shingles"], np.int64).view(_U) for r in rows]
        weights = [1 / (1 + np.log2(np.array(r["held_by"], float))) for r in rows]
        keys, at = np.unique(np.concatenate(shingles), return_index=True)
        self.table = Weights(keys, np.concatenate(weights)[at])
        self.sets, self.by_length = [], {}
        for i, (r, s, w) in enumerate(zip(rows, shingles, weights)):
            own, first = np.unique(s, return_index=True)
            self.sets.append((own, w[first], w[first].sum()))
            self.by_length.setdefault(int(r["n_words"]), []).append(i)
        self.lengths = {}
        for length, members in sorted(self.by_length.items()):
            prints = np.array([simhash_windows(shingles[i], weights[i], [(0, len(shingles[i]))])[0] for i in members], _U)
            self.lengths[length] = (np.array(members), prints, _block_tables(prints), min(self.sets[i][2] for i in members))
        self.sizes = sorted({min(hashing.SHINGLE, n) for n in self.lengths})

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Whether each shingle is of an item of the slice."""
        known = np.zeros(len(shingles), bool)
        known[self.table.find(shingles)[0]] = True
        return known

    def weigh(self, shingles: np.ndarray, shared: Weights | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights of shingles in the whole benchmark, and whether each is of an item of the slice.

        ``shared`` holds what two items or more have, whatever their slices; one slice knows all of that.
        """
        weights, known = np.ones(len(shingles)), np.zeros(len(shingles), bool)
        for table in (shared, self.table):
            if table is not None:
                at, where = table.find(shingles)
                weights[at] = table.weights[where]
        known[at] = True
        return weights, known

    def near(self, length: int, prints: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each fingerprint the items of this length within the radius: (which print, items)."""
        members, own, tables, _ = self.lengths[length]
        out = []
        for i, p in enumerate(prints):
            met = np.zeros(len(members), bool)
            for b, table in enumerate(tables):
                found = table.get(int(p >> _U(8 * b)) & 255)
                if found is not None:
                    met[found] = True
            close = np.flatnonzero(met)
            close = close[np.bitwise_count(own[close] ^ p) <= RADIUS]
            if len(close):
                out.append((i, members[close]))
        return out

    def similarity(self, item: int, shingles: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and the distinct shingles of a window."""
        own, own_weights, total = self.sets[item]
        where = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        hit = own[where] == shingles
        shared = own_weights[where[hit]].sum()
        return shared / (total + weights.sum() - shared)


def _block_tables(prints: np.ndarray) -> list[dict[int, np.ndarray]]:
    """Per block: which prints lie within the block's share of the radius of a value."""
    width = 64 // BLOCKS
    flips = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), n)]
    tables = []
    for b in range(BLOCKS):
        values = (prints >> _U(width * b) & _U((1 << width) - 1)).astype(int)
        table: dict[int, list[int]] = {}
        for i, v in enumerate(values.tolist()):
            for flip in flips:
                table.setdefault(v ^ flip, []).append(i)
        tables.append({v: np.array(found) for v, found in table.items()})
    return tables


def simhash_windows(shingles: np.ndarray, weights: np.ndarray, windows: Iterable[tuple[int, int]]) -> np.ndarray:
    """64-bit SimHash of runs of shingles, from running sums of weighted bits."""
    spread = hashing.mix(shingles ^ _U(0x51A3)).astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(spread, axis=1, bitorder="little").astype(np.float64) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(bits * weights[:, None], axis=0)])
    edges = np.array(list(windows), np.int64)
    return np.packbits(sums[edges[:, 1]] - sums[edges[:, 0]] > 1e-9, axis=1, bitorder="little").view("<u8").ravel()


def matches(index: Index, words: np.ndarray, shared: Weights | None = None) -> dict[int, float]:
    """Items found in one document, with the similarity they were found at."""
    found: dict[int, float] = {}
    for size in index.sizes:
        if len(words) < size:
            continue
        shingles = hashing.ngram_hashes(words, size)[:len(words) - size + 1]
        if not index.known(shingles).any():
            continue
        weights, known = index.weigh(shingles, shared)
        sums = np.concatenate([[0.0], np.cumsum(weights * known)])
        for length, (_, _, _, lightest) in index.lengths.items():
            if min(length, hashing.SHINGLE) != size:
                continue
            span = min(length - size + 1, len(shingles))
            starts = np.flatnonzero(sums[span:] - sums[:-span] >= SIMILARITY * lightest - 1e-9)
            for k in range(0, len(starts), SPAN):
                _windows(index, length, span, starts[k:k + SPAN], shingles, weights, found)
    return found


def _windows(index, length, span, starts, shingles, weights, found) -> None:
    """Look up the windows that begin at ``starts``; gaps between them are skipped."""
    breaks = np.flatnonzero(np.diff(starts) > 2 * span) + 1
    for run in np.split(starts, breaks):
        low, high = int(run[0]), int(run[-1]) + span
        prints = simhash_windows(shingles[low:high], weights[low:high], [(s - low, s - low + span) for s in run.tolist()])
        for i, items in index.near(length, prints):
            fresh = [j for j in items.tolist() if j not in found]
            if not fresh:
                continue
            own, first = np.unique(shingles[run[i]:run[i] + span], return_index=True)
            for j in fresh:
                similar = index.similarity(j, own, weights[run[i] + first])
                if similar >= SIMILARITY - 1e-12:
                    found[j] = float(similar)


def _search(sliced, everywhere, kind: pa.DataType):
    schema = pa.schema([("hit", pa.int64()), ("item_id", kind), ("similarity", pa.float64())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shared = sliced.value, everywhere.value if everywhere else None
        for batch in stream:
            for piece in hashing.slices(batch, "text", SLICE_BYTES):
                words, bounds = hashing.word_hashes(*hashing.column_bytes(piece.column("text")))
                touched = np.zeros(len(words), bool)
                for size in index.sizes:
                    touched |= index.known(hashing.ngram_hashes(words, size))
                at = np.searchsorted(bounds, np.flatnonzero(touched), "right") - 1
                rows = piece.column(ROW).to_pylist()
                out = [(rows[d], index.ids[i], s) for d in np.unique(at).tolist()
                       for i, s in matches(index, words[bounds[d]:bounds[d + 1]], shared).items()]
                if out:
                    hits, ids, similar = zip(*out)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(hits, pa.int64()), pa.array(ids, kind), pa.array(similar, pa.float64())], schema=schema)

    return run


def _shared_weights(compiled: DataFrame) -> Weights | None:
    """The weights of all shingles that two items or more hold."""
    each = compiled.select(F.explode(F.arrays_zip("shingles", "held_by")).alias("x")).where("x.held_by > 1")
    found = each.select("x.shingles", "x.held_by").distinct().toPandas()
    keys = found["shingles"].to_numpy(np.int64).view(_U)
    order = np.argsort(keys)
    return Weights(keys[order], 1 / (1 + np.log2(found["held_by"].to_numpy(float)[order]))) if len(keys) else None


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", staging: Staging | None = None) -> DataFrame:
    """``(row, item_ids, similarity)`` of the rows that hold an item; rows as ``with_row`` numbers them."""
    spark = df.sparkSession
    staging = staging or Staging(spark)
    compiled = compile_items(items, item_id, item_text, staging)
    sizes = compiled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("s")).first()
    slices = max(1, ceil(sizes["n"] / SLICE_ITEMS), ceil(sizes["s"] / SLICE_SHINGLES))
    docs = with_row(df).select(ROW, F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    kind = compiled.schema["item_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    # one slice knows the shingles of all items
    shared = _shared_weights(compiled) if slices > 1 else None
    everywhere = spark.sparkContext.broadcast(shared) if shared else None
    parts = []
    for k in range(slices):
        rows = compiled.where(F.pmod(F.xxhash64(F.lit(3), ROW), F.lit(slices)) == k).orderBy(ROW).collect()
        if rows:
            sliced = spark.sparkContext.broadcast(Index(rows))
            parts.append(docs.mapInArrow(_search(sliced, everywhere, to_arrow_type(kind)), f"hit bigint, item_id {kind.simpleString()}, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"hit bigint, item_ids array<{kind.simpleString()}>, similarity double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.groupBy("hit").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    return staging.keep(found, "leaks")


def clean(df: DataFrame, items: DataFrame, text: str = "text", staging: Staging | None = None) -> DataFrame:
    """The rows that hold no item, with the columns they came with."""
    leaks = find_leaks(df, items, text, staging=staging).select(F.col("hit").alias("__llm_hit"))
    return with_row(df).join(leaks, F.col(ROW) == F.col("__llm_hit"), "left_anti").drop(ROW)
