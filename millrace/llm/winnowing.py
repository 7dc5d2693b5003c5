"""Document fingerprints by winnowing, and how alike they are for a text, its edit and its neighbour.

A text is reduced to its characters without ASCII white space, A-Z lower-cased; every run of
``GRAM`` of them has a rolling (Karp-Rabin) hash modulo ``PRIME``, taken from prefix sums, and every
window of ``WINDOW`` consecutive hashes gives its smallest one, the rightmost of equal ones.  Two texts
that share ``GRAM + WINDOW - 1`` such characters in a row share a fingerprint entry, and positions (of
the first character of the gram, in code points of the text as it is) tell where.  An entry's value is
the selecting hash and, below it, a second hash of the same gram with another base.

A fingerprint is written as entries of 24 hex digits, position then value, joined by commas;
``entries`` reads it back.  The likeness of two fingerprints is the Jaccard similarity of their values.

Neighbours without one big window: the ids are cut into ranges by bounds from a bounded sample (they
decide where rows are worked on, never results), each range is sorted in one task and read as a
stream, and the first row of each range is also sent to the range before it, where it ends the range.
One shuffle of the texts; a task holds a slice of rows and the row before it.

Defined results: a NULL text is empty; a text without characters has the empty fingerprint; with fewer
than ``GRAM`` characters the whole sequence is one gram; with fewer than ``WINDOW`` grams all of them are
one window.  Two empty fingerprints are alike (1.0).  NULL ids come last; rows with equal ids follow
the hash of their text, so equal rows are interchangeable.  A single row is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import annotate, whole_text
from millrace.llm.hashing import slices
from millrace.staging import Staging

GRAM = 16
WINDOW = 32
PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_069_691)

CHUNK = 1 << 20  # characters of one text hashed at a time
SLICE_BYTES = 1 << 21
RANGE_ROWS = 4096  # documents of a range of ids, until there are MAX_RANGES
MAX_RANGES = 1 << 16
SAMPLED = 32  # ids per range that the bounds are taken from

_U = np.uint64
_NONE = np.iinfo(np.uint64).max


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo the prime, for ``i < n``; built by doubling."""
    found = np.ones(1, _U)
    while len(found) < n:
        found = np.concatenate([found, found * _U(pow(base, len(found), PRIME)) % _U(PRIME)])
    return found[:n]


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes from every position on: a difference of prefix sums, shifted down."""
    n = len(codes)
    room = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(BASES[0], room), _powers(pow(BASES[0], -1, PRIME), room)
    sums = np.zeros(n + 1, _U)
    np.cumsum(codes * up[:n] % _U(PRIME), out=sums[1:])
    return (sums[size:] - sums[:n - size + 1]) % _U(PRIME) * down[:n - size + 1] % _U(PRIME)


def _second(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The other hash, only where a gram was selected."""
    total = np.zeros(len(starts), _U)
    for k, power in enumerate(_powers(BASES[1], size).tolist()):
        total += codes[starts + k] * _U(power) % _U(PRIME)
    return total % _U(PRIME)


def _select(codes: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, index of the first code, value)`` of what the windows of all texts select.

    ``codes`` holds the texts one after the other; ``offsets`` says where each starts and ends.
    """
    lengths = np.diff(offsets)
    found = []
    for k in np.flatnonzero((lengths > 0) & (lengths < gram)).tolist():  # one gram of the whole text
        own = codes[offsets[k]:offsets[k + 1]]
        value = _rolling(own, len(own)) << _U(31) | _second(own, np.zeros(1, np.int64), len(own))
        found.append((np.array([k]), offsets[k:k + 1], value))
    texts = np.flatnonzero(lengths >= gram)
    if len(texts):
        hashes = _rolling(codes, gram)
        grams = lengths[texts] - gram + 1
        padded = np.maximum(grams, window)  # a text with few grams is padded to one window
        at = np.concatenate([[0], np.cumsum(padded)])
        inside = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
        starts = np.repeat(offsets[texts], grams) + inside
        # the hash above, the distance from the end of the block below: the least is the rightmost of equals
        bits = int(at[-1]).bit_length()
        keys = np.full(at[-1], _NONE, _U)
        places = np.repeat(at[:-1], grams) + inside
        keys[places] = hashes[starts] << _U(bits) | (_U(at[-1]) - places.astype(_U))
        width = 1
        while width < window:  # least key of ``width`` places from each on
            step = min(width, window - width)
            keys = np.minimum(keys[:-step], keys[step:])
            width += step
        first = np.repeat(at[:-1], padded - window + 1)
        count = np.cumsum(padded - window + 1)
        first += np.arange(count[-1]) - np.repeat(count - (padded - window + 1), padded - window + 1)
        chosen = np.unique(at[-1] - (keys[first] & _U((1 << bits) - 1)).astype(np.int64))
        owner = np.searchsorted(at, chosen, "right") - 1
        begin = offsets[texts[owner]] + chosen - at[owner]
        found.append((texts[owner], begin, hashes[begin] << _U(31) | _second(codes, begin, gram)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    text, begin, value = (np.concatenate(part) for part in zip(*found))
    order = np.argsort(begin, kind="stable")
    return text[order], begin[order], value[order]


def _reduced(text: str, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one up, so that none is zero) and positions of the characters that count."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    places = np.flatnonzero(~((codes == 32) | ((codes >= 9) & (codes <= 13))))
    codes = codes[places]
    codes += np.where((codes >= 65) & (codes <= 90), _U(33), _U(1))
    return codes, places + start


def _long(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A text of several chunks: each goes on from the characters that its first windows may need."""
    codes, places = np.zeros(0, _U), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(text), CHUNK):
        more, where = _reduced(text[at:at + CHUNK], at)
        codes, places = np.concatenate([codes, more]), np.concatenate([places, where])
        if len(codes) < gram + window - 1:
            continue
        _, begin, value = _select(codes, np.array([0, len(codes)]), gram, window)
        found.append((places[begin], value))
        codes, places = codes[-(gram + window - 2):], places[-(gram + window - 2):]
    if not found:
        _, begin, value = _select(codes, np.array([0, len(codes)]), gram, window)
        return places[begin], value
    position, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return position, np.concatenate([v for _, v in found])[first]


def select_all(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and values of the fingerprint of each text."""
    result: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    short, at = [], 0
    for k, text in enumerate(texts):
        if len(text) > CHUNK:
            result[k] = _long(text, gram, window)
        else:
            short.append(k)
    while at < len(short):
        stop, size = at, 0
        while stop < len(short) and (size == 0 or size + len(texts[short[stop]]) <= CHUNK):
            size += len(texts[short[stop]])
            stop += 1
        group = short[at:stop]
        starts = np.concatenate([[0], np.cumsum([len(texts[k]) for k in group])])
        codes, places = _reduced("".join(texts[k] for k in group), 0)
        owner, begin, value = _select(codes, np.searchsorted(places, starts), gram, window)
        cuts = np.searchsorted(owner, np.arange(len(group) + 1))
        for i, k in enumerate(group):
            own = slice(cuts[i], cuts[i + 1])
            result[k] = places[begin[own]] - starts[i], value[own]
        at = stop
    return result


def written(entry: tuple[np.ndarray, np.ndarray]) -> str:
    """Entries of 24 hex digits, joined by commas."""
    position, value = entry
    rows = np.zeros((len(position), 12), np.uint8)
    rows[:, :4] = position.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4:] = value.astype(">u8").view(np.uint8).reshape(-1, 8)
    return rows.tobytes().hex(",", 12)


def entries(fingerprint: Column) -> Column:
    """A written fingerprint as ``array<struct<position, value>>``."""
    parts = F.filter(F.split(fingerprint, ","), lambda e: F.length(e) > 0)
    return F.transform(parts, lambda e: F.struct(
        F.conv(F.substring(e, 1, 8), 16, 10).cast("bigint").alias("position"),
        F.conv(F.substring(e, 9, 16), 16, 10).cast("bigint").alias("value")))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two lists of values."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by the start of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(df: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The input with ``fingerprint``, no shuffle."""
    given = annotate(df, {"fingerprint": whole_text(F.col(f"`{text}`")).cast("binary")})
    kept = given.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def work(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in slices(batch, "fingerprint", SLICE_BYTES):
                texts = [t.decode("utf-8", "replace") for t in piece.column("fingerprint").to_pylist()]
                done = pa.array([written(e) for e in select_all(texts, gram, window)], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [done], names=[*kept, "fingerprint"])

    return given.mapInArrow(work, f"{schema}, fingerprint string" if kept else "fingerprint string")


def _compare(gram: int, window: int, id_type: pa.DataType):
    """Over sorted ranges, each closed by the first row of the next: every row beside the one after it."""
    schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in stream:
            for piece in slices(batch, "body", SLICE_BYTES):
                texts = [t.decode("utf-8", "replace") for t in piece.column("body").to_pylist()]
                rows = held + list(zip(piece.column("doc_id").to_pylist(), piece.column("closing").to_pylist(), texts, select_all(texts, gram, window)))
                held = rows[-1:]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
                changed = [edited(a[2], b[2]) for a, b in pairs]
                prints = select_all(changed, gram, window)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[0] for a, _ in pairs], id_type), pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                    pa.array([written(a[3]) for a, _ in pairs], pa.string()), pa.array([written(p) for p in prints], pa.string()),
                    pa.array([likeness(a[3][1], p[1]) for (a, _), p in zip(pairs, prints)], pa.float64()),
                    pa.array([likeness(a[3][1], b[3][1]) for a, b in pairs], pa.float64())], schema=schema)

    return run


def _placed(rows: DataFrame, range_rows: int) -> DataFrame:
    """Add ``range``, which never falls along (id descending, hash of the text)."""
    total = rows.count()
    ranges = min(MAX_RANGES, max(1, total // range_rows))
    one_in = max(1, total // (SAMPLED * ranges))
    sample = rows.where(F.col("doc_id").isNotNull()).select("doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    marks = np.sort(np.array([-float(r[0]) for r in sample.collect()]))
    bounds = sorted(set(marks[np.arange(1, ranges) * len(marks) // ranges].tolist())) if len(marks) else []
    place = Bucketizer(splits=[-np.inf, *bounds, np.inf], inputCol="__llm_key", outputCol="__llm_range") if bounds else None
    keyed = rows.withColumn("__llm_key", -F.coalesce(F.col("doc_id"), F.lit(0)).cast("double"))
    keyed = place.transform(keyed) if place else keyed.withColumn("__llm_range", F.lit(0.0))
    # rows without an id are cut by the hash that orders them
    part = F.shiftrightunsigned(F.xxhash64("body").bitwiseXOR(F.lit(-(1 << 63))), 32) * ranges
    unnamed = F.lit(len(bounds) + 1) + F.shiftrightunsigned(part, 32)
    return keyed.select(
        F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.col("__llm_range")).cast("int").alias("range"), *rows.columns)


def compare_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW,
                       range_rows: int = RANGE_ROWS, staging: Staging | None = None) -> DataFrame:
    """Every document beside the next one in descending order of the (integer) id; the first follows the last.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    staging = staging or Staging(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), whole_text(F.col(f"`{text}`")).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType
    if kind.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"ids must be integers, not {kind.simpleString()}")
    placed = _placed(rows, range_rows)
    tops = staging.keep(placed.groupBy(F.col("range").alias("r")).agg(F.max("doc_id").alias("top")), "tops")
    # the range before, among those that have rows: one row a range, MAX_RANGES at most of either kind
    ordered = Window.orderBy("r")
    before = tops.select("r", "top", F.coalesce(F.lag("r").over(ordered), F.max("r").over(Window.partitionBy())).alias("before"))
    heads = placed.join(before, (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("r").agg(
        F.min_by("body", F.xxhash64("body")).alias("body"), F.first("before").alias("range"), F.first("top").alias("doc_id"))
    heads = staging.keep(heads.select("range", "doc_id", "body"), "heads")
    both = placed.withColumn("closing", F.lit(False)).unionByName(heads.withColumn("closing", F.lit(True)))
    order = ["range", "closing", F.desc_nulls_last("doc_id"), F.xxhash64("body")]
    arrow = {"long": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "byte": pa.int8()}[kind.typeName()]
    done = both.repartition("range").sortWithinPartitions(*order).select("doc_id", "closing", "body").mapInArrow(
        _compare(gram, window, arrow),
        f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done
