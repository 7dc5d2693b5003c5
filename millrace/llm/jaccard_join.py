"""All pairs of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, as
connected components, by prefix filters under several global token orders.

If two sets are that similar they share a token among the first ``n // 5 + 1`` of each, under *any*
order of all tokens.  So a pair has to pass under every order used, and the filters are intersected
before sets are compared.  Each order puts tokens of a single document first, then rarer tokens (by
powers of two of the number of documents, counted over the whole corpus), and breaks ties by a
seeded hash of its own.  Tokens of a single document fill a prefix but can't be shared, so they are
not written; most documents have a fifth of such tokens and are done there.

1. One scan gives every document its set size and the hash of its set; equal sets are one *class*
   from there on.  The same scan counts all shingles (``key_counts``).
2. Prefix tokens under the first order are written, and aggregated per token to the smallest and
   largest class.  Tokens of one class only are gone: nearly all of them.
3. Star steps: one holder of every shared token is drawn, and every class meets the ``STAR_MEETS``
   drawn ones it shares most tokens with.  That many pairs per class, however large a group of near
   copies is; verified pairs merge, and the next step draws anew.
4. What the stars leave open: tokens, under each order, that still join different components.  Pairs
   of such classes are taken where their first shared token leaves enough tokens behind it in both
   sets, and verified exactly if that is so under *all* orders.
   Pairs inside a component are never made: they could not change it.

Every step is exact, up to 64-bit hashes of shingles and sets; counts only steer the orders.

Defined results: a document with fewer than five words has its whole sequence as its one shingle; a
NULL text or one without words has the empty set and is linked with nothing; rows with equal ids are
documents of their own; a NULL id is never the name of a component unless all its members have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing, key_counts
from millrace.llm.common import ROW, with_row
from millrace.llm.components import components
from millrace.staging import Staging

ORDER_SEEDS = (101, 202, 303)
KEY_BITS = 40  # of a shingle hash, for counting
COMMON = 8  # documents from which on a shingle is in the table of common ones
COMMON_ENTRIES = 1 << 20  # bound of that table (9 bytes an entry)
MAX_SEEN_BITS = 30  # bound of the bit table of shingles seen twice, as a power of two
STAR_ROUNDS = 3
STAR_MEETS = 3  # classes that a class is compared with in a round
SLICE_BYTES = 1 << 21


def prefix_length(n: int) -> int:
    """Tokens of a set of ``n`` of which a set with 100 * shared >= 80 * union holds one at least."""
    return n - (4 * n + 4) // 5 + 1


class Orders:
    """Global token orders: a power of two of the document count, then a seeded hash.

    ``seen`` has a bit per slot of the key space, set where a shingle of two documents or more falls;
    ``keys`` and ``levels`` are the commonest shingles.  Both are bounded tables.
    """

    def __init__(self, seen: np.ndarray, seen_bits: int, keys: np.ndarray, levels: np.ndarray):
        self.seen, self.seen_bits, self.keys, self.levels = seen, seen_bits, keys, levels

    def level(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens of one document only; growing with their number."""
        slot = tokens >> np.uint64(64 - self.seen_bits)
        level = (self.seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(np.uint64)
        at = np.flatnonzero(level)
        if len(self.keys) and len(at):
            key = tokens[at] >> np.uint64(64 - KEY_BITS)
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[where] == key
            level[at[hit]] = self.levels[where[hit]]
        return level

    def prefix(self, tokens: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
        """The tokens in the prefix of one sorted set that other documents may hold, in order.

        The tokens of this document alone stand before them.
        """
        size = prefix_length(len(tokens)) - int((level == 0).sum())
        if size <= 0:
            return tokens[:0]
        tokens, level = tokens[level > 0], level[level > 0]
        rank = level << np.uint64(58) | hashing.mix(tokens ^ np.uint64(ORDER_SEEDS[order])) >> np.uint64(6)
        return tokens[np.argsort(rank, kind="stable")[:size]]


def _sets(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    words, bounds = hashing.word_hashes(*hashing.column_bytes(batch.column(text)))
    return list(hashing.shingle_sets(words, bounds))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _class_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a sorted set."""
    spread = hashing.mix(tokens + np.uint64(len(tokens)))
    return int(_signed(hashing.mix(np.add.reduce(spread, dtype=np.uint64)[None] ^ np.uint64(len(tokens))))[0])


def _scan(bits: int) -> Callable:
    """Rows ``(row, n, cls)`` of documents and ``(part, blob)`` of their shingles."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(ROW, pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])
        for batch in stream:
            for piece in hashing.slices(batch, "text", SLICE_BYTES):
                sets = _sets(piece, "text")
                keys = [_class_key(s) if len(s) else None for s in sets]
                every = np.sort(np.concatenate([*sets, np.zeros(0, np.uint64)])) >> np.uint64(64 - KEY_BITS)
                sent = key_counts.blobs(every, KEY_BITS, bits)
                rows, blank = len(sets), [None] * len(sent)
                yield pa.RecordBatch.from_pydict({
                    ROW: piece.column(ROW).to_pylist() + blank,
                    "n": [len(s) for s in sets] + blank,
                    "cls": keys + blank,
                    "part": [None] * rows + [r for r, _ in sent],
                    "blob": [None] * rows + [b for _, b in sent],
                }, schema)

    return run


def _common(bits: int, seen_bits: int) -> Callable:
    """Of one range: the keys counted often, and the bits of all that were counted twice."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = key_counts.counted(table.column("blob").to_pylist())
        seen = np.zeros(max(8, 1 << (seen_bits - bits)), bool)
        slots = (keys[counts > 1] >> np.uint64(KEY_BITS - seen_bits)) - np.uint64(part << (seen_bits - bits))
        seen[slots] = True
        often = counts >= COMMON
        return pa.table({
            "part": [part] + [None] * int(often.sum()),
            "seen": [np.packbits(seen, bitorder="little").tobytes()] + [None] * int(often.sum()),
            "key": pa.array([None, *_signed(keys[often]).tolist()], pa.int64()),
            "n": pa.array([None, *counts[often].tolist()], pa.int64()),
        }, pa.schema([("part", pa.int32()), ("seen", pa.binary()), ("key", pa.int64()), ("n", pa.int64())]))

    return run


def _orders(counts: DataFrame, bits: int, seen_bits: int) -> Orders:
    """Both tables.  The commonest keys are those from the count on from which they fit the bound."""
    seen = np.zeros(1 << (seen_bits - 3), np.uint8)
    width = 1 << (seen_bits - bits - 3)
    for r in counts.where("part is not null").select("part", "seen").toLocalIterator():
        seen[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["seen"], np.uint8)
    level = F.floor(F.log2("n")).cast("int").alias("level")
    often = counts.where("key is not null")
    sizes = {r["level"]: r["count"] for r in often.groupBy(level).count().collect()}
    least, room = max(sizes, default=0) + 1, COMMON_ENTRIES
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    found = often.where(F.col("n") >= F.lit(2).cast("bigint") ** least).select("key", level).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Orders(seen, seen_bits, keys[order], found["level"].to_numpy()[order].astype(np.uint8))


def _first_prefixes(shared) -> Callable:
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = shared.value
        for batch in stream:
            for piece in hashing.slices(batch, "text", SLICE_BYTES):
                sets = [s for s in _sets(piece, "text") if len(s)]
                if not sets:
                    continue
                level = orders.level(np.concatenate(sets))
                at, tokens, classes = 0, [], []
                for s in sets:
                    first = orders.prefix(s, level[at:at + len(s)], 0)
                    at += len(s)
                    tokens.append(first)
                    classes.append(np.full(len(first), _class_key(s), np.int64))
                yield pa.RecordBatch.from_pydict(
                    {"token": _signed(np.concatenate(tokens)), "cls": np.concatenate(classes)})

    return run


def _blob_sets(shared) -> Callable:
    """Sets with their sizes, and how many of their tokens other documents may hold."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = shared.value
        for batch in stream:
            for piece in hashing.slices(batch, "text", SLICE_BYTES):
                sets = _sets(piece, "text")
                yield pa.RecordBatch.from_pydict({
                    "cls": piece.column("cls"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "open": pa.array([int((orders.level(s) > 0).sum()) for s in sets], pa.int64()),
                    "tokens": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})

    return run


def _all_prefixes(shared) -> Callable:
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = shared.value
        for batch in stream:
            for cls, comp, n, packed in zip(*(batch.column(c).to_pylist() for c in ("cls", "comp", "n", "tokens"))):
                s = np.frombuffer(packed, "<u8")
                level = orders.level(s)
                firsts = [orders.prefix(s, level, k) for k in range(len(ORDER_SEEDS))]
                size, alone = sum(map(len, firsts)), int((level == 0).sum())
                yield pa.RecordBatch.from_pydict({
                    "ord": np.repeat(np.arange(len(firsts), dtype=np.int32), list(map(len, firsts))),
                    "token": _signed(np.concatenate(firsts)), "cls": np.full(size, cls, np.int64),
                    "comp": np.full(size, comp, np.int64), "n": np.full(size, n, np.int64),
                    "rest": np.concatenate([n - alone - np.arange(len(f)) for f in firsts])})

    return run


def _links(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate pairs that are similar enough."""
    for batch in stream:
        keep = []
        for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b)`` that are links."""
    left = sets.select(F.col("cls").alias("ca"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("cls").alias("cb"), F.col("tokens").alias("tokens_b"))
    joined = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb"))
    return joined.select("a", "b", "tokens_a", "tokens_b").mapInArrow(_links, "a bigint, b bigint")


def _labels(sets: DataFrame, links: DataFrame, staging: Staging) -> DataFrame:
    """``(cls, n, open, comp)`` of every class that is left."""
    found = components(links, staging)
    return staging.keep(sets.select("cls", "n", "open").join(found, F.col("cls") == F.col("node"), "left").select(
        "cls", "n", "open", F.coalesce("label", "cls").alias("comp")), "labels")


def _star_pairs(hits: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``: per class the drawn holders of its open tokens that it shares most tokens with.

    Holders with few tokens of their own stand in the middle of their group, so they are likelier to
    be drawn; every turn draws anew, so a class meets other members of a large group.
    """
    chance = 0.5 + F.pmod(F.xxhash64(F.lit(turn), "cls"), F.lit(1 << 20)) / (1 << 20)
    rank = (chance * (F.col("n") - F.col("open") + 1) / F.col("n") * (1 << 28)).cast("bigint")
    draw = (F.shiftleft(rank, 32) + F.pmod(F.xxhash64("cls"), F.lit(1 << 32))).alias("draw")
    own = labels.select(F.col("cls").alias("c"), "n", "open", "comp", draw)
    held = hits.select("cls", "token").join(own, F.col("cls") == F.col("c"))
    drawn = held.groupBy(F.col("token").alias("t")).agg(
        F.min("draw").alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    named = labels.select(F.col("cls").alias("lead"), F.col("comp").alias("lead_comp"),
                          F.col("n").alias("lead_n"), F.col("open").alias("lead_open"), draw.alias("d"))
    drawn = drawn.join(named, F.col("first") == F.col("d")).select("t", "lead", "lead_comp", "lead_n", "lead_open")
    met = held.join(drawn, F.col("token") == F.col("t")).where(
        "comp <> lead_comp and 9 * least(open, lead_open) >= 4 * (n + lead_n)")
    met = met.groupBy("cls", "lead").agg(F.count(F.lit(1)).alias("k"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("k", "lead")), asc=False), 1, STAR_MEETS)
    return met.groupBy("cls").agg(most.alias("most")).select(F.col("cls").alias("a"), F.explode("most.lead").alias("b"))


def _open_tokens(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens that classes of different components share, with the smallest component."""
    return postings.groupBy(*keys).agg(F.min("comp").alias("lead"), F.max("comp").alias("last")).where(
        "lead < last").drop("last")


def similar_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      staging: Staging | None = None) -> DataFrame:
    """``(row, doc_id, n_shingles, component_id, class_id, group_id)`` of every row, in no order.

    ``class_id`` names equal sets, ``group_id`` the component; both are NULL for the empty set.
    """
    spark = df.sparkSession
    staging = staging or Staging(spark)
    docs = with_row(df).select(
        ROW, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = key_counts.range_bits(total)
    seen_bits = min(MAX_SEEN_BITS, max(bits + 3, (total // 6).bit_length()))
    with Staging(spark) as brief:
        scanned = brief.keep(docs.select(ROW, "text").mapInArrow(
            _scan(bits), f"{ROW} bigint, n bigint, cls bigint, part int, blob binary"), "scan")
        members = staging.keep(scanned.where(F.col(ROW).isNotNull()).select(ROW, "n", "cls"), "members")
        counts = brief.keep(scanned.where(F.col("part").isNotNull()).select("part", "blob").groupBy("part").applyInArrow(
            _common(bits, seen_bits), "part int, seen binary, key bigint, n bigint"), "counts")
        shared = spark.sparkContext.broadcast(_orders(counts, bits, seen_bits))

    firsts = staging.keep(docs.select("text").mapInArrow(_first_prefixes(shared), "token bigint, cls bigint"), "prefixes")
    mixed = staging.keep(_open_tokens(firsts.select("token", F.col("cls").alias("comp")), ["token"]), "mixed")
    hits = staging.keep(firsts.join(mixed.select(F.col("token").alias("t"), "lead"), F.col("token") == F.col("t"))
                        .select("cls", "token", "lead").distinct(), "hits")

    # one row of each class that shares a token, with its set
    rows = members.where("cls is not null").groupBy("cls").agg(F.min(ROW).alias("row"))
    wanted = rows.join(hits.select(F.col("cls").alias("hit")).distinct(), F.col("cls") == F.col("hit"), "left_semi")
    sets = staging.keep(docs.select(ROW, "text").join(wanted.hint("merge"), F.col(ROW) == F.col("row")).select("cls", "text")
                        .mapInArrow(_blob_sets(shared), "cls bigint, n bigint, open bigint, tokens binary"), "sets")

    links = None
    labels = sets.select("cls", "n", "open", F.col("cls").alias("comp"))
    for turn in range(STAR_ROUNDS):
        pairs = _star_pairs(hits, labels, turn)
        new = staging.keep(_verified(pairs, sets), "links")
        links = new if links is None else links.union(new)
        if turn and new.isEmpty():
            break
        labels = _labels(sets, links, staging)

    found = _exact_rest(sets, labels, shared, staging)
    labels = _labels(sets, links.union(found), staging)
    return _named(docs, members, labels, staging)


def _exact_rest(sets: DataFrame, labels: DataFrame, shared, staging: Staging) -> DataFrame:
    """Links between different components: prefixes under all orders, intersected, then verified."""
    comps = labels.select(F.col("cls").alias("c"), "comp")
    spread = sets.join(comps, F.col("cls") == F.col("c")).select("cls", "comp", "n", "tokens")
    postings = spread.mapInArrow(_all_prefixes(shared), "ord int, token bigint, cls bigint, comp bigint, n bigint, rest bigint")
    postings = staging.keep(postings, "all_prefixes")
    still = staging.keep(_open_tokens(postings, ["ord", "token"]), "open")
    still = still.select(F.col("ord").alias("o"), F.col("token").alias("t"))
    left = staging.keep(postings.join(still, (F.col("ord") == F.col("o")) & (F.col("token") == F.col("t")), "left_semi"), "left")
    x = left.select("ord", "token", F.col("cls").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    y = left.select(F.col("ord").alias("o"), F.col("token").alias("t"), F.col("cls").alias("b"),
                    F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    # 9 * shared >= 4 * (n_a + n_b) must be possible if this is the first token, in this order, that both hold
    enough = 9 * F.least("rest_a", "rest_b") >= 4 * (F.col("n_a") + F.col("n_b"))
    fits = (F.col("comp_a") < F.col("comp_b")) & enough
    met = x.join(y, (F.col("ord") == F.col("o")) & (F.col("token") == F.col("t")) & fits).select("a", "b", "ord")
    everywhere = met.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, ord)")).alias("seen"))
    pairs = staging.keep(everywhere.where(F.col("seen") == (1 << len(ORDER_SEEDS)) - 1).select("a", "b"), "candidates")
    return staging.keep(_verified(pairs, sets), "links")


def _named(docs: DataFrame, members: DataFrame, labels: DataFrame, staging: Staging) -> DataFrame:
    """Members with the smallest id of their component."""
    ids = docs.select(F.col(ROW).alias("r"), "doc_id")
    rows = members.join(ids, F.col(ROW) == F.col("r")).drop("r")
    rows = rows.join(labels.select(F.col("cls").alias("c"), "comp"), F.col("cls") == F.col("c"), "left")
    rows = staging.keep(rows.select(ROW, "doc_id", "n", "cls", F.coalesce("comp", "cls").alias("comp")), "rows")
    least = rows.where("comp is not null").groupBy(F.col("comp").alias("g")).agg(F.min("doc_id").alias("least"))
    return rows.join(least, F.col("comp") == F.col("g"), "left").select(
        ROW, "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.col("cls").alias("class_id"), F.col("comp").alias("group_id"),
    )


def one_per_component(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      staging: Staging | None = None) -> DataFrame:
    """The rows that are alone, and one of each component: the smallest id (NULL last), then the first row.

    Rows with an empty set are alone, whatever their ids.
    """
    staging = staging or Staging(df.sparkSession)
    found = similar_documents(df, doc_id, text, staging)
    best = found.where("class_id is not null").groupBy("group_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))).alias("first"))
    stay = best.select(F.col("first.row").alias("__llm_stay")).union(found.where("class_id is null").select(ROW))
    stay = staging.keep(stay, "stay")
    return with_row(df).join(stay.hint("merge"), F.col(ROW) == F.col("__llm_stay"), "left_semi").drop(ROW)
