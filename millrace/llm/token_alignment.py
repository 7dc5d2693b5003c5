"""Alignment of two tokenizers over a corpus: which tokens of one cover the same text as which of the other.

Both encode the same bytes, a space and the text.  Where a token of either ends at the same byte, the text
is cut into groups; all tokens of a group are linked with each other.

1. The table is grouped by the *full text* (one shuffle of texts, equal ones combined before it).  Each
   distinct text is tokenised and aligned once, by arrays over a slice of texts at a time.
2. Distinct texts are packed in *units* of about ``UNIT_BYTES``: their measures, their links as numbers, and
   the unit's distinct id pairs with how many documents hold them - a text counts as often as it occurs.
   The units are written once; nothing is tokenised again.
3. Pairs of all units are added up by pair, with the highest count per id of the first tokenizer.
4. The sums come back to the units, which add them up per text.  A pair is one row per unit on both
   ways, however many documents hold it.
5. Measures join the ids of the documents by the SHA-256 of the text.  Texts that at least one document
   in ``HOT_SHARE`` has are at most ``HOT_SHARE`` rows; these are broadcast, so a text of a third of all
   documents is no hot key.  The others are joined by a shuffle of ids and digests.

Defined results: NULL and empty texts, and texts that a tokenizer does not give back byte by byte, have no
tokens: zeros and an empty digest.  Names of special tokens in a text are ordinary text.  Repeated rows
count as documents.  A NULL id stays NULL.  Input columns beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import pack_numbers, slices, unpack_numbers
from millrace.staging import Staging

BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
UNIT_BYTES = 4 << 20  # text of a unit
SLICE_BYTES = 1 << 20  # text aligned at a time
PAIRS_AT_ONCE = 1 << 22
HOT_SHARE = 1000
ID_BITS = 20  # of the second tokenizer's ids in a pair

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: themselves if printable, else those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """A byte-level BPE file.  Its ids are in merge order, so they serve as ranks."""

    def __init__(self, content: str, pattern: str):
        import tiktoken

        model = json.loads(content)["model"]
        special = {t["id"] for t in json.loads(content)["added_tokens"]}
        letters = _byte_letters()
        self.tokens = [b""] * (1 + max(model["vocab"].values()))
        for word, number in model["vocab"].items():
            if number not in special:
                self.tokens[number] = bytes(letters[c] for c in word)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        places = [model["vocab"][a + b] for a, b in merges]
        if places != sorted(places):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        ranks = {t: k for k, t in enumerate(self.tokens) if t}
        self._encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokenizer:
    """A piece model with byte fallback; it puts the space before the text itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.tokens = [self._bytes(self._model.id_to_piece(k)) for k in range(self._model.get_piece_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def _tokenizers(content_a: str, pattern: str, content_b: bytes) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(content_a, pattern), PieceTokenizer(content_b)


class _Files:
    """Both vocabulary files, some two megabytes, sent to the workers once."""

    def __init__(self, spark, path_a: str | None, path_b: str | None):
        import public_tokenizers

        with open(path_a or public_tokenizers.path(BYTE_FILE), encoding="utf-8") as a, open(path_b or public_tokenizers.path(PIECE_FILE), "rb") as b:
            self._shared = spark.sparkContext.broadcast((a.read(), public_tokenizers.PATTERN, b.read()))

    def both(self) -> tuple[ByteTokenizer, PieceTokenizer]:
        return _tokenizers(*self._shared.value)


class Side:
    """The tokens of a slice of texts by one tokenizer, end to end."""

    def __init__(self, ids: list[list[int]], sizes: np.ndarray, base: np.ndarray):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.fromiter((i for x in ids for i in x), np.int64, int(self.counts.sum()))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        # where tokens end in the bytes of the slice; the bytes of a text begin at its base
        total = np.cumsum(sizes[self.ids])
        self.ends = total + base[0] if len(total) else total


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of numbers below a million, right-aligned, and which of them are written."""
    powers = 10 ** np.arange(5, -1, -1)
    rows = ids[:, None] // powers
    return (rows % 10 + 48).astype(np.uint8), (rows > 0) | (powers == 1)


def _written(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2``: the groups of a text; groups are numbered along the text."""
    ids = np.concatenate([a, b])
    side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    order = np.argsort(np.concatenate([group_a, group_b]) * 2 + side, kind="stable")
    ids, side = ids[order], side[order]
    digits, shown = _digits(ids)
    last = np.append(side[1:] != side[:-1], True)
    after = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    cells = np.column_stack([digits, after])
    return cells[np.column_stack([shown, np.ones(len(ids), bool)])].tobytes()[:-1]


def _linked(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, groups: int) -> Iterator[np.ndarray]:
    """Pair keys of all links of the groups, in runs of some ``PAIRS_AT_ONCE``; both sides are sorted by group."""
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    first = np.cumsum(nb) - nb
    fan = nb[ga]  # partners of every a
    done = np.cumsum(fan)
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(done, done[at] - fan[at] + PAIRS_AT_ONCE, "right")))
        part = fan[at:stop]
        inside = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
        partner = np.repeat(first[ga[at:stop]], part) + inside
        yield np.repeat(a[at:stop], part) << ID_BITS | b[partner]
        at = stop


class Aligned:
    """What the alignment of a slice of texts gives, text by text."""

    def __init__(self, texts: list[str], a: ByteTokenizer, b: PieceTokenizer, sizes_a: np.ndarray, sizes_b: np.ndarray):
        wanted = [b" " + t.encode("utf-8") for t in texts]
        ids_a, ids_b = a.encode(texts), b.encode(texts)
        for k, whole in enumerate(wanted):
            if b"".join(map(a.tokens.__getitem__, ids_a[k])) != whole or b"".join(map(b.tokens.__getitem__, ids_b[k])) != whole:
                ids_a[k], ids_b[k], wanted[k] = [], [], b""
        ends = np.cumsum([len(w) for w in wanted])
        base = np.concatenate([[0], ends[:-1]])
        self.a, self.b = Side(ids_a, sizes_a, base), Side(ids_b, sizes_b, base)
        cuts = np.intersect1d(self.a.ends, self.b.ends, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, self.a.ends), np.searchsorted(cuts, self.b.ends)
        self.n_groups = np.diff(np.searchsorted(cuts, np.concatenate([[0], ends]), "right"))
        per_group = np.bincount(self.group_a, minlength=len(cuts)) * np.bincount(self.group_b, minlength=len(cuts))
        total = np.concatenate([[0], np.cumsum(per_group)])
        bounds = np.concatenate([[0], np.cumsum(self.n_groups)])
        self.n_links = total[bounds[1:]] - total[bounds[:-1]]
        self._bounds = bounds

    def of(self, k: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The written groups of a text, its distinct pairs and how often each is linked."""
        at_a, at_b = slice(*self.a.starts[k:k + 2]), slice(*self.b.starts[k:k + 2])
        first, groups = self._bounds[k], int(self.n_groups[k])
        if not groups:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        ga, gb = self.group_a[at_a] - first, self.group_b[at_b] - first
        a, b = self.a.ids[at_a], self.b.ids[at_b]
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for run in _linked(ga, a, gb, b, groups):
            own, n = np.unique(run, return_counts=True)
            if len(keys):
                keys, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
                n = np.bincount(place, np.concatenate([times, n])).astype(np.int64)
            else:
                keys = own
            times = n
        return _written(a, ga, b, gb), keys, times


_UNIT = pa.schema([
    ("unit", pa.int64()), ("n_texts", pa.int64()), ("digests", pa.binary()), ("shas", pa.binary()), ("counts", pa.binary()),
    ("pairs", pa.binary()), ("link_counts", pa.binary()), ("links", pa.binary()), ("times", pa.binary()), ("copies", pa.binary()),
    ("keys", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])
_UNIT_DDL = ("unit bigint, n_texts bigint, digests binary, shas binary, counts binary, pairs binary, link_counts binary, "
             "links binary, times binary, copies binary, keys array<bigint>, weights array<bigint>")


def _unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


class _Unit:
    """Texts gathered until there are enough of them."""

    def __init__(self):
        self.bytes = 0
        self.digests, self.shas, self.copies, self.counts = [], [], [], []
        self.keys, self.times = [], []

    def add(self, text: str, copies: int, counts: tuple, groups: bytes, keys: np.ndarray, times: np.ndarray) -> None:
        whole = text.encode("utf-8")
        self.bytes += len(whole)
        self.digests.append(hashlib.sha256(whole).digest())
        self.shas.append(hashlib.sha256(groups).digest())
        self.copies.append(copies)
        self.counts.append(counts)
        self.keys.append(keys)
        self.times.append(times)

    def row(self, number: int) -> pa.RecordBatch:
        held = np.array([len(k) for k in self.keys], np.int64)
        every = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        copies = np.array(self.copies, np.int64)
        keys, place = np.unique(every, return_inverse=True)
        # exact: counts of documents are far below 2^53
        weights = np.bincount(place, np.repeat(copies, held), len(keys)).astype(np.int64)
        # places grow within a text, so all links are one growing row of numbers
        links = place + np.repeat(np.arange(len(held)) * max(1, len(keys)), held)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"".join(self.digests)], pa.binary()),
            pa.array([b"".join(self.shas)], pa.binary()), pa.array([pack_numbers(_unsigned(np.array(self.counts, np.int64).ravel()))], pa.binary()),
            pa.array([pack_numbers(np.diff(_unsigned(keys), prepend=np.uint64(0)))], pa.binary()), pa.array([pack_numbers(_unsigned(held))], pa.binary()),
            pa.array([pack_numbers(np.diff(_unsigned(links), prepend=np.uint64(0)))], pa.binary()),
            pa.array([pack_numbers(_unsigned(np.concatenate([*self.times, np.zeros(0, np.int64)])))], pa.binary()),
            pa.array([pack_numbers(_unsigned(copies))], pa.binary()),
            pa.array([keys], pa.list_(pa.int64())), pa.array([weights], pa.list_(pa.int64()))], schema=_UNIT)


def _align(files: _Files, unit_bytes: int):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = files.both()
        sizes_a, sizes_b = (np.array([len(x) for x in t.tokens], np.int64) for t in (a, b))
        number, unit = TaskContext.get().partitionId() << 32, _Unit()
        for batch in stream:
            for piece in slices(batch, "body", SLICE_BYTES):
                texts = [t.decode("utf-8", "replace") for t in piece.column("body").to_pylist()]
                done = Aligned(texts, a, b, sizes_a, sizes_b)
                for k, (text, copies) in enumerate(zip(texts, piece.column("copies").to_pylist())):
                    counts = (done.a.counts[k], done.b.counts[k], done.n_groups[k], done.n_links[k])
                    unit.add(text, copies, counts, *done.of(k))
                    if unit.bytes >= unit_bytes:
                        yield unit.row(number)
                        number, unit = number + 1, _Unit()
        if unit.digests:
            yield unit.row(number)

    return run


_MEASURED = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), *[(m, pa.int64()) for m in MEASURES], ("groups_sha256", pa.string())])
_MEASURED_DDL = "digest binary, copies bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", groups_sha256 string"


def _measures(units: pa.Table, sums: pa.Table) -> pa.Table:
    """The measures of the texts of a unit, from its links and the sums of its pairs."""
    unit = units.to_pylist()[0]
    keys = np.cumsum(unpack_numbers(unit["pairs"]), dtype=np.uint64).view(np.int64)
    order = np.argsort(sums.column("key").to_numpy())
    total, best = sums.column("total").to_numpy()[order], sums.column("best").to_numpy(zero_copy_only=False)[order]
    held = unpack_numbers(unit["link_counts"]).astype(np.int64)
    links = np.cumsum(unpack_numbers(unit["links"]), dtype=np.uint64).astype(np.int64)
    place = links - np.repeat(np.arange(len(held)) * max(1, len(keys)), held)
    times = unpack_numbers(unit["times"]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(held)])

    def per_text(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values)])
        return run[starts[1:]] - run[starts[:-1]]

    counts = unpack_numbers(unit["counts"]).astype(np.int64).reshape(-1, 4)
    n = unit["n_texts"]
    parts = [*counts.T, per_text(np.where(best[place], times, 0)), per_text(times * total[place])]
    return pa.table([
        pa.array([unit["digests"][32 * k:32 * k + 32] for k in range(n)], pa.binary()), pa.array(unpack_numbers(unit["copies"]).astype(np.int64)),
        *[pa.array(p, pa.int64()) for p in parts],
        pa.array([unit["shas"][32 * k:32 * k + 32].hex() if counts[k, 0] else "" for k in range(n)], pa.string())], schema=_MEASURED)


def aligned_units(df: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None,
                  unit_bytes: int = UNIT_BYTES, staging: Staging | None = None) -> DataFrame:
    """The distinct texts of a table, tokenised and aligned once, in written units."""
    staging = staging or Staging(df.sparkSession)
    files = _Files(df.sparkSession, path_a, path_b)
    texts = df.select(F.col(f"`{text}`").cast("string").alias("body")).where("body <> ''").groupBy("body").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select(F.col("body").cast("binary").alias("body"), "copies")
    return staging.keep(texts.mapInArrow(_align(files, unit_bytes), _UNIT_DDL), "units")


def pair_counts(units: DataFrame, staging: Staging) -> DataFrame:
    """``(key, total, best)``: documents that hold a pair, and whether no pair of its first id has more."""
    held = units.select(F.explode(F.arrays_zip("keys", "weights")).alias("p"))
    totals = staging.keep(held.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.weights").alias("total")), "totals")
    first = F.shiftright("key", ID_BITS)
    most = totals.groupBy(first.alias("a")).agg(F.max("total").alias("most"))
    return staging.keep(totals.join(most, first == F.col("a")).select("key", "total", (F.col("total") == F.col("most")).alias("best")), "sums")


def align(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
          unit_bytes: int = UNIT_BYTES, staging: Staging | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row, in no order."""
    staging = staging or Staging(df.sparkSession)
    units = aligned_units(df, text, path_a, path_b, unit_bytes, staging)
    sums = pair_counts(units, staging)
    asked = units.select("unit", F.explode("keys").alias("k"))
    answers = asked.join(sums, F.col("k") == F.col("key")).select(F.col("unit").alias("u"), "key", "total", "best")
    plain = units.drop("keys", "weights")
    # a unit without pairs has no answers: the other side of the group is then an empty table
    measured = staging.keep(plain.groupBy("unit").cogroup(answers.groupBy("u")).applyInArrow(_measures, _MEASURED_DDL), "measures")

    body = F.col(f"`{text}`").cast("string")
    digest = F.when(body != "", F.unhex(F.sha2(body.cast("binary"), 256)))
    members = staging.keep(df.select(F.col(f"`{doc_id}`").alias("doc_id"), digest.alias("d")), "members")
    everyone = members.count()
    hot = F.col("copies") * HOT_SHARE >= everyone
    known = measured.where(hot), measured.where(~hot)
    frequent = F.broadcast(known[0])  # HOT_SHARE rows at most
    zero = [F.lit(0).cast("bigint").alias(m) for m in MEASURES]
    columns = ["doc_id", *MEASURES, "groups_sha256"]
    without = members.where("d is null").select("doc_id", *zero, F.lit("").alias("groups_sha256"))
    named = members.where("d is not null")
    often = named.join(frequent, F.col("d") == F.col("digest")).select(*columns)
    rare = named.join(F.broadcast(known[0].select(F.col("digest").alias("h"))), F.col("d") == F.col("h"), "left_anti").join(
        known[1], F.col("d") == F.col("digest")).select(*columns)
    return without.unionByName(often).unionByName(rare)
