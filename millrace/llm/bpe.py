"""Byte-level BPE encoding and decoding with public rank files.

A text is cut by the public pattern; each piece is merged by itself.  A segment tree over the byte
positions of the piece holds ``rank * width + position`` of the pair that starts there, so its root
is the leftmost pair of the lowest rank.  A merge removes one position and re-ranks the two live
neighbours: three point updates, each logarithmic in the length of the piece.  A piece of 100,000
letters costs some 5 million steps, not the square of its length.

Short pieces that a batch meets for the first time are merged together: the trees of all pieces of
one width are rows of one array, and each step merges the best pair of every row.

Words come back again and again, so the ids of what stands between single spaces are kept in a
bounded table.  A single space between two characters that are no white space always starts a new
piece, so cutting there first does not change the result.

The rank file is read by the driver and broadcast; it has some 50,000 short entries, a fixed size.

Defined results: NULL and empty texts have no ids; text that looks like a special token is ordinary
text; damaged UTF-8 is replaced before encoding; repeated rows are encoded like others.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import slices

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
KEPT_WORDS = 1 << 18  # entries of the table of known words, per worker
SLICE_BYTES = 1 << 20  # text split into words at a time
KEPT_CHARS = 48  # longer words are encoded anew

TOGETHER = 32  # bytes of the longest pieces that are merged many at a time
ROWS_TOGETHER = 1 << 14

_NONE = 1 << 62


def rank_file(name: str = RANK_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id; an id without a token is empty."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Codec:
    """Encode and decode with one table of ranks; keeps the words it has seen."""

    def __init__(self, tokens: list[bytes], pattern: str, kept_words: int = KEPT_WORDS):
        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens) if token}
        self.longest = max(map(len, self.ranks))
        self.cut = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        self.kept_words = kept_words
        self.known: dict[str, bytes | None] = {}  # words after a single space
        self.pieces: dict[str, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _rank_of_pairs(self, left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(valid & (self.pair_keys[at] == keys), self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces of at most ``TOGETHER`` bytes; one tree per row."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            for k in range(0, len(members), ROWS_TOGETHER):
                part = members[k:k + ROWS_TOGETHER]
                for i, packed in zip(part, self._merge_rows([pieces[i] for i in part], width)):
                    out[i] = packed
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        rows, shift = len(pieces), width.bit_length() - 1
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        n = np.array([len(p) for p in pieces], np.int64)
        ids = self.of_byte[raw]
        place = np.arange(width)
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        ranks = self._rank_of_pairs(ids[:, :-1], ids[:, 1:], place[1:] < n[:, None])
        tree[:, width:-1] = np.where(ranks < 0, _NONE, (ranks << shift) + place[:-1])
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.arange(rows)
        while True:
            best = tree[live, 1]
            going = best < _NONE
            live, best = live[going], best[going]
            if not len(live):
                break
            at = best & (width - 1)
            gone = after[live, at]
            end = after[live, gone]
            after[live, at] = end
            before[live, end] = at
            ids[live, at] = best >> shift
            first = before[live, at]
            right = self._rank_of_pairs(best >> shift, ids[live, np.minimum(end, width - 1)], end < n[live])
            left = self._rank_of_pairs(ids[live, np.maximum(first, 0)], best >> shift, first >= 0)
            none = np.full(len(live), -1)
            for start, rank in ((gone, none), (at, right), (np.where(first < 0, at, first), np.where(first < 0, right, left))):
                node = start + width
                tree[live, node] = np.where(rank < 0, _NONE, (rank << shift) + start)
                while shift and node[0] > 1:
                    node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        # a place is live when the place before it that is live ends there
        alive = (place < n[:, None]) & (after[np.arange(rows)[:, None], np.maximum(before[:, :width], 0)] == place)
        alive[:, 0] = True
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece, by a segment tree of pair ranks."""
        ranks, longest, n = self.ranks, self.longest, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        width = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after = list(range(1, n + 2))  # where the part that starts here ends
        before = list(range(-1, n))
        while (best := tree[1]) != _NONE:
            at = best & (width - 1)
            gone = after[at]
            end = after[gone]
            after[at] = end
            before[end] = at
            changes = [(gone, _NONE)]
            for start, stop in ((at, after[end] if end < n else 0), (before[at], end)):
                if start < 0:
                    continue
                rank = ranks.get(piece[start:stop]) if start < stop <= min(n, start + longest) else None
                changes.append((start, _NONE if rank is None else rank * width + start))
            for place, value in changes:
                node = place + width
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    node >>= 1
                    value = value if value < other else other
                    if tree[node] == value:
                        break
                    tree[node] = value
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at:after[at]]])
            at = after[at]
        return ids

    def _packed(self, text: str) -> bytes:
        """The packed ids of a text without the help of ``known``."""
        out = []
        for piece in self.cut(text):
            packed = self.pieces.get(piece)
            if packed is None:
                ids = self.merge(piece.encode())
                packed = struct.pack(f"<{len(ids)}I", *ids)
            out.append(packed)
        return b"".join(out)

    def learn(self, words: list[str]) -> dict[str, bytes | None]:
        """The packed ids of words after a single space; None if white space stands at an edge."""
        found: dict[str, bytes | None] = {}
        cut, fresh = {}, set()
        for word in words:
            if not word or self.space(word[0]) or self.space(word[-1]):
                found[word] = None
                continue
            cut[word] = pieces = self.cut(" " + word)
            fresh.update(pieces)
        fresh -= self.pieces.keys()
        if len(self.pieces) + len(fresh) > self.kept_words:
            self.pieces.clear()
            fresh = {p for pieces in cut.values() for p in pieces}
        short, local = [], {}
        for piece in fresh:
            raw = piece.encode()
            if len(raw) <= TOGETHER:
                short.append((piece, raw))
            else:
                ids = self.merge(raw)
                local[piece] = struct.pack(f"<{len(ids)}I", *ids)
        packed = dict(zip([p for p, _ in short], self.merge_many([r for _, r in short])))
        if len(packed) <= self.kept_words:
            self.pieces.update(packed)
        for word, pieces in cut.items():
            found[word] = b"".join([
                packed.get(p) or local.get(p) or self.pieces[p] for p in pieces])
        return found

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The packed ids of many texts."""
        split = [text.split(" ") for text in texts]
        fresh = set().union(*[words[1:] for words in split]) - self.known.keys() if split else set()
        if len(self.known) + len(fresh) > self.kept_words:
            self.known.clear()
            fresh = set().union(*[words[1:] for words in split])
        learnt = self.learn(list(fresh))
        for word in learnt:
            if len(word) <= KEPT_CHARS and len(self.known) < self.kept_words:
                self.known[word] = learnt[word]
        return [self._assemble(words, self.known, learnt) for words in split]

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def _assemble(self, words: list[str], known: dict, learnt: dict) -> bytes:
        parts = []
        for word in words[1:]:
            try:
                parts.append(known[word])
            except KeyError:
                parts.append(learnt[word])
        first_clean = bool(words[0]) and not self.space(words[0][-1])
        if first_clean and None not in parts:
            return self._packed(words[0]) + b"".join(parts)
        # where the space is no safe cut, the pattern cuts the whole stretch
        cuts = [0]
        for k in range(1, len(words)):
            left, right = words[k - 1], words[k]
            if left and right and not self.space(left[-1]) and not self.space(right[0]):
                cuts.append(k)
        out = []
        for start, stop in zip(cuts, [*cuts[1:], len(words)]):
            part = parts[start - 1] if start and stop == start + 1 else None
            if part is None:
                part = self._packed((" " if start else "") + " ".join(words[start:stop]))
            out.append(part)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(tokens: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(list(tokens), pattern)


class _Shared:
    """What the tasks of a worker share: one codec per rank table."""

    def __init__(self, spark, path: str | None, pattern: str | None):
        import public_tokenizers

        self.tokens = spark.sparkContext.broadcast(tuple(read_ranks(path or rank_file())))
        self.pattern = pattern or public_tokenizers.PATTERN

    def codec(self) -> Codec:
        return _codec(self.tokens.value, self.pattern)


def _ids(packed: list[bytes]) -> pa.Array:
    offsets, total = [0], 0
    for p in packed:
        total += len(p) // 4
        offsets.append(total)
    values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _texts(column: pa.Array) -> Iterator[str]:
    return ((value or b"").decode("utf-8", "replace") for value in column.to_pylist())


def _run(df: DataFrame, needs: dict, gives: dict[str, str], work, cut=lambda batch: slices(batch, "__llm_bytes", SLICE_BYTES)) -> DataFrame:
    """Replace the columns ``needs`` computes by those that ``work`` gives, batch by batch."""
    taken = {n.lower() for n in gives}
    kept = [c for c in df.columns if c.lower() not in taken]
    given = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in needs.items()])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{n}` {t}" for n, t in gives.items()])

    def batches(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in cut(batch):
                done = work(piece)
                columns = [piece.column(i) for i in range(len(kept))] + [done[n] for n in gives]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *gives])

    return given.mapInArrow(batches, schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The input with ``ids`` (array of int) and ``n_tokens``."""
    shared = _Shared(df.sparkSession, path, pattern)

    def work(batch):
        codec = shared.codec()
        packed = codec.encode_all(_texts(batch.column("__llm_bytes")))
        return {"ids": _ids(packed), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}

    needs = {"__llm_bytes": F.col(f"`{text}`").cast("string").cast("binary")}
    return _run(df, needs, {"ids": "array<int>", "n_tokens": "bigint"}, work)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The input with ``decoded`` (binary); NULL ids are no ids."""
    shared = _Shared(df.sparkSession, path, pattern)

    def work(batch):
        codec = shared.codec()
        lists = batch.column("__llm_ids").to_pylist()
        return {"decoded": pa.array([b"".join([codec.tokens[i] for i in ids or ()]) for ids in lists], pa.binary())}

    def cut(batch):
        return (batch.slice(i, 64) for i in range(0, batch.num_rows, 64))

    return _run(df, {"__llm_ids": F.col(f"`{ids}`")}, {"decoded": "binary"}, work, cut)


def digests(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, then decode the ids: the input with ``n_tokens`` and the hashes of both results."""
    shared = _Shared(df.sparkSession, path, pattern)

    def work(batch):
        codec = shared.codec()
        counts, ids, decoded = [], [], []
        for packed in codec.encode_all(_texts(batch.column("__llm_bytes"))):
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string())}

    needs = {"__llm_bytes": F.col(f"`{text}`").cast("string").cast("binary")}
    return _run(df, needs, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, work)
