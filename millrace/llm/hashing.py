"""Words and word shingles of whole texts as 64-bit hashes, computed in arrays of a batch at a time.

Words are runs of bytes between ASCII white space, with A-Z lower-cased; the text is never decoded,
so damaged UTF-8 does no harm.  Long texts are hashed in blocks cut at white space, so the working
memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes hashed at a time
SHINGLE = 5

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit numbers so that every input bit reaches every output bit."""
    x = np.array(x, _U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OF_BYTE = _stream(11, 256)
_OF_BYTE[65:91] = _OF_BYTE[97:123]  # A-Z hash as a-z
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = _stream(23, 64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its values; NULL is empty."""
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words."""
    found, places, at, size = [], [], 0, len(data)
    while at < size:
        stop = min(size, at + BLOCK)
        while stop < size and not _IS_SPACE[data[stop]]:
            ahead = np.flatnonzero(_IS_SPACE[data[stop:stop + BLOCK]])
            stop = stop + int(ahead[0]) if len(ahead) else min(size, stop + BLOCK)
        block = data[at:stop]
        space = _IS_SPACE[block]
        split = np.zeros(len(block) + 1, bool)
        inner = offsets[(offsets >= at) & (offsets <= stop)] - at
        split[inner] = True
        split[0] = split[-1] = True
        split[1:-1] |= space[:-1] | space[1:]
        starts = np.flatnonzero(split[:-1] & ~space)
        ends = np.flatnonzero(split[1:] & ~space) + 1
        up, down = _power(len(block))
        sums = np.zeros(len(block) + 1, _U)
        np.cumsum(_OF_BYTE[block] * up, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        found.append(mix(hashes + (ends - starts).astype(_U) * _FACTORS[60]))
        places.append(starts + at)
        at = stop
    if not found:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every position on (positions near the end lack words)."""
    total = np.zeros(len(words), _U)
    for k in range(min(n, len(words))):
        total[:len(words) - k] += words[k:] * _FACTORS[k]
    return mix(total + _U(n))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text its distinct shingles, sorted; with fewer words the whole sequence is one."""
    hashes = ngram_hashes(words, size)
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if stop - start >= size:
            yield np.unique(hashes[start:stop - size + 1])
        elif stop > start:
            yield ngram_hashes(words[start:stop], stop - start)[:1]
        else:
            yield hashes[:0]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their low bytes, next bytes and so on, compressed.

    Small numbers have high planes of zeros, and what is left of a plane is coded by its entropy.
    """
    wide = numbers.astype("<u8")
    planes = wide.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(wide).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_numbers(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack_numbers(np.diff(keys, prepend=_U(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(packed), dtype=_U)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``limit`` bytes together."""
    _, offsets = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
