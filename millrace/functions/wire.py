"""Records to binary payloads and back: the protobuf wire format and MessagePack.

Encoding is one column expression per record (only floats take their bits from Arrow batches); decoding reads
Arrow batches of payloads.  Neither needs a descriptor file or a module that is not part of Spark.

Protobuf: the fields of a record are numbered from 1 in their order, integers and booleans are varints (zig-zag
for those named so), floats are fixed, strings and bytes have a length.  As in proto3, zero values and NULL are not
written, and what is absent is read as the zero value.  Fields with other numbers are skipped, of a repeated one
the last counts, and a number too wide for its column keeps its low bits.

MessagePack: a map from names to values, in the shortest form; NULL is nil.  Other keys are skipped, absent ones
are NULL, and a number that its column can't hold is an error.

Decoded rows are ``(record, error)``: NULL and NULL for a payload that is not there, a NULL record and ``cut``
or ``damaged`` for one that ends too early or can't be read.  Empty bytes are a record of zero values in
protobuf, and cut in MessagePack.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CUT, DAMAGED = "cut", "damaged"

_BITS = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}
_FLOATS = {T.FloatType(): 4, T.DoubleType(): 8}
_BYTES = (T.StringType(), T.BinaryType())


class Cut(ValueError):
    """The payload ends inside a value."""


def _check(schema: T.StructType) -> None:
    for f in schema.fields:
        if f.dataType not in _BITS and f.dataType not in _FLOATS and f.dataType not in _BYTES and f.dataType != T.BooleanType():
            raise ValueError(f"column {f.name}: no binary form of {f.dataType.simpleString()}")


def _float_bits(value: Column, width: int, order: str) -> Column:
    """IEEE bytes of a float column, in the byte order ``<`` or ``>``."""

    def bits(values: pa.Array) -> pa.Array:
        raw = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(f"{order}f{width}").tobytes()
        return pa.array([raw[i:i + width] for i in range(0, len(raw), width)], pa.binary())

    return F.arrow_udf(bits, "binary")(value)


# -- protobuf ------------------------------------------------------------------------------------


def varint(number: Column) -> Column:
    """A bigint as an unsigned varint: seven bits a byte, low ones first, negative numbers in ten bytes."""
    digits = []
    for k in range(10):
        rest = F.shiftrightunsigned(number, 7 * k)
        more = F.shiftrightunsigned(number, 7 * (k + 1)) != 0 if k < 9 else F.lit(False)
        byte = rest.bitwiseAND(F.lit(127)) + F.when(more, 128).otherwise(0)
        digit = F.lpad(F.hex(byte.cast("bigint")), 2, "0")
        digits.append(digit if k == 0 else F.when(rest != 0, digit).otherwise(""))
    return F.unhex(F.concat(*digits))


def zigzag(number: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..."""
    return F.shiftleft(number, 1).bitwiseXOR(F.shiftright(number, 63))


def _key(number: int, wire: int) -> Column:
    key, out = number << 3 | wire, bytearray()
    while key > 127:
        out.append(key & 127 | 128)
        key >>= 7
    return F.lit(bytes(out) + bytes([key]))


def to_protobuf_bytes(schema: T.StructType, zigzagged: Collection[str] = ()) -> Column:
    """The columns named in ``schema`` as one protobuf message."""
    _check(schema)
    parts = [F.lit(b"")]
    for number, f in enumerate(schema.fields, 1):
        value = F.col(f"`{f.name}`")
        if f.dataType in _FLOATS:
            width = _FLOATS[f.dataType]
            body = _float_bits(value, width, "<")
            written, key = value.isNotNull() & (body != F.lit(bytes(width))), _key(number, 1 if width == 8 else 5)
        elif f.dataType in _BYTES:
            content = value.cast("binary")
            body = F.concat(varint(F.octet_length(content).cast("bigint")), content)
            written, key = F.octet_length(content) > 0, _key(number, 2)
        else:
            plain = value.cast("bigint")
            body = varint(zigzag(plain) if f.name in zigzagged else plain)
            written, key = plain != 0, _key(number, 0)
        parts.append(F.when(written, F.concat(key, body)).otherwise(F.lit(b"")))
    return F.concat(*parts)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise Cut
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & (1 << 64) - 1, at
    raise ValueError("a varint of more than ten bytes")


def _take(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    if at + size > len(data):
        raise Cut
    return data[at:at + size], at + size


def _low_bits(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def _protobuf_reader(schema: T.StructType, zigzagged: Collection[str]) -> Callable[[bytes], list]:
    kinds = {n: (f.dataType, f.name in zigzagged) for n, f in enumerate(schema.fields, 1)}
    wires = {n: 0 if k in _BITS or k == T.BooleanType() else 2 if k in _BYTES else 1 if k == T.DoubleType() else 5
             for n, (k, _) in kinds.items()}
    zeros = ["" if k == T.StringType() else b"" if k == T.BinaryType() else False if k == T.BooleanType()
             else 0.0 if k in _FLOATS else 0 for k, _ in kinds.values()]

    def read(data: bytes) -> list:
        record, at = list(zeros), 0
        while at < len(data):
            key, at = _read_varint(data, at)
            number, wire = key >> 3, key & 7
            if wire == 0:
                value, at = _read_varint(data, at)
            elif wire == 2:
                size, at = _read_varint(data, at)
                value, at = _take(data, at, size)
            elif wire in (1, 5):
                value, at = _take(data, at, 8 if wire == 1 else 4)
            else:
                raise ValueError(f"wire type {wire}")
            if not number or number >> 29:
                raise ValueError(f"field number {number}")
            if number not in kinds:
                continue
            kind, zig = kinds[number]
            if wire != wires[number]:
                raise ValueError(f"field {number} has wire type {wire}")
            if kind in _BITS:
                value = _low_bits(value >> 1 ^ -(value & 1) if zig else value, _BITS[kind])
            elif kind == T.BooleanType():
                value = value != 0
            elif kind == T.StringType():
                value = value.decode()
            elif kind in _FLOATS:
                value = struct.unpack("<d" if wire == 1 else "<f", value)[0]
            record[number - 1] = value
        return record

    return read


# -- MessagePack ---------------------------------------------------------------------------------


def _big_endian(number: Column, width: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(number.cast("bigint")), 16, "0"), F.lit(2 * width)))


def _sized(number: Column, size: Column, forms: list[tuple[int, int, int]]) -> Column:
    """The number in the first form ``(limit, lead byte, width)`` whose limit its size does not reach, or the last."""
    written = [F.concat(F.lit(bytes([lead])), _big_endian(number, width)) for _, lead, width in forms]
    out = written[-1]
    for (limit, _, _), form in reversed(list(zip(forms, written))[:-1]):
        out = F.when(size < limit, form).otherwise(out)
    return out


def _pack_int(n: Column) -> Column:
    large = _sized(n, n, [(1 << 8, 0xCC, 1), (1 << 16, 0xCD, 2), (1 << 32, 0xCE, 4), (0, 0xCF, 8)])
    small = _sized(n, F.bitwise_not(n), [(1 << 7, 0xD0, 1), (1 << 15, 0xD1, 2), (1 << 31, 0xD2, 4), (0, 0xD3, 8)])
    return F.when((n >= -32) & (n < 128), _big_endian(n, 1)).when(n >= 0, large).otherwise(small)


def _pack_bytes(content: Column, text: bool) -> Column:
    n = F.octet_length(content).cast("bigint")
    forms = [(1 << 8, 0xD9 if text else 0xC4, 1), (1 << 16, 0xDA if text else 0xC5, 2), (0, 0xDB if text else 0xC6, 4)]
    head = _sized(n, n, forms)
    return F.concat(F.when(n < 32, _big_endian(n + 0xA0, 1)).otherwise(head) if text else head, content)


def _text(name: str) -> bytes:
    raw = name.encode()
    if len(raw) > 255:
        raise ValueError(f"column {name[:20]}...: the name is too long")
    return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else bytes([0xD9, len(raw)])) + raw


def to_msgpack_bytes(schema: T.StructType) -> Column:
    """The columns named in ``schema`` as one MessagePack map."""
    _check(schema)
    size = len(schema.fields)
    parts = [F.lit(bytes([0x80 | size]) if size < 16 else bytes([0xDE]) + size.to_bytes(2, "big"))]
    for f in schema.fields:
        value = F.col(f"`{f.name}`")
        if f.dataType in _BITS:
            body = _pack_int(value.cast("bigint"))
        elif f.dataType == T.BooleanType():
            body = F.when(value, F.lit(b"\xc3")).otherwise(F.lit(b"\xc2"))
        elif f.dataType in _FLOATS:
            width = _FLOATS[f.dataType]
            body = F.concat(F.lit(b"\xcb" if width == 8 else b"\xca"), _float_bits(value, width, ">"))
        else:
            body = _pack_bytes(value.cast("binary"), f.dataType == T.StringType())
        parts += [F.lit(_text(f.name)), F.when(value.isNull(), F.lit(b"\xc0")).otherwise(body)]
    return F.concat(*parts)


_DEPTH = 64  # of maps and arrays in what is skipped


def _unpack(data: bytes, at: int, depth: int = 0):
    """``(value, next position)``; extensions are read as their bytes."""
    lead, at = _take(data, at, 1)
    lead = lead[0]
    if lead < 0x80:
        return lead, at
    if lead >= 0xE0:
        return lead - 256, at
    if lead in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[lead], at
    if lead in (0xCA, 0xCB):
        raw, at = _take(data, at, 4 if lead == 0xCA else 8)
        return struct.unpack(">f" if lead == 0xCA else ">d", raw)[0], at
    if 0xCC <= lead <= 0xD3:
        raw, at = _take(data, at, 1 << (lead - 0xCC) % 4)
        return int.from_bytes(raw, "big", signed=lead >= 0xD0), at
    if 0xD4 <= lead <= 0xD8:
        return _take(data, at, 1 + (1 << lead - 0xD4))
    if 0xA0 <= lead < 0xC0 or 0xD9 <= lead <= 0xDB or 0xC4 <= lead <= 0xC9:
        size = lead & 31
        if lead >= 0xC4:
            raw, at = _take(data, at, 1 << (lead - (0xD9 if lead >= 0xD9 else 0xC4 if lead < 0xC7 else 0xC7)))
            size = int.from_bytes(raw, "big") + (0xC7 <= lead <= 0xC9)
        raw, at = _take(data, at, size)
        return (raw if 0xC4 <= lead <= 0xC9 else raw.decode()), at
    if 0x80 <= lead < 0xA0 or 0xDC <= lead <= 0xDF:
        if depth == _DEPTH:
            raise ValueError("too deep")
        size, pairs = lead & 15, lead < 0x90 or lead >= 0xDE
        if lead >= 0xDC:
            raw, at = _take(data, at, 2 if lead in (0xDC, 0xDE) else 4)
            size = int.from_bytes(raw, "big")
        items = []
        for _ in range(size * 2 if pairs else size):
            item, at = _unpack(data, at, depth + 1)
            items.append(item)
        return (list(zip(items[::2], items[1::2])) if pairs else items), at
    raise ValueError(f"lead byte {lead}")


def _msgpack_reader(schema: T.StructType) -> Callable[[bytes], list]:
    places = {f.name: (i, f.dataType) for i, f in enumerate(schema.fields)}

    def fit(value, kind):
        if value is None:
            return None
        if kind in _BITS and type(value) is int and -(1 << _BITS[kind] - 1) <= value < 1 << _BITS[kind] - 1:
            return value
        if kind in _FLOATS and type(value) in (int, float):
            return float(value)
        if type(value) is {T.BooleanType(): bool, T.StringType(): str, T.BinaryType(): bytes}.get(kind):
            return value
        raise ValueError(f"{type(value).__name__} for {kind.simpleString()}")

    def read(data: bytes) -> list:
        if data and not (0x80 <= data[0] < 0x90 or data[0] in (0xDE, 0xDF)):
            raise ValueError("not a map")
        pairs, at = _unpack(data, 0)
        if at != len(data):
            raise ValueError("bytes behind the map")
        record: list = [None] * len(places)
        for name, value in pairs:
            if type(name) is str and name in places:
                place, kind = places[name]
                record[place] = fit(value, kind)
        return record

    return read


# -- decoding ------------------------------------------------------------------------------------


def _decoder(payload: Column, schema: T.StructType, make: Callable[[], Callable[[bytes], list]]) -> Column:
    _check(schema)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = [f.name for f in schema.fields]

    def decode(payloads: pa.Array) -> pa.Array:
        read = make()
        rows, errors = [], []
        for data in payloads.to_pylist():
            row = error = None
            if data is not None:
                try:
                    row = read(data)
                except Cut:
                    error = CUT
                except (ValueError, OverflowError):
                    error = DAMAGED
            rows.append(row)
            errors.append(error)
        columns = [pa.array([r[i] if r else None for r in rows], kind) for i, kind in enumerate(kinds)]
        missing = pa.array(np.array([r is None for r in rows], bool))
        return pa.StructArray.from_arrays(
            [pa.StructArray.from_arrays(columns, names, mask=missing), pa.array(errors, pa.string())], ["record", "error"])

    return F.arrow_udf(decode, T.StructType().add("record", schema).add("error", T.StringType()))(payload)


def from_protobuf_bytes(payload: Column, schema: T.StructType, zigzagged: Collection[str] = ()) -> Column:
    """``(record, error)`` of protobuf payloads."""
    return _decoder(payload, schema, lambda: _protobuf_reader(schema, zigzagged))


def from_msgpack_bytes(payload: Column, schema: T.StructType) -> Column:
    """``(record, error)`` of MessagePack payloads."""
    return _decoder(payload, schema, lambda: _msgpack_reader(schema))
