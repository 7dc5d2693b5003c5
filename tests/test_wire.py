"""Binary payloads against fixed bytes of the formats, and round trips."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import wire

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("i", T.LongType()), ("s", T.StringType()), ("d", T.DoubleType()), ("b", T.BooleanType()), ("n", T.IntegerType()),
    ("f", T.FloatType()), ("z", T.LongType()), ("raw", T.BinaryType()), ("t", T.ByteType()))])
WIDE = [0, 1, -1, 31, -32, -33, 127, 128, -128, -129, 255, 256, 32767, 32768, -32768, -32769, 65535, 65536, 2**31 - 1,
        2**31, -2**31, -2**31 - 1, 2**32 - 1, 2**32, 2**63 - 1, -2**63]


def rows():
    rng = random.Random(5)
    out = [(None,) * 9, (0, "", 0.0, False, 0, 0.0, 0, b"", 0), (1, "é\n" * 40, -0.0, True, -1, 1.5, -1, b"\xff" * 300, -128)]
    for k in WIDE:
        out.append((k, "x" * rng.choice([1, 31, 32, 255, 256, 65535, 65536]), rng.uniform(-1e9, 1e9), k % 2 == 0,
                    max(-2**31, min(2**31 - 1, k)), float(k % 97), k, bytes([k % 256]) * (k % 300), k % 128))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows())], T.StructType([T.StructField("id", T.LongType()), *SCHEMA.fields]))


def decoded(df, column):
    got = df.select("id", column.alias("x")).select("id", "x.record", "x.error").collect()
    return {r["id"]: (tuple(r["record"]) if r["record"] is not None else None, r["error"]) for r in got}


def test_protobuf_round_trip(table):
    got = decoded(table, wire.from_protobuf_bytes(wire.to_protobuf_bytes(SCHEMA, ["z"]), SCHEMA, ["z"]))
    zeros = rows()[1]
    for i, row in enumerate(rows()):
        want = tuple(z if v is None else v for v, z in zip(row, zeros))
        assert got[i] == (want, None), i
    assert math.copysign(1, got[2][0][2]) == -1


def test_msgpack_round_trip(table):
    got = decoded(table, wire.from_msgpack_bytes(wire.to_msgpack_bytes(SCHEMA), SCHEMA))
    assert got == {i: (row, None) for i, row in enumerate(rows())}


def test_fixed_bytes(spark):
    schema = T.StructType.fromDDL("a long, b string, c double")
    df = spark.createDataFrame([(150, "testing", 1.0), (-2, None, None), (300, "", 0.0)], schema)
    proto = [bytes(r[0]).hex() for r in df.select(wire.to_protobuf_bytes(schema)).collect()]
    assert proto == ["089601" "120774657374696e67" "19000000000000f03f", "08feffffffffffffffff01", "08ac02"]
    zig = [bytes(r[0]).hex() for r in df.select(wire.to_protobuf_bytes(schema, ["a"])).collect()]
    assert zig[1] == "0803"
    pack = [bytes(r[0]).hex() for r in df.select(wire.to_msgpack_bytes(schema)).collect()]
    assert pack == ["83" "a161" "cc96" "a162" "a774657374696e67" "a163" "cb3ff0000000000000",
                    "83" "a161" "fe" "a162" "c0" "a163" "c0", "83" "a161" "cd012c" "a162" "a0" "a163" "cb0000000000000000"]


def test_damaged_payloads(spark):
    schema = T.StructType.fromDDL("a int, b string")
    cases = {
        "proto": {None: (None, None), b"": ((0, ""), None), b"\x08": (None, "cut"), b"\x08\x80": (None, "cut"),
                  b"\x12\x05ab": (None, "cut"), b"\x0f": (None, "damaged"), b"\x00\x01": (None, "damaged"),
                  b"\x08" + b"\xff" * 10 + b"\x01": (None, "damaged"), b"\x12\x01\xff": (None, "damaged"),
                  b"\x0a\x01a": (None, "damaged"), b"\x18\x07\x08\x01\x08\x02": ((2, ""), None),
                  b"\x22\x02hi\x12\x01y": ((0, "y"), None), b"\x29" + bytes(8) + b"\x35" + bytes(4): ((0, ""), None),
                  b"\x08\x80\x80\x80\x80\x10": ((0, ""), None), b"\x12\xff\xff\xff\xff\xff\x01": (None, "cut")},
        "pack": {None: (None, None), b"": (None, "cut"), b"\x80": ((None, None), None), b"\x81\xa1a": (None, "cut"),
                 b"\x81\xa1a\x05": ((5, None), None), b"\x81\xa1a\xcb" + struct.pack(">d", 1): (None, "damaged"),
                 b"\x81\xa1a\xce\xff\xff\xff\xff": (None, "damaged"), b"\x81\xa1b\xa1\xff": (None, "damaged"),
                 b"\x80\x00": (None, "damaged"), b"\x93\x01\x02\x03": (None, "damaged"), b"\xc1": (None, "damaged"),
                 b"\x82\xa1x\x92\x01\x81\x02\xc4\x01z\xa1b\xa1y": ((None, "y"), None), b"\x81" * 200: (None, "damaged"),
                 b"\x81\x91\x01\x02": ((None, None), None), b"\xdf\x00\x00\x00\x01\xa1a\xd0\x80": ((-128, None), None),
                 b"\x83\xa1a\xc0\xa1x\xd6\x01abcd\xa1y\xc7\x02\x01ab": ((None, None), None),
                 b"\xdf\xff\xff\xff\xff": (None, "cut")},
    }
    for form, decode in (("proto", wire.from_protobuf_bytes), ("pack", wire.from_msgpack_bytes)):
        listed = list(cases[form].items())
        df = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, (p, _) in enumerate(listed)], "id bigint, p binary")
        got = decoded(df, decode(F.col("p"), schema))
        for i, (payload, want) in enumerate(listed):
            assert got[i] == want, (form, payload)
    with pytest.raises(ValueError):
        wire.to_protobuf_bytes(T.StructType.fromDDL("a array<int>"))


def test_empty_table(spark):
    schema = T.StructType.fromDDL("a int, b double")
    df = spark.createDataFrame([], schema)
    assert df.select(wire.from_msgpack_bytes(wire.to_msgpack_bytes(schema), schema).alias("x")).count() == 0
    assert df.select(wire.from_protobuf_bytes(wire.to_protobuf_bytes(schema), schema).alias("x")).collect() == []
