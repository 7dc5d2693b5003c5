"""Scalar functions against literal cases and a plain Python model."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import coerce, days, normalise, text


def column_values(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def int_model(cell, bits):
    if not re.fullmatch(r"[+-]?[0-9]+", cell or "", re.ASCII):
        return 0
    number = int(cell)
    if not -(2**63) <= number < 2**63:
        return 0
    return (number + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1)


def uint_model(cell, bits):
    if not re.fullmatch(r"[0-9]+", cell or "", re.ASCII) or int(cell) >= 2**64:
        return 0
    return int(cell) % 2**bits


CELLS = ["0", "1", "-1", "+7", "007", "", " 1", "1 ", "1_000", "0x10", "12a", "1.0", "127", "128", "-129",
         "32768", "2147483647", "2147483648", "4294967295", "4294967296", "9223372036854775807",
         "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "18446744073709551615",
         "18446744073709551616", "99999999999999999999999999999999999999999", "--1", "+", "-", "١", None, "1\n"]


@pytest.mark.parametrize("kind,bits", [("int8", 8), ("int16", 16), ("int32", 32), ("int64", 64)])
def test_signed_cells(spark, kind, bits):
    rng = random.Random(bits)
    cells = CELLS + [str(rng.randrange(-(2**65), 2**65) >> rng.randrange(60)) for _ in range(200)]
    assert column_values(spark, cells, lambda c: coerce.zero_default(c, kind)) == [
        int_model(c, bits) for c in cells]


@pytest.mark.parametrize("kind,bits", [("uint8", 8), ("uint16", 16), ("uint32", 32), ("uint64", 64)])
def test_unsigned_cells(spark, kind, bits):
    got = column_values(spark, CELLS, lambda c: coerce.zero_default(c, kind))
    assert [int(v) for v in got] == [uint_model(c, bits) for c in CELLS]


def test_float_cells(spark):
    cases = {"1": 1.0, "-2.5": -2.5, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "1E-2": 0.01, "1e400": 0.0, "-1e400": 0.0,
             "inf": float("inf"), "-Infinity": float("-inf"), "+Inf": float("inf"), "1d": 0.0, "1.5f": 0.0,
             " 1": 0.0, "1 ": 0.0, "": 0.0, "abc": 0.0, ".": 0.0, "0x1p-2": 0.25, "0x1": 0.0, "1,5": 0.0,
             "infin": 0.0, "1e": 0.0}
    got = column_values(spark, list(cases), lambda c: coerce.zero_default(c, "float64"))
    assert got == list(cases.values())
    nan = column_values(spark, ["NaN", "nan", "-nan"], lambda c: coerce.zero_default(c, "float64"))
    assert nan[0] != nan[0] and nan[1] != nan[1] and nan[2] == 0.0
    assert column_values(spark, ["1e300"], lambda c: coerce.zero_default(c, "float32")) == [float("inf")]


def test_bool_and_string_cells(spark):
    words = ["1", "t", "T", "TRUE", "true", "True", "tRUE", "yes", "on", "0", "f", "", None]
    assert column_values(spark, words, lambda c: coerce.zero_default(c, "bool")) == [True] * 6 + [False] * 7
    assert column_values(spark, ["a", "", None], lambda c: coerce.zero_default(c, "string")) == ["a", "", ""]
    with pytest.raises(ValueError):
        coerce.zero_default(F.col("v"), "date")


def test_check_day_model(spark):
    rng = random.Random(3)
    numbers = [0, 101, 20240229, 20230229, 20000229, 19000229, 20241301, 20240001, 20240100, 20240431,
               99991231, 100000101, -20240101, None] + [rng.randrange(19000000, 21000000) for _ in range(500)]

    def model(n):
        try:
            return n is not None and n > 9999999 and bool(datetime.datetime.strptime(str(n), "%Y%m%d"))
        except ValueError:
            return False

    assert column_values(spark, numbers, days.check_day, "int") == [model(n) for n in numbers]


def test_previous_day_rolls_over(spark):
    cases = {20240301: 20240229, 20240101: 20231231, 20230229: 20230228, 20241301: 20241231, 20240100: 20231230}
    assert column_values(spark, list(cases), days.previous_day, "int") == list(cases.values())


def test_clocks(spark):
    row = spark.sql("select timestamp_ntz'2024-02-29 17:30:05.9' ts").select(
        days.home_clock(F.col("ts")), days.day_start_clock(F.col("ts")), days.n_days_before(F.col("ts"), 1),
        days.unix_seconds(F.col("ts"))).first()
    assert tuple(row) == ("20240301013005", "20240301000000", 20240229, 1709227805)


def test_query_strings(spark):
    cases = {
        "": [], "a": [("a", "")], "a=1&b=2;a=3": [("a", "1"), ("b", "2"), ("a", "3")],
        "x=1+2&y=%41%zz&z=%": [("x", "1 2")], "&&;=v": [("", "v")], "k=a=b": [("k", "a=b")],
        "%C3%A9=%E4%B8%AD": [("é", "中")], "a=%+f": [], "%2": [],
    }
    got = column_values(spark, list(cases), text.query_pairs)
    assert [[tuple(p) for p in pairs] for pairs in got] == list(cases.values())
    values = column_values(spark, ["a=1&b=2;a=3", ""], text.query_values)
    assert values == [{"a": ["1", "3"], "b": ["2"]}, {}]


def test_escapes(spark):
    raw = ["a b*~é-_.", "100%", "a+b", ""]
    assert column_values(spark, raw, text.query_escape) == ["a+b%2A~%C3%A9-_.", "100%25", "a%2Bb", ""]
    assert column_values(spark, raw, lambda c: text.query_unescape(text.query_escape(c))) == raw
    assert column_values(spark, ["a+b", "%2x"], lambda c: text.query_unescape(c, False)) == ["a+b", None]


def test_splits(spark):
    right = column_values(spark, ["a/b/c", "abc", "/", "", "a/"], lambda c: text.split_right(c, "/"))
    assert [tuple(r) for r in right] == [("a/b", "c"), ("abc", ""), ("", ""), ("", ""), ("a", "")]
    wide = column_values(spark, ["a::b::c", "a:b"], lambda c: text.split_right(c, "::"))
    assert [tuple(r) for r in wide] == [("a::b", "c"), ("a:b", "")]
    left = column_values(spark, ["a=b=c", "abc", ""], lambda c: text.split_left(c, "="))
    assert [tuple(r) for r in left] == [("a", "b=c"), ("abc", ""), ("", "")]
    info = column_values(spark, ["u:p%3A+q", "u/p", "u", "%zz:p"], text.split_userinfo)
    assert [tuple(r) for r in info] == [("u", "p:+q"), ("u", "p"), ("u", ""), (None, "p")]


def test_line_cleaning(spark):
    script = "# head\n\n  ls -l \r\n\tpwd \n  # tail"
    assert column_values(spark, [script], text.clean_lines) == [["ls -l", "pwd"]]
    got = column_values(spark, [script, "ls\nsudo RM -f", "ls\nrmdir x", ""], text.join_clean_lines)
    assert [tuple(r) for r in got] == [(True, "ls -l&&pwd"), (False, None), (True, "ls&&rmdir x"), (True, "")]
    forced = column_values(spark, ["rm a\nls"], lambda c: text.join_clean_lines(c, force=True))
    assert tuple(forced[0]) == (True, "rm a&&ls")
    assert column_values(spark, ["rm x", "x  rm", "rmx", "x\trm"], text.tokens_allowed) == [False, False, True, True]


def test_kv_string_leaves_out_unassigned(spark):
    line = spark.range(1).select(text.kv_string(
        {"a": F.lit(1), "b": F.lit(None).cast("string"), "c": F.lit("x")})).first()[0]
    assert line == "a=1,c=x"


def test_intervals(spark):
    years = column_values(spark, [-2.5, -1.25, 0.0, 1.25, 2.0], lambda c: normalise.interval_months(
        normalise.number_to_months_interval(c, "YEAR")), "double")
    assert years == [-30, -15, 0, 15, 24]
    months = column_values(spark, [-2.75, -1.25, 1.25, 2.75], lambda c: normalise.interval_months(
        normalise.number_to_months_interval(c, "month")), "double")
    assert months == [-3, -1, 1, 3]
    hours = column_values(spark, [-2.5, -1.25, 0.0, 10.0], lambda c: normalise.interval_nanos(
        normalise.number_to_seconds_interval(c, "HOUR")), "double")
    assert hours == [-9_000_000_000_000, -4_500_000_000_000, 0, 36_000_000_000_000]


def test_number_rules(spark):
    df = spark.sql("select cast(1.5 as decimal(10,2)) a, cast(7 as decimal(10,0)) b, cast(1 as tinyint) c, "
                   "cast(0.5 as float) d, true e, 'x' f, '' g")
    kinds = dict(normalise.normalise_numbers(df).dtypes)
    assert [kinds[k] for k in "abcdef"] == ["double", "bigint", "bigint", "double", "boolean", "string"]
    assert dict(normalise.normalise_numbers(df, strict=True).dtypes)["a"] == "decimal(10,2)"
    assert normalise.booleans_to_bits(df).first()["e"] == 1
    assert tuple(normalise.empty_to_null(df).select("f", "g").first()) == ("x", None)
    assert normalise.empty_to_null(df, ["f"]).first()["g"] == ""


def test_describe_and_pick(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, name string")
    rows = [tuple(r) for r in normalise.describe_columns(df).collect()]
    assert rows == [(0, "id", "int", True, None), (1, "name", "string", True, 3)]
    assert normalise.pick(df, ["name", "id"]).columns == ["name", "id"]
    with pytest.raises(Exception, match="nope"):
        normalise.pick(df, ["nope"])


def test_same_rows_counts_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "k int, v string")
    assert normalise.same_rows(a, b)
    assert not normalise.same_rows(a, b.distinct())


def test_zones(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01 20:00:00' ts").select(
        normalise.to_wall_clock(F.col("ts"), "+08:00"),
        normalise.to_wall_clock(normalise.to_instant(F.col("ts"), "Asia/Shanghai"), "UTC")).first()
    assert tuple(row) == (datetime.datetime(2024, 1, 2, 4), datetime.datetime(2024, 1, 1, 12))
