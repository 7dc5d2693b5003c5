"""Slices cover every row once and are of like size on skewed tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.sources.slices import slice_predicates, slice_sizes, split_points


def sizes(df, predicates):
    return [r["n_rows"] for r in sorted(slice_sizes(df, predicates).collect())]


def holders(df, predicates):
    """How many conditions hold for each row."""
    return {r[0] for r in df.select(sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates), F.lit(0))).collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 11 == 1, None).otherwise(n * 7919 % 1000)
    return spark.range(60000).select(key.cast("int").alias("k"), (n * 31 % 60000).alias("t"))


@pytest.mark.parametrize("slices", [2, 5, 16, 40])
def test_even_slices_of_a_skewed_key(skewed, slices):
    predicates = slice_predicates(skewed, "k", "t", slices)
    got = sizes(skewed, predicates)
    assert len(got) == slices and sum(got) == 60000
    assert holders(skewed, predicates) == {1}
    assert max(got) < 1.2 * min(got)


def test_without_a_second_column_a_value_stays_whole(skewed):
    predicates = slice_predicates(skewed, "k", slices=16)
    assert holders(skewed, predicates) == {1}
    assert len(predicates) < 16


def test_dates_decimals_and_nulls(spark):
    start = date(2020, 1, 1)
    rows = [(start + timedelta(days=i % 300) if i % 4 else None, i if i % 5 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "d date, t bigint").withColumn("x", F.expr("cast(t as decimal(12, 2)) / 4").cast("decimal(12,2)"))
    for key, then in (("d", "t"), ("x", None), ("d", None), ("t", "d")):
        predicates = slice_predicates(df, key, then, 6)
        assert holders(df, predicates) == {1}, (key, then)
    assert slice_predicates(df.limit(0), "d", "t", 4) == ["1 = 1"]
    assert slice_predicates(df, "d", "t", 1) == ["1 = 1"]
    only_null = df.withColumn("d", F.lit(None).cast("date"))
    assert holders(only_null, slice_predicates(only_null, "d", "t", 4)) == {1}
    all_null = only_null.withColumn("t", F.lit(None).cast("bigint"))
    assert slice_predicates(all_null, "d", "t", 4) == ["1 = 1"]


def test_points_of_a_sample_still_cover_the_table(spark, skewed):
    predicates = slice_predicates(skewed.where("t < 900"), "k", "t", 8)
    outside = spark.createDataFrame([(-5, 1), (10**6, None), (None, None), (7, None)], "k int, t bigint")
    assert holders(skewed.unionByName(outside), predicates) == {1}


def test_what_is_refused(spark):
    df = spark.createDataFrame([(1.5, "a")], "x double, s string")
    for key in ("x", "s"):
        with pytest.raises(ValueError):
            split_points(df, key, None, 4)
    with pytest.raises(ValueError):
        split_points(spark.range(3), "id", None, 0)
