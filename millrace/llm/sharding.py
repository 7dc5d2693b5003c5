"""A two-pass external shuffle that deals records to shards.

Pass one scatters the records uniformly into buckets by a seeded hash of their row number, with as
many buckets as keep each near ``bucket_bytes``; equal texts, equal ids and hot sources spread like
anything else.  Pass two gathers one bucket at a time, permutes it with Spark's ``shuffle`` function
(a Fisher-Yates shuffle of an array), and deals the permuted records out in turn, starting where the
buckets before ended.  The law that holds is ``rows``: shard counts differ by one at most.

Bucket starts are prefix sums over the bucket counts in two levels, so no task sees more than
``CHUNK`` buckets, or one row per chunk.  The records are written once; whoever reads the shards
reads the files, so a retried task can't deal anew.

Defined results: a NULL text has no bytes (size 1) and the checksum of the empty text; repeated rows
and NULL ids are records like others; an empty table gives no record; input columns named like the
added ones give way.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ROW, annotate, whole_text, with_row
from millrace.staging import Staging

SHARDS = 16
SEED = 20240917
BUCKET_BYTES = 4 << 20
CHUNK = 1024
LAW = "rows"

_BUCKET = "__llm_bucket"


def record_size(text: str = "text"):
    """UTF-8 bytes of the text, and one for its end."""
    return (F.octet_length(whole_text(F.col(f"`{text}`"))) + 1).cast("bigint")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """``(bucket, n)`` with the number of records in the buckets before, as ``start``."""
    chunk = F.expr(f"{_BUCKET} div {CHUNK}")
    local = Window.partitionBy("chunk").orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("chunk", chunk).withColumn("local", F.coalesce(F.sum("n").over(local), F.lit(0)))
    totals = counts.groupBy(chunk.alias("c")).agg(F.sum("n").alias("total"))
    before = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    return within.join(totals, F.col("chunk") == F.col("c")).select(
        F.col(_BUCKET).alias("__llm_b"), (F.col("local") + F.col("base")).alias("start"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES, staging: Staging | None = None) -> DataFrame:
    """Write the records below ``path``, one folder per shard, and return the written table.

    It has the input columns, ``size``, ``law``, ``shard`` and ``slot``.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    spark = df.sparkSession
    staging = staging or Staging(spark)
    size = record_size(text)
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, ceil(total / bucket_bytes))
    scattered = with_row(annotate(df, {"size": size})).withColumn(
        _BUCKET, F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(buckets)))
    counts = with_row(df).select(F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(buckets)).alias(_BUCKET))
    starts = staging.keep(bucket_starts(counts.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"))), "starts")
    taken = ("size", "law", "shard", "slot")
    names = [c for c in df.columns if c.lower() not in taken]
    record = F.struct(*[F.col(f"`{c}`") for c in names], F.col("size"))
    gathered = scattered.select(_BUCKET, F.struct(F.col(ROW).alias("row"), record.alias("record")).alias("r")) \
        .groupBy(_BUCKET).agg(F.collect_list("r").alias("rs"))
    in_order = F.array_sort("rs", lambda a, b: F.when(a["row"] < b["row"], -1).otherwise(1))
    dealt = gathered.join(starts, F.col(_BUCKET) == F.col("__llm_b")).select(
        "start", F.posexplode(F.shuffle(in_order, seed)).alias("__llm_at", "r"))
    place = F.col("start") + F.col("__llm_at")
    dealt = dealt.select(
        "r.record.*", F.lit(LAW).alias("law"), F.expr(f"(start + __llm_at) div {shards}").alias("slot"),
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)
