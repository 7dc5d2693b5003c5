"""Batches of one topic partition handed to a user function, in batch and on streams."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import batching, deal
from millrace.session import ship
from millrace.streaming import batches, flows

SCHEMA = "topic string, partition int, offset bigint, value binary, note string, at timestamp"


def answer(payloads):
    """Fails the call that gets a 7, and the messages of three digits that start with 2."""
    if any(p == b"7" for p in payloads):
        raise ValueError("seven")
    return [LookupError("two") if len(p) == 3 and p[:1] == b"2" else p + b"|" + str(len(payloads)).encode() for p in payloads]


def messages(spark, start, stop, partitions=3):
    return spark.range(start, stop).select(
        F.when(F.col("id") % 5 > 0, F.lit("t")).alias("topic"), (F.col("id") % partitions).cast("int").alias("partition"),
        F.col("id").alias("offset"), F.col("id").cast("string").cast("binary").alias("value"),
        F.when(F.col("id") % 4 > 0, F.lit("n")).alias("note"), F.when(F.col("id") % 6 > 0, F.timestamp_seconds("id")).alias("at"))


def model(rows, size, ends=True):
    """(offset, batch, tag, result) of a row-at-a-time dealer that closes by count."""
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["offset"]):
        by[r["topic"], r["partition"]].append(r)
    for group in by.values():
        for start in range(0, len(group), size):
            batch = group[start:start + size]
            if len(batch) < size and not ends:
                continue
            outcomes = deal.call_batch(answer, [bytes(r["value"]) for r in batch])
            yield from ((r["offset"], start // size, o[0], o[1], r["note"], r["at"]) for r, o in zip(batch, outcomes))


def seen(frame, number):
    return sorted((r["offset"], r[number], r["deal_tag"], r["result"] and bytes(r["result"]), r["note"], r["at"]) for r in frame.collect())


@pytest.mark.parametrize("arrow_rows", [3, 10_000])
def test_one_call_per_numbered_batch(spark, staging, arrow_rows):
    """Whatever the Arrow batches are."""
    ship(spark)
    df = messages(spark, 0, 300).withColumn("result", F.lit("clash"))
    numbered = batching.count_or_time(df.withColumn("clock", F.lit(0)), max_rows=8, max_wait=100, staging=staging)
    joined = batching.null_safe_join(df, numbered.select("topic", "partition", "offset", "batch"), ["topic", "partition", "offset"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        got = seen(deal.deal_runs(joined, answer, ["topic", "partition", "batch"], ["offset"]), "batch")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(model(df.collect(), 8))


def test_wrong_number_of_answers_fails_the_batch(spark):
    ship(spark)
    got = deal.deal_runs(messages(spark, 1, 7, 1), lambda p: p[1:], ["topic", "partition"], ["offset"]).collect()
    assert len(got) == 6 and not any(r["deal_tag"] for r in got)
    assert {r["error"] for r in got} == {"4 answers for 5 messages", "0 answers for 1 messages"}
    assert deal.deal_runs(messages(spark, 0, 0), answer, ["topic"], ["offset"]).count() == 0


def test_batches_go_on_after_a_restart(spark, tmp_path):
    """What was open when the stream stopped is the start of the next batch; numbers go on."""
    ship(spark)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    cuts, so_far = [0, 40, 41, 90, 200], None
    for start, stop in zip(cuts, cuts[1:]):
        messages(spark, start, stop).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        dealt = batches.deal_partition_batches(stream, answer, max_rows=7, max_wait=3600)
        batches.run_available(dealt, flows.batch_table(out), checkpoint)
        done = spark.read.schema(dealt.schema).parquet(out)
        want = sorted(model(messages(spark, 0, stop).collect(), 7, ends=False))
        assert seen(done, "deal_batch") == want
        assert {r["closed_by"] for r in done.select("closed_by").collect()} <= {"rows"}
        so_far = want
    assert len(so_far) > 150


def test_a_timer_closes_a_batch_that_nothing_follows(spark, tmp_path):
    ship(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    messages(spark, 10, 15, 1).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    dealt = batches.deal_partition_batches(stream, answer, max_rows=100, max_wait=1)
    running = flows.start(dealt, flows.batch_table(out), str(tmp_path / "checkpoint"), every="1 second")
    try:
        for _ in range(90):
            time.sleep(1)
            done = [p.parent for p in (tmp_path / "out").glob("batch=*/_SUCCESS")]
            if done and spark.read.schema(dealt.schema).parquet(*map(str, done)).count() == 5:
                break
    finally:
        running.stop()
    got = spark.read.schema(dealt.schema).parquet(out).collect()
    assert sorted(r["offset"] for r in got) == [10, 11, 12, 13, 14] and {r["closed_by"] for r in got} == {"time"}
    by_topic = defaultdict(set)
    for r in got:
        by_topic[r["topic"]].add(bytes(r["result"]).split(b"|")[1])
    assert by_topic == {"t": {b"4"}, None: {b"1"}}  # a batch never mixes partitions


def test_bad_limits_are_refused(spark):
    with pytest.raises(ValueError):
        batches.deal_partition_batches(messages(spark, 0, 1), answer, max_rows=0)
