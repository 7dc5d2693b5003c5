"""Chunk commits against a model that goes row by row."""

import glob
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.sinks import chunks


def receiver(log, broken=(), refuse=lambda n: False):
    """Notes its calls in files, so that calls in workers are seen; fails over the chunks in ``broken``."""

    def send(run, chunk, rows):
        with open(f"{log}/{run}-{chunk}-{uuid.uuid4().hex}", "w"):
            pass
        if chunk in broken:
            raise OSError(f"chunk {chunk}")
        return ["no" if refuse(n) else None for n in rows.column("n").to_pylist()]

    return send


def calls(log):
    return sorted(int(f.rsplit("/", 1)[1].split("-")[-2]) for f in glob.glob(f"{log}/*"))


def outcomes(spark, path, df):
    rows = chunks.read_outcomes(spark, path, df.schema).collect()
    return {r["n"]: (r["chunk"], r["state"], r["error"]) for r in rows}, len(rows)


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "out"), str(tmp_path / "log")


def test_outcome_of_every_record(spark, staging, place):
    path, log = place
    df = spark.range(1000).select((F.col("id") * 3).alias("n"), F.when(F.col("id") % 2 == 0, "x").alias("v")).repartition(7)
    send = receiver(log, broken={2, 5}, refuse=lambda n: n % 11 == 0)
    counts = chunks.write_chunks(df, path, "a", ["n"], 64, send, "go_on", staging)
    expected = {}
    for i in range(1000):
        chunk, n = i // 64, i * 3
        bad = n % 11 == 0
        expected[n] = (chunk, "rolled_back", f"OSError: chunk {chunk}") if chunk in (2, 5) else (
            chunk, "refused" if bad else "sent", "no" if bad else None)
    assert outcomes(spark, path, df) == (expected, 1000)
    assert calls(log) == list(range(16))
    states = [s for _, s, _ in expected.values()]
    assert counts == {"committed": 14, "skipped": 0, "rolled_back": 2, "sent": states.count("sent"), "refused": states.count("refused")}
    # the second call goes to the chunks that were rolled back, and only to those
    counts = chunks.write_chunks(df, path, "a", ["n"], 64, receiver(log), "go_on", staging)
    assert (counts["committed"], counts["skipped"], counts["rolled_back"]) == (2, 14, 0)
    assert calls(log) == sorted([*range(16), 2, 5])
    expected |= {n: (c, "sent", None) for n, (c, s, _) in expected.items() if s == "rolled_back"}
    assert outcomes(spark, path, df) == (expected, 1000)
    assert not glob.glob(f"{path}/_drafts/*")


def test_an_error_loses_the_open_chunk_only(spark, staging, place):
    path, log = place
    df = spark.range(300).select(F.col("id").alias("n")).coalesce(1)
    with pytest.raises(Exception, match="chunk 4"):
        chunks.write_chunks(df, path, "a", ["n"], 50, receiver(log, broken={4}), staging=staging)
    before, n = outcomes(spark, path, df)
    called = calls(log)
    assert {c for c, _, _ in before.values()} == set(called) - {4} and n == 50 * len(set(called) - {4})
    counts = chunks.write_chunks(df, path, "a", ["n"], 50, receiver(log), staging=staging)
    assert counts["skipped"] == len(set(called) - {4}) and counts["committed"] + counts["skipped"] == 6
    assert outcomes(spark, path, df) == ({i: (i // 50, "sent", None) for i in range(300)}, 300)
    assert calls(log) == sorted([*range(6), 4])  # no committed chunk was sent twice
    # another run is another set of chunks
    assert chunks.write_chunks(df, path, "b", ["n"], 50, staging=staging)["committed"] == 6
    assert chunks.read_outcomes(spark, path, df.schema, "b").count() == 300


def test_a_task_that_is_tried_again(place):
    path, log = place
    for folder in ("run=a", "_drafts", "_runs"):
        chunks._file_system(path)[0].create_dir(f"{path}/{folder}", recursive=True)

    def writer(send):
        packed = chunks.base64.b64encode(chunks.cloudpickle.dumps(send)).decode()
        return chunks._ChunkWriter({"path": path, "run": "a", "on_error": "stop", "sender": packed})

    def batches(*pieces):
        return iter([pa.RecordBatch.from_pydict({"n": list(p), "chunk": [i // 4 for i in p]}) for p in pieces])

    with pytest.raises(OSError):
        writer(receiver(log, broken={2})).write(batches(range(0, 3), range(3, 9), range(9, 11)))
    again = writer(receiver(log)).write(batches(range(0, 11)))
    assert again == chunks.Counts(committed=1, skipped=2, sent=3)
    assert calls(log) == [0, 1, 2, 2]
    assert writer(None).write(iter([])) == chunks.Counts()


def test_edges(spark, staging, place):
    path, log = place
    df = spark.createDataFrame([(1, None), (2, "é\n"), (3, "é\n"), (4, "x" * 100_000)], "n bigint, v string")
    empty = chunks.write_chunks(df.limit(0), path, "empty", ["n"], staging=staging)
    assert set(empty.values()) == {0} and chunks.read_outcomes(spark, path, df.schema).count() == 0
    chunks.write_chunks(df, path, "a", ["n"], 3, staging=staging)
    assert sorted((r["n"], r["v"]) for r in chunks.read_outcomes(spark, path, df.schema).collect()) == sorted(
        (r["n"], r["v"]) for r in df.collect())
    short = chunks.write_chunks(df, path, "short", ["n"], 3, lambda run, chunk, rows: ["one"], "go_on", staging)
    assert short["rolled_back"] == 1 and short["refused"] == 1  # one outcome for three records, and for the last
    for bad in (lambda: chunks.write_chunks(df.withColumn("State", F.lit(1)), path, "x", ["n"]),
                lambda: chunks.write_chunks(df, path, "a/b", ["n"]),
                lambda: chunks.write_chunks(df, path, "x", ["n"], 0),
                lambda: chunks.write_chunks(df, path, "x", ["n"], on_error="ignore")):
        with pytest.raises(ValueError):
            bad()


def test_replayed_micro_batches(spark, place):
    path, log = place
    df = spark.range(100).select(F.col("id").alias("n"))
    handle = chunks.batch_sender(path, "feed", ["n"], 30, receiver(log))
    for batch_id in (0, 0, 1):
        handle(df, batch_id)
    assert calls(log) == [0, 0, 1, 1, 2, 2, 3, 3]
    runs = chunks.read_outcomes(spark, path, df.schema).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in runs} == {"feed-0": 100, "feed-1": 100}
