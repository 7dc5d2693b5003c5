"""Streams equal batches, resume after a restart, and keep going past bad records."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import deal
from millrace.operators.records import PERSON, from_payload
from millrace.plans.channels import Sink, resolve
from millrace.sinks import outputs
from millrace.streaming import flows


def land(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def channel(tmp_path, **more):
    source = {"record_type": "sms", "directory": str(tmp_path / "in"), "delete_policy": "off",
              "name_rule": "^sms[[:alnum:]]+", "separator": ",", **more}
    sink = {"table": str(tmp_path / "sent"), "fail_path": str(tmp_path / "fail")}
    return resolve({"sources": {"s": source}, "sinks": {"k": sink},
                    "channels": {"c1": {"source": "s", "sink": "k"}}})["c1"]


def ingest(spark, ch, tmp_path, send=None, **more):
    flows.ingest(spark, ch, str(tmp_path / "checkpoint"), send=send, **more)


def sent(spark, tmp_path):
    record = from_payload(F.col("value"), PERSON.struct())
    frame = spark.read.parquet(str(tmp_path / "sent")).select("file_name", "line_num", record.alias("r"))
    return sorted((r["file_name"], r["line_num"], *r["r"]) for r in frame.collect())


def test_ingest_and_resume(spark, tmp_path):
    ch = channel(tmp_path)
    land(tmp_path / "in", "sms1", ["nora,31,female", "broken", "bob,x,male"])
    land(tmp_path / "in", "other", ["a,1,b"])
    ingest(spark, ch, tmp_path)
    first = [("sms1", 0, "nora", 31, "female"), ("sms1", 2, "bob", 0, "male")]
    assert sent(spark, tmp_path) == first
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fail")).collect()] == ["broken"]
    land(tmp_path / "in", "sms2", ["zoe,7,female"])
    ingest(spark, ch, tmp_path)  # a new query on the same checkpoint
    assert sent(spark, tmp_path) == [*first, ("sms2", 0, "zoe", 7, "female")]
    assert (tmp_path / "in" / "sms1").exists()


def test_senders_and_skipped_files(spark, tmp_path):
    with pytest.raises(ValueError):
        flows.channel_sender(Sink())
    assert flows.channel_sender(Sink(servers="a:1", topic="t"))
    ch = replace(channel(tmp_path), sink=Sink(skip_path=str(tmp_path / "skipped")))
    land(tmp_path / "in", "sms1", ["a,1,b"])
    land(tmp_path / "in", "other", ["a,1,b"])
    for _ in range(2):
        flows.record_skipped(spark, ch, aside=str(tmp_path / "aside"))
    assert (tmp_path / "aside" / "other").exists() and (tmp_path / "in" / "sms1").exists()
    assert [r["file_name"] for r in spark.read.parquet(str(tmp_path / "skipped")).collect()] == ["other"]


def test_failed_send_becomes_dead_letters(spark, tmp_path):
    ch = channel(tmp_path)
    land(tmp_path / "in", "sms1", ["nora,31,female", "broken"])

    def send(frame, batch_id):
        raise RuntimeError("broker is gone")

    ingest(spark, ch, tmp_path, send)
    letters = spark.read.text(str(tmp_path / "fail")).select("fail_class", "value").collect()
    assert sorted(tuple(r) for r in letters) == [("parse", "broken"), ("send", "nora,31,female")]
    assert list(Path(tmp_path, "fail").glob("fail_class=parse/batch=0/err_c1_*"))


def test_faults_of_a_sender_are_no_dead_letters(spark, tmp_path):
    ch = channel(tmp_path)
    land(tmp_path / "in", "sms1", ["nora,31,female"])

    def wrong(frame, batch_id):
        frame.select("no_such_column").count()

    with pytest.raises(Exception, match="no_such_column"):
        ingest(spark, ch, tmp_path, wrong)
    assert not list(Path(tmp_path).glob("fail/fail_class=send/*/err*"))


def test_replayed_batch_replaces_itself(spark, tmp_path):
    ch = channel(tmp_path)
    land(tmp_path / "in", "sms1", ["nora,31,female", "broken"])
    from millrace.operators.records import parse_lines
    from millrace.sources.spool import scan_lines

    batch = parse_lines(scan_lines(spark, ch.source.directory, ch.source.name_rule), PERSON)
    handle = flows.ingest_writer(ch)
    handle(batch, 3)
    handle(batch, 3)
    assert len(sent(spark, tmp_path)) == 1
    assert spark.read.text(str(tmp_path / "fail")).count() == 1


def test_archived_after_ingest(spark, tmp_path):
    ch = channel(tmp_path, delete_policy="archive")
    for i in range(3):
        land(tmp_path / "in", f"sms{i}", [f"n{i},1,f"])
    ingest(spark, ch, tmp_path, max_files=1, archive=str(tmp_path / "done"))
    assert len(sent(spark, tmp_path)) == 3
    assert list(Path(tmp_path, "done").rglob("sms*"))


@pytest.mark.parametrize("kind", ["each", "batches"])
def test_stream_equals_batch(spark, tmp_path, kind):
    frame = spark.range(200).select("id", F.col("id").cast("string").cast("binary").alias("value"))
    frame.repartition(4).write.parquet(str(tmp_path / "in"))

    def one(payload):
        if payload.endswith(b"7"):
            raise ValueError("seven")
        return payload * 2

    def many(payloads):
        return [ValueError("seven") if p.endswith(b"7") else p * 2 for p in payloads]

    def run(df):
        return deal.deal_each(df, one) if kind == "each" else deal.deal_batches(df, many, 7)

    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    handle = outputs.outcome_handlers(flows.batch_table(good), flows.batch_table(bad))
    flows.run_to_end(run(stream), handle, str(tmp_path / "checkpoint"))
    got = spark.read.parquet(good).drop("batch").unionByName(spark.read.parquet(bad).drop("batch"))
    want = run(frame)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert spark.read.parquet(bad).count() == 20
    assert spark.read.parquet(good).select("batch").distinct().count() > 1


def test_progress_over_batches_and_reallot(spark, tmp_path):
    schema = "topic string, partition int, offset bigint, ok boolean"
    for i, offsets in enumerate(([0, 1, 2], [3, 500])):
        rows = [("t", p, o + p, o != 500) for p in (0, 1, 2) for o in offsets]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in/*"))
    published, changed = str(tmp_path / "allotment"), str(tmp_path / "changes")
    start = spark.createDataFrame([("w1", "t", 0), ("w1", "t", 1), ("w2", "t", 2)],
                                  "worker string, topic string, partition int")
    flows.batch_table(published)(start, -1)
    progress = str(tmp_path / "progress")
    reallot = flows.reallot_writer(lambda: flows.newest_batch(spark, published), flows.batch_table(published),
                                   flows.batch_table(changed))

    def handle(frame, batch_id):
        flows.batch_table(progress)(frame, batch_id)
        reallot(frame, batch_id)

    flows.run_to_end(flows.offset_progress(stream, F.col("ok")), handle, str(tmp_path / "checkpoint"), mode="complete")
    final = sorted(tuple(r) for r in flows.newest_batch(spark, progress).collect())
    assert final == [("t", p, 3 + p, 501 + p) for p in (0, 1, 2)]
    assert sorted(tuple(r) for r in flows.newest_batch(spark, published).collect()) == [
        ("w1", "t", 0), ("w2", "t", 1), ("w2", "t", 2)]
    assert sorted(tuple(r)[:4] for r in spark.read.parquet(changed).collect()) == [
        ("w1", "t", 1, "removed"), ("w2", "t", 1, "added")]


@pytest.mark.parametrize("policy", ["immediate", "archive"])
def test_only_ingested_files_are_cleaned_up(spark, tmp_path, policy):
    ch = channel(tmp_path, delete_policy=policy)
    land(tmp_path / "in", "sms1", ["a,1,b"])
    land(tmp_path / "in", "gsm1", ["c,2,d"])
    land(tmp_path / "in", "other", ["e,3,f"])
    archive = str(tmp_path / "done") if policy == "archive" else None
    ingest(spark, ch, tmp_path, archive=archive)
    land(tmp_path / "in", "sms 2", ["x,1,y"])  # does not fit the rule
    ingest(spark, ch, tmp_path, archive=archive)
    assert sorted(p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith(".")) == ["gsm1", "other", "sms 2"]
    assert len(sent(spark, tmp_path)) == 1


def test_a_batch_that_was_not_committed_can_be_replayed(spark, tmp_path):
    ch = channel(tmp_path, delete_policy="immediate")
    land(tmp_path / "in", "sms1", ["a,1,b"])

    files = flows.IngestedFiles(spark, ch, str(tmp_path / "checkpoint" / "ingested"))
    write = flows.ingest_writer(ch, files=files)

    def crash(batch, batch_id):
        write(batch, batch_id)
        raise RuntimeError("the driver died before the commit")

    with pytest.raises(Exception):
        flows.run_to_end(flows.ingest_lines(spark, ch), crash, str(tmp_path / "checkpoint"))
    assert (tmp_path / "in" / "sms1").exists()
    ingest(spark, ch, tmp_path)
    assert len(sent(spark, tmp_path)) == 1 and not (tmp_path / "in" / "sms1").exists()
