"""One stream feeds all channels of a folder, skips what is done on a replay, and takes channels that join later."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.operators.records import PERSON, from_payload
from millrace.plans.channels import resolve
from millrace.streaming import flows, folders


def land(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def channels(tmp_path, rules, policy="off"):
    sources = {n: {"record_type": "sms", "directory": str(tmp_path / "in"), "delete_policy": policy,
                   "name_rule": rule, "separator": ","} for n, rule in rules.items()}
    sinks = {n: {"table": str(tmp_path / "sent" / n), "fail_path": str(tmp_path / "fail" / n)} for n in rules}
    found = resolve({"sources": sources, "sinks": sinks, "channels": {n: {"source": n, "sink": n} for n in rules}})
    return [found[n] for n in rules]


RULES = {"a": "^a[[:digit:]]", "both": "^[ab][[:digit:]]", "b": "^(b)[[:digit:]]"}


def sent(spark, tmp_path, name):
    record = from_payload(F.col("value"), PERSON.struct())
    rows = spark.read.parquet(str(tmp_path / "sent" / name)).select("file_name", "line_num", record["age"].alias("age"))
    return sorted(tuple(r) for r in rows.collect())


def test_every_channel_gets_its_files(spark, tmp_path):
    land(tmp_path / "in", "a1", ["x,1,f", "broken", "y,2,f"])
    land(tmp_path / "in", "b1", ["z,3,f"])
    land(tmp_path / "in", "c1", ["q,9,f"])
    three = channels(tmp_path, RULES)
    got = folders.ingest_folder(spark, three[:2], str(tmp_path / "checkpoint"))
    assert sorted((r["channel"], r["n_lines"], r["total_lines"]) for r in got.collect()) == [("a", 3, 3), ("both", 4, 4)]
    assert sent(spark, tmp_path, "a") == [("a1", 0, 1), ("a1", 2, 2)]
    assert sent(spark, tmp_path, "both") == [("a1", 0, 1), ("a1", 2, 2), ("b1", 0, 3)]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fail" / "a")).collect()] == ["broken"]
    # a channel that joins gets new files only; the others go on
    land(tmp_path / "in", "b2", ["w,4,f", "v,5,f"])
    got = folders.ingest_folder(spark, three, str(tmp_path / "checkpoint"))
    assert sorted((r["channel"], r["n_lines"], r["total_lines"]) for r in got.collect()) == [
        ("a", 3, 3), ("b", 2, 2), ("both", 2, 6)]
    assert sent(spark, tmp_path, "b") == [("b2", 0, 4), ("b2", 1, 5)]
    assert len(sent(spark, tmp_path, "both")) == 5


def test_one_listing_for_all_channels(spark, tmp_path):
    land(tmp_path / "in", "a1", ["x,1,f"])
    stream = folders.routed_lines(spark, channels(tmp_path, RULES))
    assert stream._jdf.queryExecution().analyzed().toString().count("StreamingRelation") == 1


def test_a_replay_skips_the_channels_that_are_done(spark, tmp_path):
    land(tmp_path / "in", "a1", ["x,1,f"])
    sends = []

    def first(frame, batch_id):
        sends.append(batch_id)
        flows.batch_table(str(tmp_path / "sent" / "a"))(frame, batch_id)

    def broken(frame, batch_id):
        raise TypeError("a fault of the sender")

    pair = channels(tmp_path, {n: RULES[n] for n in ("a", "both")})
    with pytest.raises(Exception, match="a fault of the sender"):
        folders.ingest_folder(spark, pair, str(tmp_path / "checkpoint"), senders={"a": first, "both": broken})
    got = folders.ingest_folder(spark, pair, str(tmp_path / "checkpoint"), senders={"a": first})
    assert sends == [0]
    assert sorted((r["channel"], r["total_lines"]) for r in got.collect()) == [("a", 1), ("both", 1)]
    assert sent(spark, tmp_path, "a") == sent(spark, tmp_path, "both") == [("a1", 0, 1)]


def test_notes_do_not_pile_up_and_files_are_cleaned(spark, tmp_path):
    ch = channels(tmp_path, {"a": RULES["a"]}, "immediate")
    for i in range(3):
        land(tmp_path / "in", f"a{i}", ["x,1,f"] * (i + 1))
        land(tmp_path / "in", f"c{i}", ["x,1,f"])
        got = folders.ingest_folder(spark, ch, str(tmp_path / "checkpoint"))
    assert [tuple(r) for r in got.collect()] == [("a", 2, 3, 6)]
    assert len(list((tmp_path / "checkpoint" / "channels" / "a").glob("batch=*"))) == 1
    assert sorted(p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith(".")) == ["c0", "c1", "c2"]


def test_what_is_refused(spark, tmp_path):
    a, both = channels(tmp_path, {n: RULES[n] for n in ("a", "both")})
    with pytest.raises(ValueError, match="names"):
        folders.ingest_folder(spark, [a, a], str(tmp_path / "checkpoint"))
    elsewhere = replace(both, source=replace(both.source, directory=str(tmp_path / "other")))
    with pytest.raises(ValueError, match="one folder"):
        folders.routed_lines(spark, [a, elsewhere])
    assert {k: len(v) for k, v in folders.by_folder([a, both, elsewhere]).items()} == {
        str(tmp_path / "in"): 2, str(tmp_path / "other"): 1}
