"""Spool files, queue and database options, channels, and what sinks write."""

from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.records import RecordSchema
from millrace.plans.channels import resolve
from millrace.sinks import outputs
from millrace.sources import database, queue, shapes, spool
from millrace.staging import Staging, exists, shared_root


def write(folder, name, data):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def test_rules_with_posix_classes(spark):
    assert spool.java_regex("^sms[[:alnum:]]+") == r"^sms[\p{Alnum}]+"
    assert spool.java_regex("[^[:digit:]x]") == r"[^\p{Digit}x]"
    assert spool.java_regex("[[:^space:]]") == r"[\S]"
    with pytest.raises(ValueError):
        spool.java_regex("[[:nope:]]")
    names = ["sms79", "sms", "xsms1", "gsm1", None]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    matched, skipped = spool.route(df, "^sms[[:alnum:]]+")
    assert [r[0] for r in matched.collect()] == ["sms79"]
    assert skipped.count() == 4
    assert spool.route(df, "sms")[0].count() == 3  # unanchored


def test_line_numbers_of_split_files(spark, tmp_path, staging):
    expected = {}
    for name, n in (("sms1", 400), ("sms2", 3), ("sms3", 0), ("gsm1", 50)):
        lines = [f"{name} line {i} " + "x" * (i % 37) for i in range(n)]
        write(tmp_path / "in", name, "".join(line + "\n" for line in lines))
        expected |= {(name, i): line for i, line in enumerate(lines) if name.startswith("sms")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        scanned = spool.scan_lines(spark, str(tmp_path / "in"), "^sms")
        assert scanned.select("file_name", "file_block_start").distinct().count() > 10
        got = spool.number_lines(scanned, staging).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert {(r["file_name"], r["line_num"]): r["value"] for r in got} == expected
    assert len(got) == len(expected)


def test_line_ends(spark, tmp_path, staging):
    write(tmp_path / "in", "a", b"one\r\ntwo\rstill two\n\nfour\r\r\nlast")
    got = spool.number_lines(spool.scan_lines(spark, str(tmp_path / "in")), staging).orderBy("line_num").collect()
    assert [r["value"] for r in got] == ["one", "two\rstill two", "", "four\r", "last"]
    texts = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", "\n"), ("d", "p\nq")], "n string, t string")
    lines = spool.explode_lines(texts, "n", "t").orderBy("file_name", "line_num").collect()
    assert [tuple(r) for r in lines] == [("a", 0, "x"), ("a", 1, "y"), ("c", 0, ""), ("d", 0, "p"), ("d", 1, "q")]


def test_same_name_in_two_folders(spark, tmp_path, staging):
    write(tmp_path / "in/x", "sms1", "a\nb\n")
    write(tmp_path / "in/y", "sms1", "c\n")
    root = str(tmp_path / "in")
    got = spool.number_lines(spool.scan_lines(spark, root, recursive=True), staging)
    assert sorted((r["line_num"], r["value"]) for r in got.collect()) == [(0, "a"), (0, "c"), (1, "b")]
    assert spool.list_files(spark, root, recursive=True).count() == 2


def test_skip_manifest(spark, tmp_path):
    write(tmp_path / "in", "sms1", "abc")
    write(tmp_path / "in", "other", "abcdef")
    rows = outputs.skip_manifest(spark, str(tmp_path / "in"), "^sms").collect()
    assert [(r["file_name"], r["length"]) for r in rows] == [("other", 6)]


def test_files_that_do_not_match_are_not_opened(spark, tmp_path):
    write(tmp_path / "in", "sms1", "abc\n")
    write(tmp_path / "in", "zzz.gz", "this is not a compressed file, so opening it fails\n")
    with pytest.raises(Exception, match="gz|GZIP|gzip|header"):
        spool.scan_lines(spark, str(tmp_path / "in")).count()
    assert spool.scan_lines(spark, str(tmp_path / "in"), "^sms").count() == 1


def test_clean_policies():
    assert spool.clean_options("immediate") == {"cleanSource": "delete"}
    assert spool.clean_options("off") == {"cleanSource": "off"}
    assert spool.clean_options("archive", "/x") == {"cleanSource": "archive", "sourceArchiveDir": "/x"}
    for wrong in ("never", "archive"):
        with pytest.raises(ValueError):
            spool.clean_options(wrong)


def test_queue_options_and_envelope(spark, staging):
    options = queue.kafka_read_options(["a:1", "b:2"], ["t1", "t2"], "g", max_offsets=10)
    assert options == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "t1,t2", "startingOffsets": "earliest",
                       "groupIdPrefix": "g", "maxOffsetsPerTrigger": "10"}
    with pytest.raises(ValueError):
        queue.kafka_read_options("a:1", [])
    assert outputs.kafka_write_options("a:1", "t") == {
        "kafka.bootstrap.servers": "a:1", "kafka.acks": "all", "topic": "t"}
    df = spark.createDataFrame([(1, "a", "t", 0, 5), (2, "b", "t", 0, 4), (3, "c", "u", 0, 1)],
                               "k int, v string, t string, p int, at int")
    sent = queue.envelope(df, F.col("k"), F.col("v"), F.col("t"), F.col("p"), F.lit(0), "at")
    numbered = queue.with_dense_offsets(sent, ["at"], staging)
    assert {(bytes(r["key"]).decode(), r["topic"], r["offset"]) for r in numbered.collect()} == {
        ("1", "t", 1), ("2", "t", 0), ("3", "u", 0)}
    fields = queue.undealt(sent.select("key", "value", "topic", "partition", "offset")).schema
    assert [(f.name, f.dataType) for f in fields] == [(f.name, f.dataType) for f in queue.ENVELOPE]


def test_rectangles(spark):
    df = shapes.rectangle_range(spark)
    assert df.count() == 8000
    assert tuple(df.agg(F.min("length"), F.max("height")).first()) == (2000, 9999)
    assert df.select(shapes.area(F.col("length"), F.col("height"))).first()[0] == 4_000_000


def test_queue_fallback_table(spark, tmp_path):
    df = spark.createDataFrame([(b"x",)], "value binary")
    outputs.write_queue(df, None, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).columns == ["key", "value"]
    with pytest.raises(ValueError):
        outputs.write_queue(df, None)


def test_dead_letters_roll(spark, tmp_path):
    path = str(tmp_path / "fail")
    letters = spark.range(7).coalesce(1).select(F.lit("parse").alias("fail_class"), F.col("id").cast("string").alias("value"))
    outputs.write_dead_letters(letters, path, "c1", roll_rows=3)
    files = sorted(Path(path, "fail_class=parse").glob("err_c1_*"))
    assert len(files) == 3
    assert sorted(line for f in files for line in f.read_text().splitlines()) == [str(i) for i in range(7)]
    for _ in range(2):  # a replay
        outputs.write_batch_letters(letters, path, "c1", "send", 4)
    assert spark.read.text(path + "/fail_class=send").count() == 7


def test_outcome_handlers(spark, tmp_path):
    seen = {}
    handle = outputs.outcome_handlers(
        lambda df, i: seen.update(good=(i, df.count())), lambda df, i: seen.update(bad=(i, df.count())))
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, deal_tag boolean")
    handle(df, 8)
    assert seen == {"good": (8, 1), "bad": (8, 2)}
    outputs.outcome_handlers()(df, 9)
    outputs.write_outcomes(df, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "no")).count() == 2


SOURCE = {"record_type": "sms", "directory": "/in", "delete_policy": "immediate", "name_rule": "^sms",
          "separator": ",", "columns": "name, age,sex"}


def test_channels():
    spec = {"sources": {"s1": SOURCE, "half": {**SOURCE, "separator": ""}}, "sinks": {"k1": {"topic": "sms"}},
            "channels": {"c1": {"source": "s1", "sink": "k1"}}}
    channel = resolve(spec)["c1"]
    assert channel.source.schema().names == ["name", "age", "sex"] and channel.sink.topic == "sms"
    for broken in (
        {**spec, "sources": {"half": {**SOURCE, "directory": ""}}},
        {**spec, "sinks": {}}, {**spec, "channels": {}},
        {**spec, "channels": {"c1": {"source": "half", "sink": "k1"}}},
        {**spec, "channels": {"c1": {"source": "s1", "sink": "k2"}}},
    ):
        with pytest.raises(ValueError):
            resolve(broken)
    other = resolve({**spec, "sources": {"s1": {**SOURCE, "record_type": "fax"}}})["c1"]
    with pytest.raises(ValueError):
        other.source.schema()
    assert other.source.schema({"fax": RecordSchema((("name", "string"), ("age", "int32"), ("sex", "string")))})


def test_database_options(monkeypatch):
    env = database.Environment("e1", "postgres", {"host": "h", "port": "1", "dbname": "d", "sslmode": "disable"},
                               "E1_USER", "E1_SECRET", {"prefetch_rows": "500", "isolation": "SERIALIZABLE"})
    with pytest.raises(ValueError, match="E1_USER"):
        env.options()
    monkeypatch.setenv("E1_USER", "u")
    monkeypatch.setenv("E1_SECRET", "s")
    assert env.options() == {"url": "jdbc:postgresql://h:1/d?sslmode=disable", "user": "u", "password": "s",
                             "fetchsize": "500", "isolationLevel": "SERIALIZABLE"}
    with pytest.warns(UserWarning, match="stmt_cache_size"):
        assert database.driver_options({"stmt_cache_size": "5"}) == {}
    for wrong in ({"prefetch_rows": "-1"}, {"isolation": "NONE"}):
        with pytest.raises(ValueError):
            database.driver_options(wrong)
    with pytest.raises(ValueError, match="tns"):
        database.Environment("e2", "oracle", {}, "a", "b").url()
    with pytest.raises(ValueError, match="unknown driver"):
        database.Environment("e3", "db2", {}, "a", "b").url()


def test_staging(spark, tmp_path):
    with Staging(spark, str(tmp_path)) as staging:
        kept = staging.keep(spark.range(5), "x")
        assert kept.count() == 5
        assert exists(spark, staging.path)
    assert not exists(spark, staging.path)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")


def test_rolls_count_from_the_last_roll(spark, tmp_path, staging):
    """Against a writer that takes letter by letter; one file per roll, and letters keep their origin."""
    import json
    import random

    rng, clock, rows = random.Random(2), 0, []
    for n in range(120):
        clock += rng.choice([0, 1, 1, 5, 40])
        rows.append((rng.choice(["a", "a", "b", None]), n, clock, f"file{n % 3}", f"line {n}"))
    letters = spark.createDataFrame(rows, "channel string, line_num int, clock int, file_name string, value string")
    kept = outputs.dead_letters(letters, "value", origin=["channel", "file_name", "line_num", "clock"])
    rolled = outputs.roll_letters(kept, ["channel"], "clock", "line_num", 4, 30, staging)
    want, state = [], {}
    for channel, n, at, file, _ in rows:
        number, size, closed = state.get(channel, (0, 0, at))
        want.append((channel, number, n, file))
        full = size + 1 >= 4 or at - closed >= 30
        state[channel] = (number + 1, 0, at) if full else (number, size + 1, closed)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rolled.select("channel", "roll", "line_num", "file_name").collect())
    outputs.write_rolled_letters(rolled, str(tmp_path / "letters"), ["channel"], "line_num")
    files = list((tmp_path / "letters").rglob("*.json"))
    assert len(files) == len({(c, r) for c, r, _, _ in want})
    lines = [[json.loads(x) for x in f.read_text().splitlines()] for f in files]
    assert all([x["line_num"] for x in file] == sorted(x["line_num"] for x in file) for file in lines)
    assert sorted((x["file_name"], x["line_num"], x["value"]) for file in lines for x in file) == sorted((r[3], r[1], r[4]) for r in rows)


def test_a_roll_takes_a_file_and_no_folder(spark, tmp_path):
    """Listing folders is what many rolls cost; calls append, and a call that fails leaves nothing."""
    kinds = T.StructType.fromDDL("channel string, line_num int, value string, roll bigint")
    rows = [(c, n, f"line {n} \u00e4\n%", n // 3) for c in ("a", "b/%c", "", None) for n in range(61)]
    letters, path = spark.createDataFrame(rows, kinds), str(tmp_path / "letters")
    outputs.write_rolled_letters(letters, path, ["channel"], "line_num")
    assert len(list((tmp_path / "letters").rglob("*.json"))) == 4 * 21
    assert len([p for p in (tmp_path / "letters").rglob("*") if p.is_dir()]) == 3  # the empty text and NULL share one
    want = sorted([(c or None, *r) for c, *r in rows], key=str)
    assert sorted(map(tuple, outputs.read_rolled_letters(spark, path, kinds, ["channel"]).collect()), key=str) == want
    assert sorted(map(tuple, spark.read.schema(kinds).json(path).select(*kinds.names).collect()), key=str) == want
    with pytest.raises(Exception, match="no letter"):
        bad = F.when(F.col("line_num") == 60, F.raise_error(F.lit("no letter"))).otherwise(F.col("value"))
        outputs.write_rolled_letters(letters.withColumn("value", bad), path, ["channel"], "line_num")
    outputs.write_rolled_letters(letters.where("channel = 'a'"), path, ["channel"], "line_num")
    write(path, "_rolls-of-an-open-call/channel=a/roll-000000000000-0-0.json", "{}\n")
    assert outputs.read_rolled_letters(spark, path + "/", kinds, ["channel"]).count() == 5 * 61
    assert [p.name for p in (tmp_path / "letters").iterdir() if p.name.startswith("_")] == ["_rolls-of-an-open-call"]


def test_database_rows_get_zone_and_wide_numbers(spark):
    rows = spark.sql("select timestamp_ntz'2024-07-01 12:00:00' t, 1.5bd d, 3 i, 'x' s")
    got = database.database_rows(rows, "Asia/Shanghai")
    assert [f.dataType.simpleString() for f in got.schema] == ["timestamp", "double", "bigint", "string"]
    assert got.selectExpr("unix_seconds(t)").first()[0] == unix_of(2024, 7, 1, 4)
    assert [f.dataType.simpleString() for f in database.database_rows(rows, strict=True).schema] == [
        "timestamp_ntz", "decimal(2,1)", "bigint", "string"]


def unix_of(*utc):
    return int(datetime(*utc, tzinfo=timezone.utc).timestamp())
