"""Operators against row-at-a-time models on small random input."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import allot, batching, deal, lag, merge, numbering, records


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture()
def many_runs(spark):
    """Keep small shuffles in several partitions, so that runs and offsets matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# --- numbering ---------------------------------------------------------------------------------

def test_dense_index_of_a_skewed_group(many_runs, staging):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.random(), i) for i in range(3000)]
    df = many_runs.createDataFrame(rows, "g string, o double, i int").repartition(5)
    got = numbering.dense_index(df, ["o", "i"], ["g"], staging=staging).collect()
    assert len(got) == len(rows)
    for group in ("hot", "a", "b", None):
        mine = sorted((r["o"], r["i"], r["row_index"]) for r in got if r["g"] == group)
        assert [m[2] for m in mine] == list(range(len(mine)))
    runs = many_runs.read.parquet(f"{staging.path}/runs-0")
    hot_runs = runs.where("g = 'hot'").select(F.shiftright("__mark", 33)).distinct().count()
    assert hot_runs > 1  # the hot group was not gathered in one task


def test_dense_index_without_group(many_runs, staging):
    df = many_runs.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    indexed, n = numbering.index_and_count(df, [F.col("k").desc()], staging=staging)
    assert n == 1000
    assert indexed.where(F.col("row_index") != 999 - F.col("k")).isEmpty()
    empty, none = numbering.index_and_count(df.limit(0), ["k"], staging=staging)
    assert none == 0 and empty.isEmpty()


def test_chunks_and_sequences(many_runs, staging):
    df = many_runs.range(1, 1004)
    sizes = rows_of(numbering.chunk_number(df, ["id"], 500, staging=staging).groupBy("chunk").count())
    assert sizes == [(0, 500), (1, 500), (2, 3)]
    seq = numbering.assign_sequence(df, ["id"], start=10, step=5, staging=staging)
    assert seq.where(F.col("seq") != 10 + (F.col("id") - 1) * 5).isEmpty()
    sparse = numbering.assign_sequence(df, ["id"], dense=False)
    assert sparse.select("seq").distinct().count() == 1003
    with pytest.raises(ValueError):
        numbering.chunk_number(df, ["id"], 0)


# --- records -----------------------------------------------------------------------------------

LINES = ["nora,31,female", "bob,x,male", "only,two", "a,1,b,extra", "", ",,", "neg,-5,m", "big,4294967297,m"]


def test_strict_parse(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, value string")
    got = [tuple(r) for r in records.parse_lines(df, records.PERSON).orderBy("i").select(
        "reject_reason", "name", "age", "sex").collect()]
    bad = (records.WRONG_ARITY, None, None, None)
    assert got == [(None, "nora", 31, "female"), (None, "bob", 0, "male"), bad, bad, bad, (None, "", 0, ""),
                   (None, "neg", -5, "m"), (None, "big", 1, "m")]


def test_separator_is_plain_text(spark):
    df = spark.createDataFrame([("a|1|b",), ("a.1.b",)], "value string")
    assert records.parse_lines(df, records.PERSON, "|").where("reject_reason is null").count() == 1
    with pytest.raises(ValueError):
        records.cells(F.col("value"), "")


def test_dispatch_by_type(spark):
    df = spark.createDataFrame([("sms", "a,1,f"), ("gprs", "b,2,m"), ("fax", "c,3,m"), ("gsm", "d,4"), (None, "e,5,m")],
                               "t string, value string")
    parsed = records.merge_same_layout(records.parse_by_type(df, F.col("t")))
    got = {r["value"]: (r["reject_reason"], r["name"], r["age"]) for r in parsed.collect()}
    assert got == {"a,1,f": (None, "a", 1), "b,2,m": (None, "b", 2),
                   "c,3,m": (records.UNKNOWN_TYPE, None, None), "d,4": (records.WRONG_ARITY, None, None),
                   "e,5,m": (records.UNKNOWN_TYPE, None, None)}
    good, bad = records.split_rejects(parsed)
    assert (good.count(), bad.count()) == (2, 3)


def test_schemas(spark):
    assert records.PERSON.only(["sex", "name"]).names == ["sex", "name"]
    with pytest.raises(ValueError):
        records.PERSON.only(["height"])
    with pytest.raises(ValueError):
        records.RecordSchema((("a", "date"),))


def test_lines_and_payloads(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "name string, age int, sex string")
    assert rows_of(df.select(records.record_line(["age", "name", "sex"], ";"))) == [("1;a;",), ("2;b;x",)]
    back = df.select(records.from_payload(records.to_payload(df.columns), df.schema).alias("r")).select("r.*")
    assert rows_of(back) == rows_of(df)


# --- lag and allotment -------------------------------------------------------------------------

def allot_model(items, workers, slot):
    workers = sorted(workers)
    n = len(workers)
    return sorted((workers[slot(i, n)], *item) for i, item in enumerate(items))


def test_round_robin_model(many_runs, staging):
    items = [(t, p) for t in ("b", "a") for p in range(7)]
    workers = ["w3", "w1", "w2"]
    got = allot.round_robin(many_runs.createDataFrame(items, "topic string, partition int"),
                            many_runs.createDataFrame([(w,) for w in workers], "worker string"), staging)
    assert rows_of(got) == allot_model(sorted(items), workers, lambda i, n: i % n)


@pytest.mark.parametrize("ascending", [False, True])
def test_snake_model(many_runs, staging, ascending):
    rng = random.Random(7)
    lags = [("t", p, rng.randrange(5)) for p in range(14)]
    workers = ["w1", "w2", "w3"]
    ranked = sorted(lags, key=lambda x: (x[2] if ascending else -x[2], x[0], x[1]))

    def slot(i, n):
        walk = [*range(n), *reversed(range(n))]
        return walk[i % len(walk)]

    got = allot.snake(many_runs.createDataFrame(lags, "topic string, partition int, lag bigint"),
                      many_runs.createDataFrame([(w,) for w in workers], "worker string"), ascending, staging)
    assert rows_of(got) == allot_model([x[:2] for x in ranked], workers, slot)


def test_rebalance_guards(spark, staging):
    def frame(lags):
        return spark.createDataFrame([("t", p, v) for p, v in enumerate(lags)], "topic string, partition int, lag bigint")

    current = spark.createDataFrame([("w1", "t", 0), ("w2", "t", 1), ("w1", "t", 2)],
                                    "worker string, topic string, partition int")
    assert allot.rebalance(frame([500, 0, 1]), current, staging=staging)[0]
    assert not allot.rebalance(frame([100, 0, 1]), current, staging=staging)[0]
    assert not allot.rebalance(frame([500, 0]), current, staging=staging)[0]
    with pytest.raises(ValueError):
        allot.round_robin(current, current.select("worker").limit(0), staging)


def test_diff_and_change(spark):
    old = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "worker string, n int")
    new = spark.createDataFrame([("a", 1), ("c", 3), ("c", 3)], "worker string, n int")
    assert rows_of(allot.table_diff(old, new)) == [
        ("a", 1, "removed"), ("b", 2, "removed"), ("c", 3, "added"), ("c", 3, "added")]
    assert allot.changed_workers(old, new)
    assert not allot.changed_workers(old, new.limit(0))
    assert not allot.changed_workers(old, old)


def test_lag_rules(spark):
    messages = spark.createDataFrame(
        [("t", 0, 5, True), ("t", 0, 6, False), ("t", 0, 9, True), ("t", 0, 200, False), ("t", 1, 3, False)],
        "topic string, partition int, offset bigint, ok boolean")
    progress = lag.progress(messages, F.col("ok"))
    assert rows_of(progress) == [("t", 0, 9, 201), ("t", 1, 0, 4)]
    assert rows_of(lag.lag_report(progress)) == [("t", 0, 9, 201, 192, 191, True), ("t", 1, 0, 4, 4, 3, False)]
    both = lag.join_progress(lag.newest_offset(messages), lag.last_ok_offset(messages.where("partition = 0"), F.col("ok")))
    assert rows_of(both.select(*progress.columns)) == rows_of(progress)


# --- merge -------------------------------------------------------------------------------------

def test_upsert_is_the_sequential_loop(spark, staging):
    rng = random.Random(11)
    target = [(k, f"t{k}", k) for k in range(20)] + [(None, "loose", 0)]
    cursor = [(rng.choice([None, *range(30)]), f"c{i}", rng.randrange(100), i) for i in range(60)]
    state = list(target)
    for k, name, n, _ in cursor:
        state = [row for row in state if k is None or row[0] != k] + [(k, name, n)]
    frame = spark.createDataFrame(target, "k int, name string, n int")
    changes = spark.createDataFrame(cursor, "k int, name string, n int, i int").repartition(4)
    got = merge.upsert(frame, changes, ["k"], ["i"], staging)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(state, key=key)
    affected = merge.rows_affected(frame, changes, ["k"]).first()
    keys = {c[0] for c in cursor if c[0] is not None}
    assert affected["updated"] == sum(1 for t in target if t[0] in keys)
    assert affected["inserted"] == len(keys - {t[0] for t in target}) + sum(1 for c in cursor if c[0] is None)


def test_update_is_the_sequential_loop(spark, staging):
    rng = random.Random(5)
    target = [(k, k * 10) for k in range(10)] + [(None, 7), (3, 31)]
    cursor = [(rng.choice([None, *range(15)]), rng.randrange(100), i) for i in range(40)]
    state = [list(row) for row in target]
    for k, value, _ in cursor:
        for row in state:
            if k is not None and row[0] == k:
                row[1] = value
    got = merge.update_matching(
        spark.createDataFrame(target, "k int, v int"), spark.createDataFrame(cursor, "k int, w int, i int"),
        ["k"], ["i"], {"v": "w"}, staging)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got.collect()) == sorted(
        (r[0] is None, r[0] or 0, r[1]) for r in state)


def test_delete_keeps_null_keys(spark, staging):
    target = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    cursor = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(merge.delete_matching(target, cursor, ["k"], staging).collect(), key=str) == [(2,), (None,)]


def test_override_expand(spark, staging):
    groups = spark.createDataFrame([("g1", "c1", "u"), ("g2", "c2", "u"), ("g3", "none", "u")],
                                   "group string, cluster string, login string")
    clusters = spark.createDataFrame([("c1", "n1"), ("c1", "n2"), ("c2", "n3")], "cluster string, member string")
    details = spark.createDataFrame([("g2", "own", "me"), ("g9", "new", "me")], "group string, member string, login string")
    assert rows_of(merge.override_expand(groups, clusters, details, staging=staging)) == [
        ("g1", "n1", "u"), ("g1", "n2", "u"), ("g2", "own", "me"), ("g9", "new", "me")]
    assert merge.override_expand(groups, clusters, details, [], staging).isEmpty()


def test_statements(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows_of(merge.delete_where(df, F.col("v") == "a")) == [(2, None)]
    assert merge.delete_where(df).isEmpty()
    assert rows_of(merge.update_where(df, {"k": F.lit("9")}, F.col("v") == "a")) == [(2, None), (9, "a")]
    extra = spark.createDataFrame([("5",)], "x string")
    assert rows_of(merge.insert_rows(df, extra, ["k"])) == [(1, "a"), (2, None), (5, None)]
    with pytest.raises(ValueError):
        merge.insert_rows(df, extra)
    assert merge.loop_expand(df, "quarter", [1, 2, 3]).count() == 6


# --- deal --------------------------------------------------------------------------------------

def test_deal_each_tags_failures(spark):
    df = spark.createDataFrame([(i, str(i).encode()) for i in range(10)], "i int, value binary")

    def halve(payload):
        number = int(payload)
        if number % 2:
            raise ValueError(f"odd {number}")
        return str(number // 2).encode()

    got = {r["i"]: r for r in deal.deal_each(df, halve).collect()}
    assert all(got[i]["deal_tag"] == (i % 2 == 0) for i in range(10))
    assert bytes(got[8]["result"]) == b"4" and got[3]["error"] == "odd 3" and got[3]["result"] is None
    good, bad = deal.split_outcomes(deal.deal_each(df, halve))
    assert (good.count(), bad.count()) == (5, 5)


def test_failed_batch_call_fails_its_messages(spark):
    df = spark.createDataFrame([(i, str(i).encode()) for i in range(9)], "i int, value binary").coalesce(1)

    def batch(payloads):
        if b"4" in payloads:
            raise RuntimeError("down")
        return [ValueError("seven") if p == b"7" else p for p in payloads]

    got = {r["i"]: (r["deal_tag"], r["error"]) for r in deal.deal_batches(df, batch, 3).collect()}
    assert {i for i, (ok, _) in got.items() if not ok} == {3, 4, 5, 7}
    assert got[3][1] == "down" and got[7][1] == "seven"
    short = deal.deal_batches(df, lambda p: p[:1], 3)
    assert short.where("deal_tag").isEmpty()


# --- batches -----------------------------------------------------------------------------------

def batch_model(clocks, max_rows, max_wait):
    numbers, batch, size, last = [], 0, 0, clocks[0]
    for clock in clocks:
        size += 1
        numbers.append(batch)
        if size >= max_rows or clock - last >= max_wait:
            batch, size, last = batch + 1, 0, clock
    return numbers, batch


@pytest.mark.parametrize("max_rows,max_wait,segment,block", [
    (1, 5, 2, 3), (4, 6, 5, 2), (4, 6, 500, 1000), (7, 0, 8, 1000), (5, 10**6, 6, 4)])
def test_count_or_time_model(many_runs, staging, max_rows, max_wait, segment, block):
    rng = random.Random(max_rows * 31 + segment)
    rows = []
    for key, length in (("hot", 160), ("b", 37), ("c", 1), ("d", segment), ("e", 2 * segment)):
        clock = 1000
        for offset in range(length):
            clock += rng.choice([0, 0, 1, 2, 9])
            rows.append((key, 0, clock, offset))
    df = many_runs.createDataFrame(rows, "topic string, partition int, clock bigint, offset bigint").repartition(3)
    got = batching.count_or_time(df, max_rows=max_rows, max_wait=max_wait, segment_rows=segment,
                                 block_segments=block, staging=staging).toPandas()
    assert len(got) == len(rows)
    for key, group in got.sort_values("offset").groupby("topic"):
        numbers, closed = batch_model(group["clock"].tolist(), max_rows, max_wait)
        assert group["batch"].tolist() == numbers, key
        assert group["closed"].tolist() == [n < closed for n in numbers], key
    with pytest.raises(ValueError):
        batching.count_or_time(df, max_rows=5, segment_rows=5)
