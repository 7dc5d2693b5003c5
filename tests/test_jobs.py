"""SQL jobs: parameters, binds, blocks, failures, timeouts, and the run log."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import jobs
from millrace.plans.jobs import (
    CallBlock, CommonBlock, CursorBlock, Delete, Insert, Job, JobError, LoopBlock, Param, Procedure, Select, Update,
    bind, checked_arguments, execute, out_string, parse_parameters, run_jobs, run_outcome, run_sql, number_placeholders,
)
from millrace.plans.tables import TableStore


@pytest.fixture()
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "key int, label string, amount int")
    store.publish({"source": base, "target": base.where("key < 3"), "copy": base.limit(0)})
    return store


def rows(store, name):
    return sorted(tuple(r) for r in store.read(name).collect())


def one(*statements):
    return Procedure("p", (CommonBlock(1, statements),))


def test_parameters():
    p = Procedure("p", (), (Param("RegionCode", "string"), Param("channel", "Int")))
    assert parse_parameters(p, "x,-5") == {"regioncode": "x", "channel": -5}
    assert parse_parameters(Procedure("q", ()), "") == {}
    for wrong in ("x", "x,1,2", "x,y", ""):
        with pytest.raises(JobError):
            parse_parameters(p, wrong)
    with pytest.raises(JobError):
        Param("a", "date")


def test_bind():
    assert bind("a = #{X} and b = #{y}", {"x": 1, "y": "s"}) == ("a =  :x  and b =  :y ", {"x": 1, "y": "s"})
    assert bind("from ${T}_1", {"t": "db.tab"})[0] == "from db.tab_1"
    for sql, known in (("#{no}", {}), ("${no}", {}), ("a # b", {}), ("a $ b", {}), ("${t}", {"t": "x; drop"})):
        with pytest.raises(JobError):
            bind(sql, known)
    assert checked_arguments([1, "a", None, 2.5, True, b"x"])
    with pytest.raises(JobError):
        checked_arguments({"a": object()})


def test_binds_by_name_and_position(spark):
    import datetime
    import decimal

    values = [None, b"x", datetime.datetime(2024, 1, 2, 3), "s", 5, 2.5, True, decimal.Decimal("1.25")]
    got = run_sql(spark, "select ?, ?, ?, ?, ?, ?, ?, ?", values).first()
    assert [bytes(v) if isinstance(v, bytearray) else v for v in got] == values
    assert number_placeholders("a = ? and b = '?' -- ?\nand `c?` = ?") == "a = :p1 and b = '?' -- ?\nand `c?` = :p2"
    assert list(run_sql(spark, "select " + ", ".join("?" * 12), list(range(12))).first()) == list(range(12))
    assert run_sql(spark, "select :a + :b", {"a": 1, "b": 2}).first()[0] == 3


def test_orders_must_differ():
    with pytest.raises(JobError):
        Procedure("p", (CommonBlock(1, ()), CommonBlock(1, ())))
    with pytest.raises(JobError):
        one(Delete(1, "t"), Delete(1, "t"))


def test_common_block_runs_in_order(spark, store):
    execute(spark, store, one(
        Insert(3, "copy", "select key, label, amount from target", ("key", "label", "amount")),
        Delete(1, "copy"),
        Update(2, "target", {"amount": "amount + #{n}"}, "key = #{who}"),
    ), {"N": 5, "who": 2})
    assert rows(store, "copy") == [(1, "a", 10), (2, "b", 25)]


def test_delete_keeps_rows_without_an_answer(spark, store):
    store.publish({"target": spark.createDataFrame([(1, None, 1), (2, "b", 2)], "key int, label string, amount int")})
    execute(spark, store, one(Delete(1, "target", "label = 'b'")), {})
    assert rows(store, "target") == [(1, None, 1)]


def test_select_into(spark, store):
    count = Select(1, "select count(*), max(label) from source where amount >= #{low}", (Param("N", "int"), Param("top", "string")))
    after = execute(spark, store, one(count), {"low": 20})
    assert (after["n"], after["top"]) == (2, "c")
    for sql, into in (("select key from source where false", (Param("x", "int"),)),
                      ("select cast(null as int)", (Param("x", "int"),)),
                      ("select 1, 2", (Param("x", "int"),)), ("select 'z'", (Param("x", "int"),)),
                      ("select 1", ())):
        with pytest.raises(JobError):
            execute(spark, store, one(Select(1, sql, into)), {})


def test_failed_block_changes_nothing(spark, store):
    before = rows(store, "target")
    for failing in (Insert(2, "copy", "select raise_error('no')"), Insert(2, "copy", "select nope from source"),
                    Update(2, "copy", {"zz": "1"}), Delete(2, "missing", "true")):
        with pytest.raises(Exception):
            execute(spark, store, one(Delete(1, "target"), failing), {})
        assert rows(store, "target") == before
    assert rows(TableStore(spark, store.root), "target") == before


def test_loop_commits_in_chunks(spark, store):
    body = (Insert(1, "copy", "select cast(if(#{v} = 4, raise_error('stop'), #{v}) as int), 'x', #{v}"),)
    with pytest.raises(Exception, match="stop"):
        execute(spark, store, Procedure("p", (LoopBlock(1, Param("v", "Int"), (1, 2, 3, 4), body, commit_every=2),)), {})
    assert [r[0] for r in rows(store, "copy")] == [1, 2]  # the first chunk stays, the open one is gone


def test_cursor_actions(spark, store):
    def run(action, **more):
        block = CursorBlock(1, "select key, label, amount from source where key > 1", "target", action, **more)
        execute(spark, store, Procedure("p", (block,)), {})
        return rows(store, "target")

    keyed = {"key": ("key",), "order_by": ("amount",)}
    assert run("update", assign={"label": "concat(label, '!')"}, **keyed) == [(1, "a", 10), (2, "b!", 20)]
    assert run("replace", assign={"amount": "amount + 1"}, **keyed) == [(1, "a", 10), (2, "b", 21), (3, "c", 31)]
    assert run("insert") == [(1, "a", 10), (2, "b", 20), (2, "b", 21), (3, "c", 30), (3, "c", 31)]
    assert run("delete", key=("key",)) == [(1, "a", 10)]
    for action, more in (("delete", {}), ("replace", {"key": ("key",)}), ("merge", keyed)):
        with pytest.raises(JobError):
            run(action, **more)


def test_calls(spark, store):
    inner = Procedure("inner", (CommonBlock(1, (Select(1, "select #{a} + 1", (Param("b", "int"),)),)),),
                      (Param("a", "int"),), (Param("b", "int"),))
    outer = Procedure("outer", (CallBlock(1, "inner", ("start",)),))
    endless = Procedure("endless", (CallBlock(1, "endless"),))
    known = {p.name: p for p in (inner, outer, endless)}
    assert execute(spark, store, outer, {"start": 4}, known)["b"] == 5
    for procedure in (endless, Procedure("x", (CallBlock(1, "nope"),)), Procedure("x", (CallBlock(1, "inner"),))):
        with pytest.raises(JobError):
            execute(spark, store, procedure, {}, known)


def test_run_log(spark, store):
    good = Procedure("good", (CommonBlock(1, (
        Select(1, "select #{a} * 2", (Param("resultCode", "int"),)),
        Insert(2, "copy", "select * from source"))),),
        (Param("a", "int"),), (Param("resultCode", "int"), Param("resultInfo", "string")))
    bad = one(Insert(1, "copy", "select nope"))
    slow = Procedure("slow", (CommonBlock(1, (
        Insert(1, "copy", "select cast(sum(id % 7) % 1000 as int), 'x', 0 from range(100000000000)"),)),))
    done, failed = [], []
    log = run_jobs(spark, store, [good, bad, slow],
                   [Job("good", "21", "e1"), Job("p"), Job("good", "x"), Job("nope"), Job("slow", timeout=2.0), Job("good", "1")],
                   done.append, failed.append)
    got = log.collect()
    assert [r["result_code"] for r in got] == [jobs.OK, jobs.FAILED, jobs.FAILED, jobs.FAILED, jobs.TIMED_OUT, jobs.OK]
    assert got[0]["out_params"] == "resultcode=42" and "resultinfo" in got[0]["error"]
    assert got[0]["rows_written"] == {"copy": 3}
    assert (len(done), len(failed)) == (2, 4)
    outcome = {(r["procedure"], r["result_code"]): r["count"] for r in run_outcome(log).collect()}
    assert outcome[("good", jobs.OK)] == 2 and outcome[("slow", jobs.TIMED_OUT)] == 1
    assert len(rows(store, "copy")) == 6


def test_out_string():
    p = Procedure("p", (), (), (Param("a", "int"), Param("b", "string"), Param("c", "int")))
    assert out_string(p, {"a": 1, "c": 3}) == ("a=1,c=3", ["b"])


def test_store_versions(spark, store):
    frame = store.read("source").withColumn("amount", F.col("amount") + 1)
    assert store.publish({"source": frame}) == {"source": 3}
    again = TableStore(spark, store.root)
    assert again.names() == ["copy", "source", "target"]
    assert rows(again, "source")[0] == (1, "a", 11)
    with pytest.raises(KeyError):
        again.read("nope")
