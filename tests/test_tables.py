"""The append-only store: increments, deletions, one version per reader, merging, and resumed runs."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.plans import tables
from millrace.plans.jobs import CallBlock, CommonBlock, Delete, Insert, Job, LoopBlock, Param, Procedure, Select, Update, execute, run_jobs
from millrace.plans.tables import AT, FILE, ConflictError, TableStore

SCHEMA = "key bigint, label string, amount int"


@pytest.fixture()
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    base = spark.range(100).select(F.col("id").alias("key"), F.lit("a").alias("label"), F.col("id").cast("int").alias("amount")).repartition(3)
    store.publish({"t": base, "empty": base.where("false")})
    return store


def rows(store, name="t"):
    return Counter(tuple(r) for r in store.read(name).collect())


def written(store, kind):
    """Folders of a kind and the files in them."""
    found = sorted(Path(store.root, "t").glob(f"{kind}-*"))
    return found, [f for p in found for f in p.glob("*.parquet")]


def places(store, condition, name="t"):
    return store.begin().placed(name).where(condition).select(FILE, AT)


def run(spark, store, *statements, **variables):
    execute(spark, store, Procedure("p", (CommonBlock(1, statements),)), variables)


def test_an_inserted_row_is_one_small_file(spark, store):
    before = {p: p.stat().st_mtime_ns for p in written(store, "rows")[1]}
    run(spark, store, Insert(1, "t", "select 1000, 'new', 5"))
    after = written(store, "rows")[1]
    fresh = [p for p in after if p not in before]
    assert len(fresh) == 1 and fresh[0].stat().st_size < 4000
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert rows(store)[(1000, "new", 5)] == 1 and sum(rows(store).values()) == 101


def test_a_delete_writes_bitmaps_only(spark, store):
    folders = written(store, "rows")[0]
    run(spark, store, Delete(1, "t", "key % 2 = 0"), Delete(2, "t", "key = 1"), Delete(3, "t", "key = 2"))
    assert written(store, "rows")[0] == folders
    assert sorted(k for k, _, _ in rows(store)) == list(range(3, 100, 2))
    again = TableStore(spark, store.root)
    assert rows(again) == rows(store)
    run(spark, store, Delete(1, "t"))
    assert not rows(store) and written(store, "rows")[0] == folders


def test_rows_affected_are_those_of_the_statements(spark, store):
    body = Procedure("p", (CommonBlock(1, (
        Delete(1, "t", "key < 10"), Update(2, "t", {"amount": "amount + 1"}, "key < 15"), Insert(3, "t", "select * from t where key < 12"))),))
    (row,) = run_jobs(spark, store, [body], [Job("p")]).collect()
    assert row["rows_written"] == {"t": 7} and row["rows_deleted"] == {"t": 10}
    assert rows(store)[(11, "a", 12)] == 2


def test_a_loop_writes_one_increment_per_commit(spark, store):
    parts = len(store.table("t").parts)
    loop = LoopBlock(1, Param("v", "Int"), (1, 2, 3, 4, 5), (Insert(1, "t", "select #{v}, 'x', 0"),), commit_every=1)
    version = store.version
    execute(spark, store, Procedure("p", (loop,)), {})
    assert store.version == version + 5 and len(store.table("t").parts) == parts + 5
    sizes = [n for _, n in store.table("t").parts]
    assert sizes == [100, 1, 1, 1, 1, 1]


def test_a_reader_sees_one_version(spark, store):
    reader = TableStore(spark, store.root)
    frame, before = reader.read("t"), rows(store)
    change = store.begin()
    change.delete("t", places(store, "key < 50"))
    change.insert("t", spark.createDataFrame([(-1, None, None)], SCHEMA))
    assert rows(TableStore(spark, store.root)) == before  # written, not committed
    store.commit(change)
    assert Counter(tuple(r) for r in frame.collect()) == before  # and an old frame stays what it was
    assert sum(rows(TableStore(spark, store.root)).values()) == 51


def test_the_second_of_two_writers_is_told(spark, store):
    other = TableStore(spark, store.root)
    run(spark, store, Insert(1, "t", "select 1, 'x', 1"))
    with pytest.raises(ConflictError):
        run(spark, other, Insert(1, "t", "select 2, 'y', 2"))
    assert rows(TableStore(spark, store.root)) == rows(store)


def test_random_statements_equal_a_list(spark, store, monkeypatch):
    monkeypatch.setattr(tables, "MERGE_AT", 3)
    monkeypatch.setattr(tables, "CHECKPOINT_EVERY", 4)
    monkeypatch.setattr(tables, "MAX_BITMAPS", 6)
    rng, model, fresh = random.Random(8), list(rows(store).elements()), 1000
    for _ in range(14):
        a, b = rng.randrange(2, 6), rng.randrange(3)
        action = rng.choice(["insert", "delete", "update"])
        if action == "insert":
            run(spark, store, Insert(1, "t", "select key + #{n}, label, amount from t where key % #{a} = #{b}"), n=fresh, a=a, b=b)
            model += [(k + fresh, s, m) for k, s, m in model if k % a == b]
            fresh += 7919
        elif action == "delete":
            run(spark, store, Delete(1, "t", "key % #{a} = #{b} and amount % 5 = #{b}"), a=a, b=b)
            model = [r for r in model if not (r[0] % a == b and r[2] % 5 == b)]
        else:
            run(spark, store, Update(1, "t", {"amount": "amount + 1", "label": "nullif(label, 'b')"}, "key % #{a} = #{b}"), a=a, b=b)
            model = [(k, s, m + 1) if k % a == b else (k, s, m) for k, s, m in model]
        assert rows(store) == Counter(model)
    again = TableStore(spark, store.root)
    assert rows(again) == Counter(model) and again.version == store.version
    gone = store.vacuum()
    assert gone and rows(TableStore(spark, store.root)) == Counter(model)


def test_many_commits_leave_few_parts(spark, store, monkeypatch):
    monkeypatch.setattr(tables, "MERGE_AT", 3)
    for k in range(13):
        run(spark, store, Insert(1, "empty", f"select {k}, 'x', {k}"))
    assert rows(store, "empty") == Counter((k, "x", k) for k in range(13))
    assert len(store.table("empty").parts) <= 6


def test_attached_files_are_never_changed(spark, store, tmp_path):
    path = str(tmp_path / "given")
    spark.range(10).select(F.col("id").alias("key")).write.parquet(path)
    before = sorted(p.name for p in Path(path).iterdir())
    store.attach("given", path)
    run(spark, store, Delete(1, "given", "key > 3"), Insert(2, "given", "select 77"))
    assert sorted(r["key"] for r in TableStore(spark, store.root).read("given").collect()) == [0, 1, 2, 3, 77]
    assert sorted(p.name for p in Path(path).iterdir()) == before


def test_a_failed_block_leaves_nothing_behind(spark, store):
    before, files = rows(store), written(store, "*")[0]
    with pytest.raises(Exception, match="no"):
        run(spark, store, Delete(1, "t", "key < 5"), Insert(2, "t", "select 1, 'x', cast(raise_error('no') as int)"))
    assert rows(store) == before and written(store, "*")[0] == files


def test_a_run_goes_on_where_it_failed(spark, store):
    """Each step is applied once, and variables have the values of the last commit."""
    body = Insert(1, "t", "select #{v}, 'run', if(#{v} = 3 and (select count(*) from empty) = 0, cast(raise_error('closed') as int), #{n})")
    inner = Procedure("inner", (CommonBlock(1, (Insert(1, "t", "select 500, 'inner', 0"), Select(2, "select count(*) from t", (Param("seen", "int"),)))),),
                      out_params=(Param("seen", "int"),))
    outer = Procedure("outer", (
        CallBlock(1, "inner"),
        CommonBlock(2, (Select(1, "select count(*) from t", (Param("n", "int"),)),)),
        LoopBlock(3, Param("v", "Int"), (1, 2, 3, 4, 5), (body,), commit_every=2),
        CommonBlock(4, (Insert(1, "t", "select #{n}, 'end', #{seen}"),)),
    ))
    job = [Job("outer", run_id="r")]
    (first,) = run_jobs(spark, store, [inner, outer], job).collect()
    assert "closed" in first["error"] and sum(n for (_, s, _), n in rows(store).items() if s == "run") == 2
    other = TableStore(spark, store.root)  # another process takes over
    change = other.begin()
    change.insert("empty", spark.createDataFrame([(1, "open", 1)], SCHEMA))
    other.commit(change)
    (second,) = run_jobs(spark, other, [inner, outer], job).collect()
    assert second["result_info"] == "success" and second["rows_written"] == {"t": 4}
    got = rows(other)
    assert {r: n for r, n in got.items() if r[1] != "a"} == {
        **{(v, "run", 101): 1 for v in range(1, 6)}, (500, "inner", 0): 1, (101, "end", 101): 1}
    assert not other.tokens  # a later run with this name starts anew
