"""Running state along a cursor against a row-at-a-time model."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators.running import Carried, Clamped, run_along
from millrace.plans.jobs import CursorBlock, JobError, Procedure, Running, execute
from millrace.plans.tables import TableStore
from millrace.session import ship


def table(spark, n=300, seed=1):
    rng = random.Random(seed)

    def maybe(value, share):
        return value if rng.random() > share else None

    rows = [(rng.choice(["hot", "hot", "hot", "k", None]), i, maybe(rng.randrange(-50, 50), 0.1), maybe(rng.randrange(-80, 0), 0.5),
             maybe(rng.randrange(-20, 90), 0.5), maybe(f"v{i}", 0.8), "clash") for i in rng.sample(range(10 * n), n)]
    return spark.createDataFrame(rows, "key string, at int, add int, low int, high int, word string, state string")


def model(rows, start, step):
    """(at, before, after) for every row, key by key in order."""
    state = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        before = state.get(r["key"], start)
        state[r["key"]] = step(before, r)
        yield r["at"], before, state[r["key"]]


def clamp(x, r):
    x += r["add"] or 0
    x = x if r["low"] is None else max(x, r["low"])
    return x if r["high"] is None else min(x, r["high"])


BODIES = {
    "sum": (Clamped(add="add", start=7), 7, lambda x, r: x + (r["add"] or 0)),
    "limits": (Clamped("add", "low", "high"), 0, clamp),
    "reset": (Clamped("add", "low", "low"), 0, lambda x, r: r["low"] if r["low"] is not None else x + (r["add"] or 0)),
    "least": (Clamped(high="high", start=1000), 1000, lambda x, r: x if r["high"] is None else min(x, r["high"])),
    "carried": (Carried("word", "string"), None, lambda x, r: r["word"] if r["word"] is not None else x),
}


@pytest.mark.parametrize("segment_rows", [2, 5, 64, 10_000])
@pytest.mark.parametrize("name", list(BODIES))
def test_equals_the_loop(spark, staging, name, segment_rows):
    if segment_rows == 2 and name not in ("limits", "carried"):
        pytest.skip("many levels are tried with two bodies")
    ship(spark)
    body, start, step = BODIES[name]
    df = table(spark, 60 if segment_rows == 2 else 300)
    got = run_along(df, ["key"], ["at"], body, "state", "before", segment_rows, staging)
    assert sorted(got.columns) == sorted([*df.columns, "before"])
    assert sorted((r["at"], r["before"], r["state"]) for r in got.collect()) == sorted(model(df.collect(), start, step))


def test_decimals_are_exact(spark, staging):
    ship(spark)
    df = spark.range(200).select("id", (F.col("id") / 100).cast("decimal(10,2)").alias("d"))
    got = run_along(df, [], ["id"], Clamped(add="d", scale=2), "sum", segment_rows=7, staging=staging)
    assert got.where("id = 199").first()["sum"] == Decimal("199.00") and got.schema["sum"].dataType.scale == 2


def test_empty_and_bad_input(spark, staging):
    ship(spark)
    df = table(spark, 5)
    assert run_along(df.limit(0), ["key"], ["at"], Clamped(add="add"), staging=staging).count() == 0
    with pytest.raises(ValueError):
        run_along(df, ["key"], ["at"], Clamped(), segment_rows=1)
    with pytest.raises(Exception, match="62 bits"):
        run_along(df.withColumn("add", F.lit(1 << 61)), [], ["at"], Clamped(add="add"), staging=staging).collect()


def test_cursor_bodies_that_need_the_row_before(spark, tmp_path):
    ship(spark)
    store = TableStore(spark, str(tmp_path / "store"))
    moves = table(spark, 80).drop("state").where("key is not null")
    store.publish({"moves": moves, "accounts": spark.createDataFrame([("k", 0), ("x", 5)], "key string, balance int"),
                   "book": moves.select("key", "at", F.lit(0).alias("was"), F.lit(0).alias("now")).where("false")})
    running = Running("total", add="add * 2", low="-30", start=10)
    query = "select key, at, add from moves"
    execute(spark, store, Procedure("p", (
        CursorBlock(1, query, "book", "insert", order_by=("at",), within=("key",), running=running,
                    assign={"was": "total_before", "now": "total"}),
        CursorBlock(2, query, "accounts", "update", key=("key",), order_by=("at",), within=("key",), running=running, assign={"balance": "total"}),
    )), {})
    want = sorted(model(moves.collect(), 10, lambda x, r: max(x + 2 * (r["add"] or 0), -30)))
    assert sorted((r["at"], r["was"], r["now"]) for r in store.read("book").collect()) == want
    last = {r["key"]: dict((a, n) for a, _, n in want)[r["at"]] for r in sorted(moves.collect(), key=lambda r: r["at"])}
    assert {tuple(r) for r in store.read("accounts").collect()} == {("k", last["k"]), ("x", 5)}
    with pytest.raises(JobError):
        execute(spark, store, Procedure("p", (CursorBlock(1, query, "book", "insert", running=running),)), {})
