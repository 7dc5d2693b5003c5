"""SQL job queries."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import query, table
from millrace.plans.jobs import (
    CallBlock, CommonBlock, CursorBlock, Delete, Insert, Job, LoopBlock, Param, Procedure, Running, Select, Update, bind, execute,
    run_jobs, run_sql,
)
from millrace.plans.tables import TableStore
from millrace.staging import Staging


def _store(spark: SparkSession, sf_dir: str, *attached: str, **fresh: DataFrame) -> TableStore:
    """A store over the given driver tables, with new tables of its own."""
    store = TableStore(spark, Staging(spark).folder("store"))
    for name in attached:
        store.attach(name, f"{sf_dir}/{name}.parquet")
    store.publish(fresh)
    return store


@query
def bind_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with bound values and a substituted table name."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("job_orders")
    sql, arguments = bind(
        "select o_orderkey, o_totalprice from ${source} "
        "where o_orderstatus = #{Status} and o_totalprice > #{floor}",
        {"source": "job_orders", "status": "F", "floor": 150000},
    )
    return spark.sql(sql, args=arguments)


@query
def select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar read into a variable that a later statement uses."""
    rich = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").where("false")
    store = _store(spark, sf_dir, "orders", rich_orders=rich)
    procedure = Procedure("p_rich", (
        CommonBlock(1, (
            Select(1, "select floor(avg(o_totalprice)) from orders where o_orderstatus = #{status}",
                   (Param("mean_price", "Int"),)),
            Insert(2, "rich_orders",
                   "select o_orderkey, o_totalprice from orders where o_totalprice > #{mean_price}"),
        )),
    ), in_params=(Param("status", "string"),), out_params=(Param("mean_price", "int"),))
    execute(spark, store, procedure, {"status": "F"})
    return store.read("rich_orders")


@query
def common_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete all, then insert from a query, committed together."""
    copy = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    store = _store(spark, sf_dir, "orders", copy_orders=copy)
    procedure = Procedure("p_copy", (
        CommonBlock(1, (
            Insert(2, "copy_orders", "select o_orderkey, o_custkey, o_orderpriority from orders "
                                     "where o_orderstatus = 'O'"),
            Delete(1, "copy_orders"),
            Update(3, "copy_orders", {"o_custkey": "o_custkey * 2"}, "o_orderpriority = '1-URGENT'"),
        )),
    ))
    execute(spark, store, procedure, {})
    return store.read("copy_orders")


@query
def loop_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements once per loop value, committed every two values."""
    tally = table(spark, sf_dir, "customer").select(
        F.lit(0).alias("quarter"), F.col("c_custkey").alias("n")).where("false")
    store = _store(spark, sf_dir, "customer", tally=tally)
    procedure = Procedure("p_loop", (
        LoopBlock(1, Param("quarter", "Int"), (1, 2, 3, 4), (
            Insert(1, "tally", "select #{quarter}, count(*) from customer where c_nationkey % 4 + 1 = #{quarter}"),
        ), commit_every=2),
    ))
    execute(spark, store, procedure, {})
    return store.read("tally")


@query
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a job list: outcome, out parameters and rows written per run."""
    copy = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").where("false")
    store = _store(spark, sf_dir, "orders", some_orders=copy)
    copy_status = Procedure("p_copy_status", (
        CommonBlock(1, (
            Delete(1, "some_orders"),
            Insert(2, "some_orders", "select o_orderkey, o_totalprice from orders where o_orderstatus = #{status}"),
            Select(3, "select count(*) from some_orders", (Param("resultCode", "int"),)),
        )),
    ), (Param("status", "string"),), (Param("resultCode", "int"),))
    missing = Procedure("p_missing", (CommonBlock(1, (Delete(1, "orders", "o_custkey = #{nobody}"),)),))
    log = run_jobs(spark, store, [copy_status, missing],
                   [Job("p_copy_status", "F"), Job("p_missing"), Job("p_copy_status", "P")])
    return log.select("procedure", "in_params", "out_params", "result_code", "result_info",
                      F.col("rows_written")["some_orders"].alias("n_written"))


@query
def cursor_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take the status and number of their latest large order; the others stay as they are."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("status"),
        F.col("c_nationkey").cast("bigint").alias("ticket"),
    )
    store = _store(spark, sf_dir, "orders", accounts=customers, listed=customers)
    procedure = Procedure("p_accounts", (
        CursorBlock(
            1, "select o_custkey custkey, o_orderstatus status, o_orderkey ticket from orders "
               "where o_totalprice > 200000",
            "accounts", "replace", key=("custkey",), order_by=("ticket",), assign={"ticket": "ticket * 10"}),
        CommonBlock(2, (
            Delete(1, "listed"),
            Insert(2, "listed", "select custkey, status, ticket from accounts",
                   ("custkey", "status", "ticket")),
            Delete(3, "listed", "ticket % 7 = 0"),
        )),
    ))
    execute(spark, store, procedure, {})
    return store.read("listed")


@query
def table_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten commits that each move a fortieth of the orders, then an update; the table as a new reader sees it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    store = _store(spark, sf_dir, "orders", ledger=orders)
    procedure = Procedure("p_ledger", (
        LoopBlock(1, Param("share", "Int"), tuple(range(1, 11)), (
            Delete(1, "ledger", "o_orderkey % 40 = #{share}"),
            Insert(2, "ledger", "select o_orderkey, o_custkey, o_totalprice * 2 from orders where o_orderkey % 40 = #{share}"),
        )),
        CommonBlock(2, (Update(1, "ledger", {"price": "-price"}, "o_custkey % 11 = 0"),)),
    ))
    execute(spark, store, procedure, {})
    return TableStore(spark, store.root).read("ledger")


@query
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop that fails at its third value and is run again: every segment is counted once."""
    counts = table(spark, sf_dir, "customer").select(F.lit(0).alias("quarter"), F.col("c_custkey").alias("n"), F.lit(0).cast("bigint").alias("seen"))
    store = _store(spark, sf_dir, "customer", counts=counts.where("false"), gate=counts.where("false"))
    count = ("select #{quarter}, count(*), #{base} + if(#{quarter} = 3 and (select count(*) from gate) = 0, "
             "cast(raise_error('closed') as bigint), 0) from customer where c_nationkey % 4 + 1 = #{quarter}")
    procedure = Procedure("p_counts", (
        CommonBlock(1, (Select(1, "select count(*) from counts", (Param("base", "int"),)),)),
        LoopBlock(2, Param("quarter", "Int"), (1, 2, 3, 4), (Insert(1, "counts", count),)),
    ))
    jobs = [Job("p_counts", run_id="r1")]
    run_jobs(spark, store, [procedure], jobs)
    change = store.begin()
    change.insert("gate", store.read("counts"))
    store.commit(change)
    run_jobs(spark, store, [procedure], jobs)
    return store.read("counts")


@query
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor whose body depends on the row before: a balance per priority that never falls below zero."""
    book = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.lit(None).cast("decimal(20,2)").alias("was"), F.lit(None).cast("decimal(20,2)").alias("now"))
    store = _store(spark, sf_dir, "orders", book=book.where("false"))
    amount = "case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end"
    procedure = Procedure("p_balance", (
        CursorBlock(1, "select o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from orders", "book", "insert",
                    order_by=("o_orderkey",), within=("o_orderpriority",), running=Running("balance", add=amount, low="0", scale=2),
                    assign={"was": "balance_before", "now": "balance"}),
    ))
    execute(spark, store, procedure, {})
    return store.read("book")


@query
def carried_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clerk of the last large order before each order, as a cursor body that remembers it."""
    book = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("was"), F.col("o_orderpriority").alias("now"))
    store = _store(spark, sf_dir, "orders", book=book.where("false"))
    procedure = Procedure("p_carry", (
        CursorBlock(1, "select o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from orders", "book", "insert", order_by=("o_orderkey",),
                    within=("o_orderstatus",), running=Running("large", carry="if(o_totalprice > 300000, o_orderpriority, null)"),
                    assign={"was": "large_before", "now": "large"}),
    ))
    execute(spark, store, procedure, {})
    return store.read("book")


@query
def call_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure that another one calls gives it a mean, by segment status, for its own statements."""
    rich = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(0).cast("bigint").alias("mean"))
    store = _store(spark, sf_dir, "orders", rich=rich.where("false"))
    mean = Procedure("p_mean", (CommonBlock(1, (
        Select(1, "select floor(avg(o_totalprice)) from orders where o_orderstatus = #{status}", (Param("mean", "int"),)),)),),
        (Param("status", "string"),), (Param("mean", "int"),))
    outer = Procedure("p_outer", (
        CallBlock(1, "p_mean", ("wanted",)),
        CommonBlock(2, (Insert(1, "rich", "select o_orderkey, o_totalprice, #{mean} from orders "
                                         "where o_orderstatus = #{wanted} and o_totalprice > #{mean}"),)),
    ), (Param("wanted", "string"),))
    execute(spark, store, outer, {"wanted": "O"}, {p.name: p for p in (mean, outer)})
    return store.read("rich")


@query
def positional_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven typed values bound by position; marks in literals, names and comments are no placeholders."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("bound_orders")
    sql = ("select o_orderkey, ? as `tag?`, '?' as mark from bound_orders -- why?\n"
           "where o_orderstatus = ? and o_totalprice between ? and ? and o_orderdate >= ? and o_orderpriority <> ? and (? or o_custkey = 1)")
    values = [7, "F", Decimal("50000.50"), 250000.25, datetime.date(1993, 6, 1), "5-LOW", True]
    return run_sql(spark, sql, values).withColumnRenamed("tag?", "tag")
