"""Join, aggregate, allotment and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import (
    as_messages, deal_messages, event_lags, handled, nation_workers, query, rectangle_messages, square_column,
    square_of_payload, squares_or_stop, supplier_workers, table,
)
from millrace.operators import allot, batching, deal, lag, merge
from millrace.sources import queue
from millrace.staging import Staging


@query
def override_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as groups with suppliers as members, overridden by customers of some nations."""
    nations = table(spark, sf_dir, "nation")
    groups = nations.select(
        F.col("n_name").alias("group"), (F.col("n_nationkey") + 3).alias("cluster"),
        F.col("n_regionkey").cast("string").alias("login"),
    )
    clusters = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("cluster"), F.col("s_name").alias("member"))
    details = (
        table(spark, sf_dir, "customer")
        .where("c_mktsegment = 'MACHINERY'")
        .join(nations.where("n_nationkey % 2 = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("group"), F.col("c_name").alias("member"),
                F.col("c_mktsegment").alias("login"))
    )
    return merge.override_expand(groups, clusters, details)


@query
def cursor_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without those of a customer segment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cursor = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return merge.delete_matching(orders, cursor.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changes to orders: many per key, and some keys that are new."""
    fresh = F.when(F.col("l_linenumber") == 7, 1_000_000_000_000).otherwise(0)
    return table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(
        (F.col("l_orderkey") + fresh).alias("o_orderkey"),
        F.col("l_partkey").alias("o_custkey"),
        F.col("l_extendedprice").alias("o_totalprice"),
        "l_shipdate", "l_linenumber", "l_suppkey",
    )


CHANGE_ORDER = ["l_shipdate", "l_linenumber", "l_suppkey", "o_custkey", "o_totalprice"]


@query
def cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders replaced by their last line item."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return merge.upsert(orders, _order_changes(spark, sf_dir), ["o_orderkey"], CHANGE_ORDER)


@query
def cursor_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices set from their last line item."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return merge.update_matching(orders, _order_changes(spark, sf_dir), ["o_orderkey"], CHANGE_ORDER,
                                 {"o_totalprice": "o_totalprice"})


@query
def rows_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows the upsert replaces and inserts."""
    return merge.rows_affected(
        table(spark, sf_dir, "orders"), _order_changes(spark, sf_dir), ["o_orderkey"])


@query
def loop_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers once per loop value."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.loop_expand(customers, "quarter", [1, 2, 3, 4])


@query
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE with a condition."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.delete_where(orders, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE with a condition."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return merge.update_where(
        orders, {"o_orderstatus": F.lit("X"), "o_custkey": F.col("o_custkey") + 1},
        F.col("o_orderstatus") == "P")


@query
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT of a query into some columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey") + 1_000_000_000_000, "c_custkey")
    return merge.insert_rows(orders, rows, ["o_orderkey", "o_custkey"])


@query
def last_ok_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last handled offset per topic partition."""
    return lag.last_ok_offset(as_messages(table(spark, sf_dir, "events"), 64), handled())


@query
def lag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag per topic partition."""
    return event_lags(spark, sf_dir)


@query
def first_registrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user of each event type."""
    return lag.first_registrant(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query
def round_robin_allot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic partitions (one per user) over suppliers as workers."""
    events = table(spark, sf_dir, "events")
    items = events.select(
        F.col("event_type").alias("topic"), F.col("user_id").cast("int").alias("partition")).distinct()
    return allot.round_robin(items, supplier_workers(spark, sf_dir))


@query
def snake_allot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic partitions over nations as workers, largest lag first."""
    return allot.snake(event_lags(spark, sf_dir), nation_workers(spark, sf_dir))


def _current(spark: SparkSession, sf_dir: str, staging: Staging) -> DataFrame:
    items = queue.topic_partitions(as_messages(table(spark, sf_dir, "events"), 64))
    return allot.round_robin(items, nation_workers(spark, sf_dir), staging)


@query
def reallot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allotment after a lag check."""
    staging = Staging(spark)
    current = _current(spark, sf_dir, staging)
    changed, after = allot.rebalance(event_lags(spark, sf_dir), current, staging=staging)
    return after.withColumn("changed", F.lit(changed))


@query
def allot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a re-allotment adds and removes."""
    staging = Staging(spark)
    current = _current(spark, sf_dir, staging)
    after = allot.snake(event_lags(spark, sf_dir), nation_workers(spark, sf_dir), staging=staging)
    return allot.table_diff(current, after)


@query
def worker_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions and lag per worker."""
    staging = Staging(spark)
    lags = staging.keep(event_lags(spark, sf_dir), "lags")
    return lag.worker_load(allot.snake(lags, nation_workers(spark, sf_dir), staging=staging), lags)


@query
def route_to_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and their amounts by owning worker."""
    staging = Staging(spark)
    allotment = staging.keep(_current(spark, sf_dir, staging), "allotment")
    messages = as_messages(table(spark, sf_dir, "events"), 64)
    return allot.route_to_worker(messages, allotment).groupBy("worker").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query
def count_or_time_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 20 messages or 100,000 seconds per topic partition."""
    messages = as_messages(table(spark, sf_dir, "events"), 4)
    clocked = messages.withColumn("clock", F.unix_timestamp("ts"))
    return batching.batch_summary(batching.count_or_time(clocked, max_rows=20, max_wait=100_000))


@query
def partition_batch_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches, each handed to a function in one call; some calls fail, and some messages do."""
    messages = deal_messages(table(spark, sf_dir, "events"))
    clocked = messages.withColumn("clock", F.unix_timestamp("ts"))
    batched = batching.count_or_time(clocked, max_rows=20, max_wait=100_000).select("topic", "partition", "offset", "batch")
    group = ["topic", "partition", "batch"]
    dealt = deal.deal_runs(messages.join(batched, ["topic", "partition", "offset"]), squares_or_stop, group, ["ts", "offset"])
    return deal.run_summary(dealt, group)


@query
def union_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION and UNION ALL of two key columns."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    both = customers.union(suppliers)
    return both.distinct().select(F.lit("union").alias("mode"), "key").union(
        both.select(F.lit("union all").alias("mode"), "key"))


@query
def sum_over_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM and COUNT over a distinct UNION."""
    amounts = [
        table(spark, sf_dir, name).select(F.col(column).cast("decimal(18,2)").alias("a"))
        for name, column in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))
    ]
    return amounts[0].union(amounts[1]).distinct().agg(
        F.sum("a").cast("double").alias("total"), F.count(F.lit(1)).alias("n_rows"))


@query
def deal_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function on message payloads, some of which are damaged."""
    messages = rectangle_messages(table(spark, sf_dir, "events"))
    dealt = deal.deal_each(messages, square_of_payload)
    return dealt.select("event_id", "deal_tag", square_column().alias("square"))


@query
def deal_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function as a column expression."""
    messages = rectangle_messages(table(spark, sf_dir, "events"))
    text = F.col("value").cast("string")
    square = F.get_json_object(text, "$.Length").cast("bigint") * F.get_json_object(text, "$.Height").cast("bigint")
    answer = F.concat(F.lit('{"S":'), square.cast("string"), F.lit("}")).cast("binary")
    dealt = deal.deal_native(messages, answer)
    return dealt.select("event_id", "deal_tag", square_column().alias("square"))


@query
def deal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and totals per outcome."""
    messages = queue.undealt(as_messages(table(spark, sf_dir, "events"), 4))
    dealt = deal.deal_native(messages, F.when(handled(), F.col("value")))
    summary = deal.deal_summary(dealt, F.col("amount").cast("decimal(18,2)"))
    return summary.withColumn("total", F.col("total").cast("double"))
