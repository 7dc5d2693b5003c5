"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import query, table
from millrace.functions import days, normalise, text


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", days.date_to_int(F.col("o_orderdate")).alias("day"))


@query
def check_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days among order days and wrong integers."""
    key, day = F.col("o_orderkey"), F.col("day")
    number = (
        F.when(key % 5 == 1, 20230229).when(key % 5 == 2, 20241301).when(key % 5 == 3, 0)
        .when(key % 5 == 4, F.floor(day / 100) * 100 + 31).otherwise(day).cast("int")
    )
    numbers = _order_days(spark, sf_dir).select("o_orderkey", number.alias("day"))
    return numbers.withColumn("valid", days.check_day(F.col("day")))


@query
def previous_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day before each order day."""
    return _order_days(spark, sf_dir).withColumn("previous", days.previous_day(F.col("day")))


@query
def n_days_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day some days before each event, in the home zone."""
    events = table(spark, sf_dir, "events")
    n = (F.col("event_id") % 40).cast("int")
    return events.select("event_id", days.n_days_before(F.col("ts"), n).alias("day"))


@query
def cst_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times in the two home-zone clock layouts."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        days.home_clock(F.col("ts")).alias("clock"),
        days.day_start_clock(F.col("ts")).alias("day_start"),
    )


@query
def unix_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as Unix seconds."""
    return table(spark, sf_dir, "events").select(
        "event_id", days.unix_seconds(F.col("ts")).alias("seconds"))


@query
def tz_localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall-clock times read in one zone and shown in another."""
    events = table(spark, sf_dir, "events")
    instant = normalise.to_instant(F.col("ts"), "-03:00")
    return events.select(
        "event_id",
        normalise.to_wall_clock(F.col("ts"), "+08:00").alias("home"),
        normalise.to_wall_clock(instant, "UTC").alias("utc"),
    )


@query
def interval_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals made from line items, as whole months and nanoseconds."""
    items = table(spark, sf_dir, "lineitem")
    years = F.col("l_linenumber") - 3.5
    hours = (F.col("l_quantity") - 20) / 4
    return items.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        normalise.interval_months(normalise.number_to_months_interval(years, "YEAR")).alias("months"),
        normalise.interval_nanos(normalise.number_to_seconds_interval(hours, "HOUR")).alias("nanos"),
    )


# What every page URL gets appended, so that both separators, a blank, an empty piece, a bad escape
# and a repeated key occur.
EXTRA_QUERY = ";seen=1+2&&bad=%zz&ref=y;only"


def _page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat(text.query_part(F.col("url")), F.lit(EXTRA_QUERY)).alias("q"))


@query
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value pairs of page query strings, in order."""
    pairs = _page_queries(spark, sf_dir).select(
        "page_id", F.posexplode(text.query_pairs(F.col("q"))).alias("position", "pair"))
    return pairs.select("page_id", "position", "pair.key", "pair.value")


@query
def url_query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of each key of page query strings."""
    values = _page_queries(spark, sf_dir).select(
        "page_id", F.explode(text.query_values(F.col("q"))).alias("key", "values"))
    return values.select("page_id", "key", F.concat_ws("|", "values").alias("values"))


@query
def url_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents escaped for a query string and back."""
    documents = table(spark, sf_dir, "documents")
    escaped = documents.select("doc_id", "text", text.query_escape(F.col("text")).alias("escaped"))
    return escaped.select(
        "doc_id",
        F.length("escaped").alias("escaped_chars"),
        F.md5("escaped").alias("escaped_md5"),
        (text.query_unescape(F.col("escaped")) == F.col("text")).alias("round_trip"),
    )


@query
def split_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs cut at the last slash, and at the last question mark."""
    pages = table(spark, sf_dir, "pages")
    slash, mark = text.split_right(F.col("url"), "/"), text.split_right(F.col("url"), "?")
    return pages.select(
        "page_id",
        slash["before"].alias("parent"), slash["after"].alias("leaf"),
        mark["before"].alias("address"), mark["after"].alias("params"),
    )


@query
def kv_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-parameter strings; unassigned entries are left out."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    line = text.kv_string({"resultCode": F.col("o_custkey"), "priority": price, "status": F.col("o_orderstatus")})
    return orders.select("o_orderkey", line.alias("outcome"))


@query
def string_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL string functions."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.substr("c_name", F.lit(3)).alias("tail"),
        F.rpad("c_mktsegment", 12, "*").alias("padded"),
        F.concat("c_name", F.lit("-"), "c_mktsegment").alias("joined"),
        F.col("c_custkey").cast("string").alias("key_text"),
    )


@query
def token_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blocked tokens."""
    documents = table(spark, sf_dir, "documents")
    blocked = [*text.BLOCKED_TOKENS, "the", "der", "une"]
    return documents.select("doc_id", text.tokens_allowed(F.col("text"), blocked).alias("allowed"))


@query
def line_clean_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blank and comment lines, joined; a blocked token rejects the document."""
    documents = table(spark, sf_dir, "documents")
    outcome = text.join_clean_lines(F.col("text"), [*text.BLOCKED_TOKENS, "der", "une"])
    return documents.select("doc_id", outcome.alias("o")).select(
        "doc_id", "o.accepted", F.md5("o.joined").alias("joined_md5"))
