"""Spool, parse, dispatch, reject and sink queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.inputs import (
    SPOOL_RULE, as_messages, event_lines, file_type, land_spool, query, record_type_of_event, table,
)
from millrace.functions import coerce, normalise, wire
from millrace.operators import numbering, records
from millrace.sinks import chunks, outputs
from millrace.sources import queue, shapes, slices, spool
from millrace.staging import Staging

CUSTOMER = records.RecordSchema((
    ("c_custkey", "int64"), ("c_name", "string"), ("c_nationkey", "int32"),
    ("c_acctbal", "float64"), ("c_mktsegment", "string"),
))


@query
def spool_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spool files to typed records: route by name, parse by type, count good and rejected lines."""
    path = land_spool(spark, sf_dir, Staging(spark).folder("spool"))
    lines = spool.scan_lines(spark, path, SPOOL_RULE)
    parsed = records.merge_same_layout(records.parse_by_type(lines, file_type()))
    reason = F.coalesce("reject_reason", F.lit("ok"))
    return parsed.groupBy("record_type", reason.alias("reject_reason")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("age").alias("sum_age"),
        F.count_if(F.col("age") == 0).alias("n_zero_age"),
    )


@query
def spool_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as delimited text and read back as typed rows."""
    path = Staging(spark).folder("spool")
    customers = table(spark, sf_dir, "customer")
    spool.write_spool(customers.select(records.record_line(CUSTOMER.names).alias("value")), path, "customer")
    parsed = records.parse_lines(spool.scan_lines(spark, path), CUSTOMER)
    return records.split_rejects(parsed)[0].select(*CUSTOMER.names)


@query
def file_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that fit a rule go one way, the others are skipped."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("file_name"))
    routed = F.when(F.col("matched"), "match").otherwise("skip")
    return spool.with_route(names, "^src1[[:digit:]]+").groupBy("file_name", routed.alias("routed")).agg(
        F.count(F.lit(1)).alias("n_files"))


@query
def spool_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of spool files are dense from 0 in every file."""
    staging = Staging(spark)
    path = land_spool(spark, sf_dir, staging.folder("spool"))
    numbered = spool.number_lines(spool.scan_lines(spark, path, SPOOL_RULE), staging)
    per_file = numbered.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line_num").alias("low"),
        F.max("line_num").alias("high"),
        F.sum(F.col("line_num").cast("bigint")).alias("total"),
    )
    dense = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (
        F.col("total") * 2 == F.col("n") * (F.col("n") - 1))
    return per_file.groupBy(file_type().alias("record_type")).agg(
        F.sum("n").alias("n_lines"), F.bool_and(dense).alias("dense")
    )


@query
def line_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of documents held whole in a row."""
    documents = table(spark, sf_dir, "documents")
    lines = spool.explode_lines(documents, F.col("source"), "text", "doc_id")
    return lines.select("doc_id", "file_name", "line_num", "value")


@query
def skip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the spool files that no rule wants, by name prefix."""
    path = land_spool(spark, sf_dir, Staging(spark).folder("spool"))
    skipped = outputs.skip_manifest(spark, path, SPOOL_RULE)
    return skipped.groupBy(file_type().alias("prefix")).agg(F.sum("length").alias("n_bytes"))


@query
def strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-arity parse of event lines."""
    parsed = records.parse_lines(event_lines(spark, sf_dir), records.PERSON)
    return parsed.select("event_id", "reject_reason", "name", "age", "sex")


@query
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per event type and reject reason."""
    parsed = records.parse_lines(event_lines(spark, sf_dir), records.PERSON)
    return records.reject_summary(parsed, "event_type")


@query
def record_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of record types parsed in one pass; types nobody registered are rejected."""
    lines = event_lines(spark, sf_dir)
    parsed = records.merge_same_layout(records.parse_by_type(lines, record_type_of_event()))
    return parsed.select("event_id", "record_type", "reject_reason", "name", "age", "sex")


@query
def zero_default_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that cannot be read become the zero value of their type."""
    user = F.col("user_id").cast("string")
    whole = (
        F.when(F.col("event_id") % 8 == 0, user)
        .when(F.col("event_id") % 8 == 1, F.concat(F.lit(" "), user))
        .when(F.col("event_id") % 8 == 2, F.concat(user, F.lit("x")))
        .when(F.col("event_id") % 8 == 3, "")
        .when(F.col("event_id") % 8 == 4, (F.col("event_id") * 1000003 + 4294967296).cast("string"))
        .when(F.col("event_id") % 8 == 5, F.concat(F.lit("+"), user))
        .when(F.col("event_id") % 8 == 6, F.concat(F.lit("-"), user))
        .otherwise("99999999999999999999")
    )
    number = (
        F.when(F.col("event_id") % 6 == 0, F.col("value").cast("string"))
        .when(F.col("event_id") % 6 == 1, "1e400")
        .when(F.col("event_id") % 6 == 2, ".5")
        .when(F.col("event_id") % 6 == 3, "5.")
        .when(F.col("event_id") % 6 == 4, "1.5d")
        .otherwise(" 2.5")
    )
    flag = F.element_at(
        F.array(*[F.lit(w) for w in ("true", "T", "yes", "0", "TRUE")]), (F.col("event_id") % 5 + 1).cast("int")
    )
    cells = table(spark, sf_dir, "events").select(
        "event_id", whole.alias("whole"), number.alias("number"), flag.alias("flag"))
    return cells.select(
        "event_id",
        coerce.zero_default(F.col("whole"), "int64").alias("as_int64"),
        coerce.zero_default(F.col("whole"), "int32").alias("as_int32"),
        coerce.zero_default(F.col("whole"), "uint8").alias("as_uint8"),
        coerce.zero_default(F.col("number"), "float64").alias("as_float64"),
        coerce.zero_default(F.col("flag"), "bool").alias("as_bool"),
    )


@query
def record_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as delimited lines in a configured column order."""
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"]
    return orders.select("o_orderkey", records.record_line(columns, "|").alias("line"))


@query
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to payload bytes and back."""
    columns = ["event_id", "user_id", "event_type", "value"]
    events = table(spark, sf_dir, "events").select(*columns)
    sent = events.select(records.to_payload(columns).alias("payload"))
    return sent.select(records.from_payload(F.col("payload"), events.schema).alias("r")).select("r.*")


EVENT_PAYLOAD = T.StructType([T.StructField(n, k) for n, k in (
    ("event_id", T.LongType()), ("user_id", T.LongType()), ("value", T.DoubleType()), ("event_type", T.StringType()))])
KEYS_ONLY = T.StructType([f for f in EVENT_PAYLOAD.fields if f.name != "value"])


def _payload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_PAYLOAD.fields])


@query
def binary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as protobuf and MessagePack bytes and back; the bytes of all but the float, as hex digits."""
    events = _payload_events(spark, sf_dir)
    sent = events.select(
        wire.to_protobuf_bytes(EVENT_PAYLOAD).alias("p"), wire.to_msgpack_bytes(EVENT_PAYLOAD).alias("m"),
        F.hex(wire.to_protobuf_bytes(KEYS_ONLY)).alias("protobuf_hex"), F.hex(wire.to_msgpack_bytes(KEYS_ONLY)).alias("msgpack_hex"))
    read = sent.select(
        wire.from_protobuf_bytes(F.col("p"), EVENT_PAYLOAD).alias("p"), wire.from_msgpack_bytes(F.col("m"), EVENT_PAYLOAD).alias("m"),
        "protobuf_hex", "msgpack_hex")
    return read.select("p.record.*", F.col("m.record.value").alias("packed_value"), F.col("m.record.event_id").alias("packed_id"),
                       "protobuf_hex", "msgpack_hex")


@query
def payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third payload loses its last byte, every third gets a byte that starts no field: the reject classes."""
    events = _payload_events(spark, sf_dir)
    whole, at = wire.to_protobuf_bytes(EVENT_PAYLOAD), F.col("event_id") % 3
    harmed = F.when(at == 0, F.substring("p", F.lit(1), F.octet_length("p") - 1)).when(
        at == 1, F.concat("p", F.lit(b"\x07"))).otherwise(F.col("p"))
    read = events.select("event_id", whole.alias("p")).select("event_id", wire.from_protobuf_bytes(harmed, EVENT_PAYLOAD).alias("r"))
    return read.select("event_id", F.col("r.error").alias("error"), F.col("r.record.event_type").alias("event_type"))


@query
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines written as dead-letter files and read back, with their class."""
    path = Staging(spark).folder("fail")
    lines = event_lines(spark, sf_dir)
    _, rejected = records.split_rejects(records.parse_lines(lines, records.PERSON))
    unsent = F.when(F.col("event_id") % 2 == 0, outputs.PARSE).otherwise(outputs.SEND)
    outputs.write_dead_letters(outputs.dead_letters(rejected, "value", unsent), path, "c1")
    return outputs.read_dead_letters(spark, path)


@query
def rolled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines with their event as origin, in files of three letters or 50,000 seconds; read back per file."""
    staging = Staging(spark)
    clocks = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("clock"))
    _, rejected = records.split_rejects(records.parse_lines(event_lines(spark, sf_dir), records.PERSON))
    # files that compress well look small to the planner, which would send all clocks through the driver
    letters = outputs.dead_letters(rejected.join(clocks.hint("merge"), "event_id"), "value", origin=["event_type", "event_id", "clock"])
    rolled = outputs.roll_letters(letters, ["event_type"], "clock", "event_id", 3, 50_000, staging)
    path = staging.folder("letters")
    outputs.write_rolled_letters(rolled, path, ["event_type"], "event_id")
    kinds = T.StructType.fromDDL("fail_class string, value string, event_id bigint, clock bigint, event_type string, roll bigint")
    return outputs.read_rolled_letters(spark, path, kinds, ["event_type"]).groupBy("event_type", "roll").agg(
        F.count(F.lit(1)).alias("n_letters"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"),
        F.sum(F.length("value")).alias("n_chars"))


@query
def roll_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and files per roll interval of the dead-letter output."""
    return outputs.roll_buckets(table(spark, sf_dir, "events"), F.col("ts"), roll_rows=2)


@query
def commit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in commit chunks of 500 rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    chunked = numbering.chunk_number(orders, ["o_orderkey"], 500)
    return chunked.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
    )


def _picky_receiver(run: str, chunk: int, rows: pa.Table) -> list[str | None]:
    """Refuses dear orders, and breaks down over a chunk with certain keys."""
    for key in rows.column("o_orderkey").to_pylist():
        if key % 3001 == 0:
            raise ValueError(f"order {key}")
    return ["too dear" if price > 250_000 else None for price in rows.column("o_totalprice").to_pylist()]


@query
def chunk_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sent in chunks of 500 with a commit each: what became of every order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = Staging(spark).folder("sent")
    chunks.write_chunks(orders, path, "orders", ["o_orderkey"], 500, _picky_receiver, "go_on")
    return chunks.read_outcomes(spark, path, orders.schema).select("o_orderkey", "chunk", "state", "error")


@query
def sequence_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense sequence over customers, starting at 10 in steps of 5."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return numbering.assign_sequence(
        customers, [F.col("c_acctbal").desc(), "c_custkey"], start=10, step=5, out="seq")


@query
def kafka_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue messages with dense offsets per topic partition."""
    sent = as_messages(table(spark, sf_dir, "events"), 4).withColumn("event_id", F.col("offset"))
    numbered = queue.with_dense_offsets(sent, ["ts", "event_id"])
    return numbered.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "topic", "partition", "offset",
    )


@query
def topic_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (topic, partition) pairs that occur."""
    return queue.topic_partitions(as_messages(table(spark, sf_dir, "events"), 64))


@query
def rect_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square rectangle message per event, sides counted up from 2000."""
    side = F.col("event_id") + shapes.FIRST_SIDE
    return shapes.rectangles(table(spark, sf_dir, "events"), side, side, "event_id")


@query
def rect_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of rectangles taken from line items, added up by part."""
    sides = shapes.rectangles(
        table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_linenumber"), "l_partkey")
    areas = sides.select("l_partkey", shapes.area(F.col("length"), F.col("height")).alias("area"))
    return areas.groupBy("l_partkey").agg(F.sum("area").alias("total_area"))


@query
def describe_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the orders table with type and longest value."""
    return normalise.describe_columns(table(spark, sf_dir, "orders"))


@query
def number_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals of a database table as doubles and big integers."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("decimal(18,0)"),
        F.col("o_totalprice").cast("decimal(12,2)"),
        F.col("o_custkey").cast("int"),
        (F.col("o_orderstatus") == "F").alias("finished"),
    )
    return normalise.booleans_to_bits(normalise.normalise_numbers(orders))


@query
def empty_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty strings as NULL."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"),
        "c_mktsegment",
    )
    return normalise.empty_to_null(customers)


@query
def pick_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured columns of a table in configured order."""
    return normalise.pick(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"])


@query
def row_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells a table from a copy that lost a status and doubled another."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    copy = orders.where("o_orderstatus <> 'P'").union(orders.where("o_orderstatus = 'F'"))
    odd = normalise.odd_rows(orders, copy)
    return odd.groupBy("o_orderstatus").agg(F.sum("surplus").alias("surplus"), F.count(F.lit(1)).alias("n_rows"))


@query
def balanced_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates for a read in 16 slices, where one key holds a third of the rows and many have none.

    How many rows the slices read together, how many rows some slice reads, and whether the largest
    slice has less than a fifth more rows than the smallest.
    """
    order = F.col("l_orderkey")
    key = F.when(order % 3 == 0, 7).when(order % 11 == 0, None).otherwise(F.col("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select(key.cast("bigint").alias("part"), order.alias("line_order"))
    predicates = slices.slice_predicates(lines, "part", "line_order", 16)
    some = " OR ".join(f"({p})" for p in predicates)  # counted beside the slices, in the same pass
    sizes = slices.slice_sizes(lines, [*predicates, some])
    of_slice = F.col("slice") < len(predicates)
    return sizes.agg(
        F.count_if(of_slice).alias("n_slices"),
        F.sum(F.when(of_slice, F.col("n_rows"))).alias("n_read"),
        F.max(F.when(~of_slice, F.col("n_rows"))).alias("n_reached"),
        (F.max(F.when(of_slice, F.col("n_rows"))) < F.min(F.when(of_slice, F.col("n_rows"))) * 1.2).alias("even"))
