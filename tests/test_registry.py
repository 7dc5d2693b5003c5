"""Every registered query against its SQL, and the plans of the ones that matter at scale."""

import contextlib
import io
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

QUERIES, ORACLES = entry.REGISTRY, entry.ORACLES  # the queries of the llm subpackage have tests of their own


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, data_dir, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], data_dir) == ""


def plan(frame):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
ONE_ROW = {"balanced_slices", "sum_over_union", "rows_affected", "describe_schema"}  # global aggregates with a map-side part


@pytest.mark.parametrize("name", BATCH)
def test_no_plan_gathers_rows(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert name in ONE_ROW or "SinglePartition" not in text
    assert "\nWindow" not in text


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    text = plan(QUERIES["bind_params"](spark, data_dir))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_big_sides_are_not_broadcast(spark, data_dir):
    """Without room for a broadcast the same queries run on plain shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("cursor_delete", "cursor_upsert", "route_to_worker", "override_expand"):
            text = plan(QUERIES[name](spark, data_dir))
            assert "BroadcastExchange" not in text and "SortMergeJoin" in text, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
