"""What the plans of all registered queries must and must not contain."""

import re

import pytest

from shuffleworks import session
from tests.test_queries import QUERIES

# The report over the whole table numbers its last 15 rows in one task.
ONE_TASK_WINDOWS = {"top_lines"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_windows_in_one_task(spark, sf_dir, plan, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if "Window [" in line and name not in ONE_TASK_WINDOWS:
            assert "SinglePartition" not in "\n".join(lines[at : at + 6])


@pytest.mark.parametrize(
    "name, columns",
    [
        ("word_count", "text"),
        ("totals_by_composite_key", "l_quantity,l_returnflag,l_linestatus"),
        ("inventory_and_sales", "l_partkey,l_quantity,l_extendedprice"),
        ("small_returns", "l_orderkey,l_linenumber,l_quantity,l_returnflag,l_shipdate"),
        ("top_orders_per_customer", "o_orderkey,o_custkey,o_totalprice"),
        ("error_lines", "o_orderkey"),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, plan, name, columns):
    assert f"FileScan parquet [{columns}]" in re.sub(r"#\d+L?", "", plan(QUERIES[name](spark, sf_dir)))


def test_filters_reach_the_scan(spark, sf_dir, plan):
    text = plan(QUERIES["small_returns"](spark, sf_dir))
    assert "LessThan(l_quantity,10.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert "Exchange" not in text


def test_sizing_grows_with_the_input():
    small, large = session.sizing(10**9, 100), session.sizing(100 * 10**12, 8000)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert large["spark.sql.shuffle.partitions"] == str(100 * 10**12 // (200 * 1024 * 1024))
    assert int(large["spark.sql.files.maxPartitionBytes"]) > int(small["spark.sql.files.maxPartitionBytes"])


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get(session.CHECKPOINT_CONF, None)
    if configured:
        assert session.shared_dir(spark) == configured.rstrip("/")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
