"""Plans: what reaches the scan, how often rows are shuffled."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


def plan(spark, name):
    return entry.queries()[name](spark, str(SF))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "name,pushed,columns",
    [
        ("d2_get_as_of", "LessThan(event_id,5000)", "user_id:bigint,value:double"),
        ("r1_range", "GreaterThanOrEqual(o_custkey,100)", "o_orderkey:bigint,o_custkey:bigint"),
        ("h11_truncate", "LessThan(event_id,5000)", "event_id:bigint,user_id:bigint,value:double"),
        ("x5_changed_keys", "GreaterThanOrEqual(event_id,1000)", "event_id:bigint,user_id:bigint"),
        ("i5_union", "In(event_type", None),
        ("r4_prefix", "StringStartsWith(p_name,s)", "p_partkey:bigint,p_name:string"),
        ("p5_found", "IsNotNull(k)", "k:bigint,tx_num:bigint"),
        ("pool12_not_final", "GreaterThan(block_added,21000100)", "arrival_id:bigint,block_added:bigint"),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, columns):
    text = plan(spark, name)
    if name != "i5_union":
        assert pushed in text, text
    assert "PushedFilters" in text
    if columns:
        assert all(f"{c}" in text.split("ReadSchema")[1].split("\n")[0] for c in columns.split(",")), text


@pytest.mark.parametrize("name,most", [("d1_get_latest", 1), ("d2_get_as_of", 1), ("h0_add_prev", 1), ("h4_history_range", 2), ("c3_collate_domain", 1), ("pool6_one_per_slot", 1), ("pool11_capacity", 1), ("e7_oldest_appeared", 1), ("p1_found", 1), ("p2_found", 4)])
def test_shuffles(spark, name, most):
    text = plan(spark, name)
    tree = text.split("\n\n")[0]
    assert sum("Exchange (" in line and "Broadcast" not in line for line in tree.splitlines()) <= most, tree


@pytest.mark.parametrize("name", ["r2_range_ascend_limit", "r3_range_descend_limit", "i11_page", "z5_top_words", "pool5_order", "h3_walk_as_of"])
def test_limits_keep_few_rows(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_capacity_limits_before_the_shuffle(spark):
    tree = plan(spark, "pool11_capacity").split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2, tree
