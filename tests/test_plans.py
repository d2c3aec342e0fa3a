"""What the planner makes of the operators: pruning, shuffles, joins."""

from __future__ import annotations

import re

import pytest

from plumbscore.catalog import QUERIES
from plumbscore.catalog.curves import scored_lines
from plumbscore.catalog.deployment import scored_events
from plumbscore.operators.curves import binary_counts, binary_summary, threshold_curve
from plumbscore.operators.features import hash_split
from plumbscore.plans.deployment import window_metrics


def plan(df) -> str:
    """The plan that ran, where adaptive execution has finished with it."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize(
    "name",
    [
        "binary_metrics_sliced", "binary_metrics_by_many_keys", "silhouette_by_key", "canary", "champion", "ab_compare",
        "bandit_splits", "nearest_metric", "nearest_metric_by_user", "select_models", "metric_documents", "label_index",
    ],
)
def test_no_cross_joins(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counts_read_few_columns_and_aggregate_before_the_shuffle(spark, folder):
    text = plan(binary_counts(scored_lines(spark, folder)))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate\(.*partial_count", text)


def test_keyed_summary_shuffles_its_counts_once(spark, folder):
    text = plan(window_metrics(scored_events(spark, folder), "ts", "1 day"))
    assert text.count("Exchange ") == 1 and "SinglePartition" not in text


def test_a_sliced_curve_orders_nothing_in_one_task(spark, folder):
    curve = threshold_curve(binary_counts(scored_lines(spark, folder, "l_extendedprice")), rows_per_slice=500)
    text = plan(binary_summary(curve))
    assert len(re.findall(r"Exchange hashpartitioning\(__slice", text)) == 1
    # The one-task step left is the last aggregate over partial results.
    single = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    assert len(single) == 1


def test_a_hash_split_does_not_shuffle(spark, folder):
    for part in hash_split(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderkey"):
        assert "Exchange" not in plan(part)
