"""Plans that would not survive a large table must not appear."""

import re

import pytest
from pyspark.sql import functions as F

from prepspark.catalog import QUERIES
from prepspark.operators import reduce

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
# counts its rows first: below two hundred there is one run, beyond there are many
SMALL_WINDOWS = {"cumulative_importance"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_operator(name, spark, sf):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not [f for f in FORBIDDEN if f in plan]
    if name in SMALL_WINDOWS:
        return
    assert not re.search(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_scan_reads_only_needed_columns(spark, sf):
    plan = plan_of(QUERIES["value_counts"](spark, sf))
    assert "l_shipdate" not in plan and "l_comment" not in plan


def test_split_needs_no_shuffle(spark, sf):
    plan = plan_of(QUERIES["split_stratified"](spark, sf))
    assert "Exchange" not in plan and "Window" not in plan


def test_many_importances_are_ranked_in_runs(spark):
    df = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("feature"), (F.lit(1.0) / (F.col("id") + 1)).alias("importance"))
    out = reduce.cumulative_importance(df)
    assert not re.search(r"Exchange SinglePartition", plan_of(out))
    rows = out.orderBy("rank").collect()
    run = 0.0
    for i, r in enumerate(rows):
        run += 1 / (i + 1)
        assert r["rank"] == i + 1 and r["feature"] == f"f{i}" and abs(r["cumulative"] - run) < 1e-9
