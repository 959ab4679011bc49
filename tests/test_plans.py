"""Physical plans: no pairwise joins, no window over a whole series in one task, pruned scans."""

from __future__ import annotations

import re

import pytest

from fluxlake.catalog import bindings
from fluxlake.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
LEARNERS = {"gbt_grid", "gbt_predict", "seq_regressor", "full_history_predictions", "latest_forecast"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LEARNERS))
def test_no_pairwise_join_and_no_unbounded_single_task(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    for below in re.findall(r"Exchange SinglePartition.*\n((?:.*\n){1,4})", plan):
        # Only partial aggregates, limits and tables of one row per long bucket may meet in one task.
        assert re.search(r"partial_|LocalLimit|LocalTableScan|TakeOrdered|Aggregate\(keys=\[(_bucket|_chunk)", below), below


def test_series_windows_are_partitioned_by_chunk(spark):
    plan = plan_of(QUERIES["rolling_stats"](spark, SF))
    windows = [line for line in plan.splitlines() if "Window [" in line and "avg(" in line]
    assert windows and all("_chunk" in line for line in windows)
    assert plan.count("Exchange hashpartitioning(_chunk") == 1


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(bindings.truth(spark, SF).select("ts"))
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "props" not in schema and "event_id" not in schema
    assert "PushedFilters: [IsNotNull(user_id)" in plan or "EqualTo(event_type,signup)" in plan


def test_resample_aggregates_before_the_shuffle(spark):
    from datetime import timedelta

    from pyspark.sql import functions as F

    from fluxlake.functions.times import bin_number

    binned = bindings.events(spark, SF).groupBy(bin_number("ts", timedelta(minutes=5)).alias("bin")).agg(F.avg("value"))
    plan = plan_of(binned)
    assert "partial_avg" in plan and plan.count("Exchange hashpartitioning") == 1
