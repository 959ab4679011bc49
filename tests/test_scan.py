"""The scan in levels against a plain loop, and the operators behind it with few elements a level."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fluxlake.operators import scan, windows


@pytest.mark.parametrize("fan_out", [2, 3, 512])
def test_carries_equal_a_loop(spark, fan_out):
    rng = random.Random(fan_out)
    rows = [(key, at, rng.choice([0.0, 1.0, 0.5]), float(rng.randint(-5, 5)), 1.0, 1.0) for key in ("a", "b", None) for at in rng.sample(range(-40, 60), 45)]
    frame = spark.createDataFrame(rows, "key string, at bigint, a double, b double, one double, n double")
    got = scan.carried(frame, {"x": ("a", "b"), "count": ("one", "n")}, "at", ["key"], fan_out).collect()
    want = {}
    for key in ("a", "b", None):
        x = count = 0.0
        for _, at, a, b, _, _ in sorted(r for r in rows if r[0] == key):
            want[key, at] = x, count
            x, count = a * x + b, count + 1
    assert len(got) == len(rows)
    for r in got:
        assert (r.x, r["count"]) == pytest.approx(want[r.key, r.at])


def test_many_keys_are_scanned_task_by_task(spark, monkeypatch):
    plans, stage = [], scan.stage

    def noted(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stage(rows, name)

    monkeypatch.setattr(scan, "stage", noted)
    frame = spark.range(3000).selectExpr("id DIV 3 AS key", "(id % 3) * 400 AS at", "1.0D AS one", "CAST(id AS double) AS n").repartition(7)
    got = {(r.key, r.at): r.before for r in scan.carried(frame, {"before": ("one", "n")}, "at", ["key"]).collect()}
    assert got == {(k, at * 400): float(sum(range(3 * k, 3 * k + at))) for k in range(1000) for at in range(3)}
    # A call of Python per key took most of the time.
    assert plans and not any("FlatMapGroups" in plan for plan in plans)


def test_carries_of_nothing(spark):
    frame = spark.createDataFrame([], "at bigint, a double, b double")
    assert scan.carried(frame, {"x": ("a", "b")}, "at").collect() == []


@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_runs_over_many_chunks(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(scan.carried, "__defaults__", ((), 2))
    rng = random.Random(chunk_rows)
    values = []
    while len(values) < 90:
        values += [rng.choice([None, 1.0])] * rng.randint(1, 14)
    frame = spark.createDataFrame(list(enumerate(values)), "row_idx bigint, x double")
    got = sorted((r.first_idx, r.last_idx, r.run_length) for r in windows.null_runs(frame, "x", chunk_rows=chunk_rows).collect())
    want, first = [], None
    for i, value in enumerate([*values, 1.0]):
        if value is None and first is None:
            first = i
        elif value is not None and first is not None:
            want.append((first, i - 1, i - first))
            first = None
    assert got == want


def test_average_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "EMA_BLOCK", 4)
    monkeypatch.setattr(scan.carried, "__defaults__", ((), 2))
    values = [float(i * 7 % 11) for i in range(70)]
    frame = spark.createDataFrame(list(enumerate(values)), "row_idx bigint, x double")
    got = [r.p_ema_6 for r in windows.ema_features(frame, "x", [6], "p").orderBy("row_idx").collect()]
    e, want = values[0], []
    for value in values:
        e = 2 / 7 * value + 5 / 7 * e
        want.append(e)
    assert got == pytest.approx(want)
