"""Distributed results against plain pandas on random series, for several chunk sizes."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxlake.functions import quantiles
from fluxlake.functions.quantiles import exact_quantiles
from fluxlake.operators import resample, scoring, windows
from fluxlake.operators.keyed import attach, attach_salted
from fluxlake.operators.asof import asof_nearest
from fluxlake.operators.clean import dedup_keep_first
from fluxlake.operators.position import over_chunks, with_row_index

START = datetime(2024, 1, 1)
STEP = timedelta(minutes=5)


def gappy(seed: int, n: int, share: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(size=n))
    x[rng.random(n) < 0.03] *= 40
    x[rng.random(n) < share] = np.nan
    for start in rng.integers(0, n, 4):
        x[start : start + rng.integers(1, 15)] = np.nan
    return x


def as_floats(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=float)


def same(got, want):
    np.testing.assert_allclose(as_floats(got), np.asarray(want, dtype=float), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("chunk_rows", [7, 16, 1000])
def test_chunked_despiking_equals_whole_series(series, column, chunk_rows):
    x = pd.Series(gappy(chunk_rows, 300, 0.1))
    median = x.rolling(12, center=True, min_periods=6).median()
    deviation = (x - median).abs()
    spike = deviation > 5 * (deviation.rolling(12, center=True, min_periods=6).median() * 1.4826)
    got = windows.flag_spikes(series([None if np.isnan(v) else v for v in x]), "x", chunk_rows=chunk_rows)
    assert spike.any()
    assert column(got, "is_spike") == spike.tolist()
    same(column(got, "rolling_median"), median)


@pytest.mark.parametrize("seed,chunk_rows,max_gap", [(1, 5, 6), (2, 16, 3), (3, 1000, 6), (4, 4, 1)])
def test_gap_filling_equals_the_unbounded_rule(series, column, seed, chunk_rows, max_gap):
    x = pd.Series(gappy(seed, 200, 0.3))
    x[:seed] = np.nan
    x[-3:] = np.nan
    missing = x.isna()
    length = missing.groupby((~missing).cumsum()).transform("sum")
    want = x.where(~(missing & (length <= max_gap)), x.interpolate(limit_direction="both"))
    df = series([None if np.isnan(v) else v for v in x])
    got = windows.interpolate_gaps(df, ["x"], max_gap, drop_unfilled=False, chunk_rows=chunk_rows)
    same(column(got, "x"), want)


@pytest.mark.parametrize("chunk_rows", [3, 40, 1000])
def test_chunked_rolling_equals_whole_series(series, column, chunk_rows):
    x = pd.Series(gappy(9, 250, 0.02))
    got = windows.rolling_stats(series([None if np.isnan(v) else v for v in x]), "x", [6, 24], "x", chunk_rows=chunk_rows)
    rolling = x.rolling(24)
    for stat, want in (("mean", rolling.mean()), ("std", rolling.std()), ("max", rolling.max()), ("min", rolling.min())):
        np.testing.assert_allclose(as_floats(column(got, f"x_roll_{stat}_24")), want, rtol=1e-7, atol=1e-9)


def test_ema_equals_the_recursion_across_chunks(spark):
    x = pd.Series(np.random.default_rng(5).normal(size=9000) + 3)
    df = spark.createDataFrame(pd.DataFrame({"row_idx": np.arange(9000), "x": x}))
    got = windows.ema_features(df, "x", [2, 6, 24, 400], "x").orderBy("row_idx").toPandas()
    for span in (2, 6, 24, 400):
        np.testing.assert_allclose(got[f"x_ema_{span}"], x.ewm(span=span, adjust=False).mean(), rtol=1e-11)


def test_ema_keeps_the_whole_history(spark):
    x = np.ones(6000)
    x[3071] = 1e45
    df = spark.createDataFrame(pd.DataFrame({"row_idx": np.arange(6000), "x": x}))
    got = windows.ema_features(df, "x", [24], "x").orderBy("row_idx").toPandas()
    np.testing.assert_allclose(got["x_ema_24"], pd.Series(x).ewm(span=24, adjust=False).mean(), rtol=1e-9)


@pytest.mark.parametrize("n", [1, 511, 512, 513, 300_000])
def test_ema_per_key_over_block_ends(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), F.col("id").alias("row_idx"))
    df = df.join(spark.createDataFrame(pd.DataFrame({"row_idx": np.arange(n), "x": x})), "row_idx")
    got = windows.ema_features(df, "x", [3000], "x", ["k"]).toPandas().sort_values(["k", "row_idx"])
    want = pd.Series(x).ewm(span=3000, adjust=False).mean()
    np.testing.assert_allclose(got["x_ema_3000"], np.concatenate([want, want]), rtol=1e-7, atol=1e-9)


def test_chunks_emit_every_row_once(spark):
    df = spark.range(1000).select(F.col("id").alias("row_idx"))
    got = over_chunks(df, lambda rows, w: rows.withColumn("n", F.count("*").over(w.rowsBetween(-40, 25))), 40, 25, chunk_rows=9)
    rows = got.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(1000))
    assert [r.n for r in rows] == [min(i, 40) + 1 + min(999 - i, 25) for i in range(1000)]


@pytest.mark.parametrize("bucket_bins", [1, 10, 100_000])
def test_positions_are_dense_and_ordered_per_key(spark, bucket_bins):
    rng = np.random.default_rng(3)
    rows = [(k, START + int(i) * STEP) for k in "ab" for i in np.sort(rng.choice(5000, 400, replace=False))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").repartition(7)
    got = with_row_index(df, STEP, ["k"], bucket_bins=bucket_bins).orderBy("k", "ts").collect()
    assert [(r.k, r.row_idx) for r in got] == [(k, i) for k in "ab" for i in range(400)]


def test_null_runs_of_any_length(spark, series):
    x = gappy(11, 400, 0.5)
    x[50:230] = np.nan
    missing = np.isnan(x)
    edges = np.flatnonzero(np.diff(np.r_[0, missing.astype(int), 0]))
    want = [(a, b - 1, b - a) for a, b in zip(edges[::2], edges[1::2])]
    df = series([None if m else v for v, m in zip(x, missing)])
    for chunk_rows in (8, 64, 5000):
        got = windows.null_runs(df, "x", chunk_rows=chunk_rows).orderBy("first_idx").collect()
        assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("seed,cells", [(1, 1), (2, 8), (3, 64)])
def test_nearest_join_equals_merge_asof(spark, seed, cells):
    rng = np.random.default_rng(seed)
    base = pd.Timestamp(START)
    left = pd.DataFrame({"ts": base + pd.to_timedelta(rng.integers(0, 40_000, 300), unit="s")})
    offsets = np.unique(np.r_[rng.integers(0, 40_000, 120), rng.integers(9_000, 9_400, 80)])
    right = pd.DataFrame({"ts": base + pd.to_timedelta(offsets, unit="s"), "truth": offsets.astype(float)})
    tolerance = timedelta(seconds=150)
    want = pd.merge_asof(
        left.sort_values("ts"), right, on="ts", direction="nearest", tolerance=pd.Timedelta(tolerance)
    ).dropna()
    naive = lambda df: spark.createDataFrame(df).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = asof_nearest(naive(left), naive(right), ["truth"], tolerance, cells_per_tolerance=cells).orderBy("ts", "truth").toPandas()
    assert sorted(zip(got.ts, got.truth)) == sorted(zip(want.ts, want.truth))
    assert ((got.ts - got.matched_ts).abs() <= pd.Timedelta(tolerance)).all()


def test_nearest_join_keeps_keys_apart(spark):
    left = spark.createDataFrame([("a", START), ("b", START)], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", START, 1.0), ("b", START + timedelta(seconds=9), 2.0)], "k string, ts timestamp_ntz, truth double")
    got = asof_nearest(left, right, ["truth"], timedelta(seconds=10), keys=["k"])
    assert {r.k: r.truth for r in got.collect()} == {"a": 1.0, "b": 2.0}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(
        {
            "k": np.where(rng.random(3000) < 0.8, "hot", "cold"),
            "wide": np.exp(rng.normal(size=3000) * 30) * rng.choice([-1, 1], 3000),
            "ties": rng.integers(0, 4, 3000).astype(float),
        }
    )
    frame.loc[rng.random(3000) < 0.1, "wide"] = np.nan
    df = spark.createDataFrame(frame).withColumn("wide", F.nanvl("wide", F.lit(None)))
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["wide", "ties"], probabilities, ["k"]).collect()
    assert len(got) == 4
    for row in got:
        want = np.nanquantile(frame.loc[frame.k == row.k, row["name"]], probabilities)
        np.testing.assert_allclose([row[f"q_{i}"] for i in range(5)], want, rtol=1e-12)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([1.0, 2.0, 3.0, np.inf], [1.0, 2.5, np.inf]), ([-np.inf, 1.0, np.inf], [-np.inf, 1.0, np.inf]), ([4.0] * 9, [4.0, 4.0, 4.0]),
        ([np.nan, 1.0, None, 3.0], [1.0, 2.0, 3.0]), ([-np.inf, np.inf], [-np.inf, None, np.inf]), ([7.0], [7.0, 7.0, 7.0]),
    ],
)
def test_quantiles_of_odd_values(spark, values, want):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    row = exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).first()
    assert [row.q_0, row.q_1, row.q_2] == want


def test_quantiles_are_exact_when_few_values_are_ordered_at_once(spark):
    """One hot key with far more values in a bracket than may be ordered: they are narrowed slice by slice, ties among them."""
    rng = np.random.default_rng(21)
    frame = pd.DataFrame({"k": np.where(rng.random(60_000) < 0.9, "hot", "cold"), "wide": np.exp(rng.normal(size=60_000) * 20), "ties": rng.integers(0, 40, 60_000) / 7})
    probabilities = [0.0, 0.25, 0.5, 0.99, 1.0]
    for row in exact_quantiles(spark.createDataFrame(frame), ["wide", "ties"], probabilities, ["k"], ordered=8).collect():
        want = np.quantile(frame.loc[frame.k == row.k, row["name"]], probabilities)
        np.testing.assert_allclose([row[f"q_{i}"] for i in range(5)], want, rtol=1e-12)


def test_narrowing_leaves_few_values_and_counts_what_is_below(spark):
    held = spark.range(50_000).select(F.lit("x").alias("name"), F.lit(0).alias("slot"), (F.col("id") * 2.0).alias("inside"), (F.col("id") % 3 + 1).alias("c"))
    wanted = spark.createDataFrame([("x", 0, 70_000.5, 10)], "name string, slot int, position double, below bigint")
    got, ranks = quantiles._narrowed(held, wanted, ["name", "slot"], 16)
    kept, row = sorted(got.collect(), key=lambda r: r.inside), ranks.first()
    assert 2 <= len(kept) <= 16
    before = held.where(F.col("inside") < kept[0].inside).agg(F.sum("c")).first()[0]
    assert row.below == 10 + before and row.below <= 70_000 < 70_001 < row.below + sum(r.c for r in kept)


@pytest.mark.parametrize("ordered", [8, 65_536])
def test_quantiles_of_rows_without_a_key(spark, ordered):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), (None, 1, 9.0), (None, 1, 10.0), (None, None, 5.0), *[("b", None, float(i)) for i in range(101)]]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, j int, x double"), ["x"], [0.5], ["k", "j"], ordered).collect()
    assert {(r.k, r.j): r.q_0 for r in got} == {("a", 1): 2.0, (None, 1): 9.5, (None, None): 5.0, ("b", None): 50.0} and len(got) == 4


def test_rows_without_a_key_are_attached(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, id int")
    groups = spark.createDataFrame([("a", "x"), (None, "y")], "k string, v string")
    for got in (attach(rows, groups, ["k"]), attach_salted(rows, groups, ["k"])):
        assert got.columns == ["k", "id", "v"] and {(r.k, r.id, r.v) for r in got.collect()} == {("a", 1, "x"), (None, 2, "y")}


def test_quantiles_of_one_huge_group_and_of_none(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("double").alias("x"))
    row = exact_quantiles(df, ["x"], [0.25, 0.5]).first()
    assert (row.q_0, row.q_1) == (49_999.75, 99_999.5)
    assert exact_quantiles(df.where("x < 0"), ["x"], [0.5]).count() == 0


def test_attached_groups_are_the_same_salted(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    groups = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    plain = sorted(attach(rows, groups, ["k"]).select("k", "id", "v").collect())
    assert plain == sorted(attach_salted(rows, groups, ["k"]).select("k", "id", "v").collect()) and len(plain) == 334


def test_resampling_a_grid_changes_nothing(spark):
    rows = [(START + timedelta(seconds=int(s)), float(s)) for s in np.random.default_rng(2).integers(0, 90_000, 300)]
    once = resample.resample_mean(spark.createDataFrame(rows, "ts timestamp_ntz, v double"), ["v"], STEP)
    assert once.exceptAll(resample.resample_mean(once, ["v"], STEP)).isEmpty()


def test_keyed_spine_covers_each_key(spark):
    rows = [("a", START, 1.0), ("a", START + 3 * STEP, 2.0), ("b", START + STEP, 5.0)]
    got = resample.resample_mean(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["v"], STEP, ["k"])
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 4, "b": 1}


def test_one_stamp_with_most_of_the_rows_is_reduced_before_the_shuffle(spark):
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("ordinal")
    ).select(F.timestamp_micros("k").cast("timestamp_ntz").alias("ts"), "ordinal", F.lit(1.0).alias("v"))
    got = dedup_keep_first(hot, ["ordinal"])
    assert got.count() == 13_334
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_blend_ends_are_the_single_models(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(100, 3)), columns=["y", "a", "b"]))
    scores = {r.alpha: r.rmse for r in scoring.alpha_scores(df, "y", "a", "b").collect()}
    one, two = df.agg(scoring.rmse("y", "a"), scoring.rmse("y", "b")).first()
    assert scores[0.0] == pytest.approx(one) and scores[1.0] == pytest.approx(two)
