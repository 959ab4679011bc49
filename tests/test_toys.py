"""Hand-computed cases, one per rule that is easy to get wrong."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions import guards
from fluxlake.operators import clean, gather, horizons, resample, scaling, scoring, windows
from fluxlake.operators.asof import asof_nearest
from fluxlake.plans import report

N = None


def close(got, want, digits=1e-8):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or (g is not None and w is not None and abs(g - w) < digits), (got, want)


def test_resample_lists_empty_bins(spark):
    rows = [(datetime(2024, 1, 1, 0, 1), 1.0), (datetime(2024, 1, 1, 0, 16), 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = resample.resample_mean(df, ["v"], timedelta(minutes=5)).orderBy("ts").collect()
    assert [(r.ts.minute, r.v) for r in got] == [(0, 1.0), (5, N), (10, N), (15, 2.0)]


def test_resample_bins_start_at_midnight_for_odd_widths(spark):
    rows = [(datetime(2024, 1, 1, 0, 8), 1.0), (datetime(2024, 1, 1, 0, 20), 3.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = resample.resample_mean(df, ["v"], timedelta(minutes=7)).orderBy("ts").collect()
    assert [(r.ts.minute, r.v) for r in got] == [(7, 1.0), (14, 3.0)]


def test_resample_keeps_bounds_of_null_readings(spark):
    rows = [(datetime(2024, 1, 1, 0, 1), N), (datetime(2024, 1, 1, 0, 6), 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    assert [r.v for r in resample.resample_mean(df, ["v"], timedelta(minutes=5)).orderBy("ts").collect()] == [N, 2.0]


def test_merge_adds_bins_between_disjoint_signals(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    a = spark.createDataFrame([(at(0), 1.0), (at(10), 2.0)], "ts timestamp_ntz, a double")
    b = spark.createDataFrame([(at(30), 5.0)], "ts timestamp_ntz, b double")
    got = resample.merge_signals([(a, ["a"]), (b, ["b"])], timedelta(minutes=5)).orderBy("ts").collect()
    assert [(r.a, r.b) for r in got] == [(1.0, N), (N, N), (2.0, N), (N, N), (N, N), (N, N), (N, 5.0)]


def test_align_is_the_overlap_of_both_periods(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    target = spark.createDataFrame([(at(5), 1.0), (at(20), 2.0)], "ts timestamp_ntz, y double")
    driver = spark.createDataFrame([(at(0), 7.0), (at(15), 8.0)], "ts timestamp_ntz, d double")
    got = resample.align_grid((target, ["y"]), [(driver, ["d"])], timedelta(minutes=5)).orderBy("ts").collect()
    assert [(r.ts.minute, r.y, r.d) for r in got] == [(5, 1.0, N), (10, N, N), (15, N, 8.0)]


def test_spike_is_the_only_row_flagged(series, column):
    x = [1, 1.1, 0.9, 1, 1.2, 50, 1.1, 0.8, 1, 1.05, 0.95, 1.1, 1, 0.9]
    got = windows.flag_spikes(series(x), "x")
    assert column(got, "is_spike") == [i == 5 for i in range(14)]
    close(column(got, "rolling_median"), [1.05, 1.1, 1.05, 1, 1.025, 1, 1.025, 1.025, 1, 1, 1.025, 1, 1, 1])
    close(column(got, "rolling_mad"), [0.1, 0.075, 0.1125, 0.075, 0.0625, 0.075, 0.075, 0.075, 0.0875, 0.075, 0.0875, 0.075, 0.075, 0.075])


def test_zero_deviation_scale_flags_any_change(series, column):
    got = windows.flag_spikes(series([5] * 6 + [5.5] + [5] * 6), "x")
    assert column(got, "is_spike") == [i == 6 for i in range(13)]
    assert not any(column(windows.flag_spikes(series([5] * 13), "x"), "is_spike"))


def test_median_needs_half_a_window(series, column):
    got = column(windows.rolling_median(series([1, 2, 3, 4, 5]), "x"), "rolling_median")
    assert got == [N] * 5
    assert column(windows.rolling_median(series([1, 2, 3, 4, 5, 6]), "x"), "rolling_median")[0] == 3.5


def test_long_gaps_stay_whole(series, column):
    x = [N, 1, N, N, 4, N, N, N, 8, N]
    got = windows.interpolate_gaps(series(x), ["x"], max_gap=2, drop_unfilled=False)
    close(column(got, "x"), [1, 1, 2, 3, 4, N, N, N, 8, 8])
    assert windows.interpolate_gaps(series(x), ["x"], max_gap=2).count() == 7


def test_all_null_series_is_left_alone(series, column):
    assert column(windows.interpolate_gaps(series([N, N, N]), ["x"], 6, drop_unfilled=False), "x") == [N, N, N]


def test_lag_steps_round_half_to_even(spark):
    speeds = [400, 300, 0, N, -400, 250, 800, float("nan"), 1e-300]
    df = spark.createDataFrame([(None if s is None else float(s),) for s in speeds], "s double")
    got = [r[0] for r in df.select(guards.lag_steps("s", 5.0)).collect()]
    assert got[:8] == [12, 17, 0, 0, 0, 20, 6, 0] and got[8] >= 0


def test_gather_is_null_before_the_first_row(series, column):
    df = series([10, 11, 12, 13], k=[0, 2, 1, 3])
    got = gather.gather_backward(df, ["x"], F.col("k").cast("bigint"))
    assert column(got, "x_lag") == [10.0, N, 11.0, 10.0]


def test_ema_recursion(series, column):
    got = column(windows.ema_features(series([1, 2, 3, 4]), "x", [6], "x"), "x_ema_6")
    close(got, [1, 1.285714286, 1.775510204, 2.411078717], 1e-8)
    assert column(windows.ema_features(series([1, 2, 3]), "x", [1], "x"), "x_ema_1") == [1.0, 2.0, 3.0]


def test_rolling_needs_a_full_window(series, column):
    got = windows.rolling_stats(series([1, 2, N, 4, 5, 6, 7]), "x", [3], "x")
    assert column(got, "x_roll_mean_3") == [N, N, N, N, N, 5.0, 6.0]
    std = column(windows.rolling_stats(series([1, 2, 4]), "x", [3], "x"), "x_roll_std_3")
    close(std, [N, N, 1.527525232], 1e-8)


def test_lags_count_rows_and_differences_start_null(series, column):
    assert column(windows.lag_features(series([1, 2, 4]), "x", [1, 2], "x"), "x_lag_2") == [N, N, 1.0]
    assert column(windows.delta_features(series([1, 2, 4]), {"d": "x"}), "d") == [N, 1.0, 2.0]


def test_null_runs(series):
    got = windows.null_runs(series([N, 1, N, N, 2, N]), "x", chunk_rows=2).orderBy("first_idx").collect()
    assert [(r.first_idx, r.last_idx, r.run_length) for r in got] == [(0, 0, 1), (2, 3, 2), (5, 5, 1)]


def test_keep_first_may_keep_a_null(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, N, "a", 1), (t, 5.0, "b", 0), (t + timedelta(1), 7.0, "b", 2), (t + timedelta(1), 6.0, "b", 1)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, source_file string, ordinal bigint")
    got = clean.dedup_keep_first(df, ["source_file", "ordinal"]).orderBy("ts").collect()
    assert [r.v for r in got] == [N, 6.0]


def test_stamps_far_from_their_file_are_dropped(spark):
    good = [(datetime(2015, 3, d), "march") for d in range(1, 32)]
    bad = [(datetime(1998, 5, 31), "march"), (datetime(2055, 2, 24), "march")]
    other = [(datetime(1998, 5, 31), "other"), (datetime(1998, 6, 30), "other"), (datetime(1990, 1, 1), "old")]
    df = spark.createDataFrame(good + bad + other, "ts timestamp_ntz, source_file string")
    kept = clean.drop_corrupt_stamps(df, datetime(2024, 1, 1)).groupBy("source_file").count().collect()
    assert {r.source_file: r["count"] for r in kept} == {"march": 31, "other": 2}


def test_bad_readings_become_null(spark):
    df = spark.createDataFrame([(-1e31,), (0.0,), (float("nan"),), (2.0,), (N,), (1e30,)], "v double")
    assert [r[0] for r in df.select(guards.drop_nonpositive(guards.drop_fill("v"))).collect()] == [N, N, N, 2.0, N, 1e30]
    assert [r[0] for r in df.select(guards.drop_fill("v", two_sided=True)).collect()] == [N, 0.0, N, 2.0, N, N]


@pytest.mark.parametrize("seconds,want", [(150, [10.0]), (149, [])])
def test_nearest_tie_is_earlier_and_tolerance_inclusive(spark, seconds, want):
    left = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5),)], "ts timestamp_ntz")
    right = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 2, 30), 10.0), (datetime(2024, 1, 1, 0, 7, 30), 20.0)], "ts timestamp_ntz, truth double"
    )
    assert [r.truth for r in asof_nearest(left, right, ["truth"], timedelta(seconds=seconds)).collect()] == want


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (4.0, 5.0)], "y double, p double")
    got = scoring.regression_metrics(df, "y", "p").first()
    close([got.mae, got.rmse, got.r2], [0.5, 0.612372436, 0.7])
    flat = spark.createDataFrame([(2.0, 2.0, 1.0), (2.0, 2.0, 3.0)], "y double, good double, bad double")
    assert flat.agg(scoring.r2("y", "good")).first()[0] == 1.0
    assert flat.agg(scoring.r2("y", "bad")).first()[0] == 0.0


def test_skill_is_unknown_against_a_perfect_baseline(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0)], "y double, p double, b double")
    assert scoring.skill_score(df, "y", "p", "b").first()[0] is None
    assert scoring.skill_score(df, "y", "b", "p").first()[0] == 1.0


def test_blend_search(spark):
    df = spark.createDataFrame([(y, 0.8 * y, 1.2 * y) for y in (1.0, 2.0, 3.0, 4.0)], "y double, a double, b double")
    best = scoring.best_alpha(df, "y", "a", "b").first()
    assert best.alpha == 0.5 and best.val_rmse < 1e-12
    scores = {r.alpha: r.rmse for r in scoring.alpha_scores(df, "y", "a", "b").collect()}
    close([scores[0.4], scores[0.6]], [0.109544512, 0.109544512])
    same = spark.createDataFrame([(1.0, 2.0, 2.0)], "y double, a double, b double")
    assert scoring.best_alpha(same, "y", "a", "b").first().alpha == 0.0


@pytest.mark.parametrize("n,train,validation", [(10, 8, 9), (57, 45, 51), (100, 80, 90), (599, 479, 539)])
def test_split_sizes(spark, n, train, validation):
    labels = spark.range(n).select(horizons.split_label(F.col("id"), F.lit(n)).alias("s")).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in labels} == {"train": train, "val": validation - train, "test": n - validation}


def test_sequences_never_cross_splits(series):
    df = series(range(100)).withColumns({"log_electron_flux": F.col("x")})
    data = horizons.build_datasets(df.select("ts", "row_idx", "log_electron_flux"), 100, {"A": 10}, ["log_electron_flux"])
    got = horizons.sequence_windows(data, 4, ["log_electron_flux"])
    rows = {(r.split, r.split_idx): [x[0] for x in r.sequence] for r in got.collect()}
    assert rows[("val", 3)] == [72.0, 73.0, 74.0, 75.0] and ("val", 2) not in rows
    assert len(rows) == 90 - 3 * 3


@pytest.mark.parametrize(("length", "chunk_rows"), [(1, 3), (4, 5), (4, 4), (7, 2), (30, 8)])
def test_chunks_hold_the_windows_once(spark, length, chunk_rows):
    """Every window equals the repeated one, in rows that grow with the input alone; NULL inputs stay; a short group has none."""
    rows = [(g, i, None if i % 9 == 4 else float(i * 10 + g), float(-i)) for g, n in ((0, 33), (1, 12), (2, 3)) for i in range(n)]
    data = spark.createDataFrame(rows, "g int, at bigint, x double, y double").repartition(5)
    chunks = horizons.sequence_chunks(data, length, ["x", "y"], ["g"], "at", chunk_rows)
    assert chunks.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0] <= 2 * len(rows)
    flat = lambda views: {"window": list(views.reshape(len(views), -1))}
    got = {(r.g, r["at"]): [None if v != v else v for v in r.window] for r in horizons.map_windows(chunks, length, flat, "window array<float>", ["g"], "at").collect()}
    want = {(r.g, r["at"]): [v for row in r.sequence for v in row] for r in horizons.sequence_windows(data, length, ["x", "y"], ["g"], "at").collect()}
    assert got == want


def test_targets_look_ahead_by_rows(series, column):
    got = horizons.add_targets(series(range(6)), "x", {"A": 2, "B": 5})
    assert column(got, "y_A") == [2.0, 3.0, 4.0, 5.0, N, N] and column(got, "y_B") == [5.0, N, N, N, N, N]


def test_constant_column_is_scaled_by_one(series):
    params = {p.name: p for p in scaling.fit_robust_scaler(series([1, 2, 3, 4], c=[7, 7, 7, 7]), ["x", "c"])}
    assert (params["x"].center, params["x"].scale, params["c"].scale) == (2.5, 1.5, 1.0)


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (0.0,), (-0.01,)], "r2 double")
    got = [r[0] for r in df.select(guards.confidence_label("r2")).collect()]
    assert got[:3] == ["High", "Moderate", "Moderate"] and got[3] == schemas.CONFIDENCE_TEXT["low"]


def test_log_and_back(spark):
    df = spark.createDataFrame([(0.0,), (99.0,)], "v double")
    zero, other = [r[0] for r in df.select(guards.log_flux("v")).collect()]
    assert zero == pytest.approx(-10) and 10**other == pytest.approx(99)
    assert math.isclose(df.select(guards.flux_from_log(F.lit(2.0))).first()[0], 100.0)


def test_latest_conditions_text(spark):
    rows = [(datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), (datetime(2024, 1, 2), -35.175, 0.005, 1234.5, 399.96, 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, Bx_lag double, By_lag double, Bz_lag double, solar_wind_speed_lag double, plasma_density_lag double")
    got = report.latest_conditions(df).first()
    assert list(got)[1:] == [f"{-35.175:.2f}", f"{0.005:.2f}", "1234.50", "400.0", "0.00"]
