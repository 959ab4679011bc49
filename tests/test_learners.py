from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import horizons, lagged, learners, trees as flat
from fluxlake.operators.scoring import rmse
from fluxlake.plans import evaluate, report

STEP = timedelta(minutes=5)
INPUTS = ["log_electron_flux", "x"]
GRID = {"n_estimators": [3, 8], "max_depth": [3], "learning_rate": [0.3], "subsample": [1.0]}


@pytest.fixture(scope="module")
def indexed(spark):
    n, rng = 400, np.random.default_rng(1)
    wave = np.sin(np.arange(n) / 9.0)
    rows = [(datetime(2024, 1, 1) + i * STEP, i, float(wave[i] + rng.normal() / 50), float(np.cos(i / 9.0))) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, row_idx bigint, log_electron_flux double, x double")
    return df.repartition(2).cache()


@pytest.fixture(scope="module")
def fitted(indexed):
    data = horizons.build_datasets(indexed, 400, {"A": 9}, INPUTS)
    return data, learners.train_trees(data, INPUTS, GRID), learners.train_windows(data, 6, INPUTS, 0.0001)


def test_both_learners_beat_the_mean(fitted):
    data, trees, windows = fitted
    test = data.where("split = 'test'")
    spread = test.agg(F.stddev_pop("y")).first()[0]
    assert learners.predict_trees(trees, test).agg(rmse("y", "tree_pred")).first()[0] < spread
    assert learners.predict_windows(windows, test).agg(rmse("y", "sequence_pred")).first()[0] < spread
    assert len(trees.trials) == 2 and trees.val_rmse == min(error for _, error in trees.trials)


def test_grid_order_and_first_best():
    assert learners.settings({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]


def test_saved_trees_predict_the_same(fitted, tmp_path):
    data, trees, _ = fitted
    learners.save_trees(trees.model, str(tmp_path / "m"))
    again = learners.Fitted(learners.load_trees(str(tmp_path / "m")), trees.inputs)
    total = lambda fitted: learners.predict_trees(fitted, data).agg(F.sum("tree_pred")).first()[0]
    assert total(again) == total(trees)


def test_history_and_latest_forecast(fitted, indexed):
    data, trees, windows = fitted
    both = learners.predict_windows(windows, learners.predict_trees(trees, data))
    weights = evaluate.ensemble_weights(both, 6)
    alphas = evaluate.collect_alphas(weights)
    horizon = {"A": 9}
    history = evaluate.full_history(indexed, {"A": trees}, {"A": windows}, alphas, STEP, horizon)
    assert history.count() == 400 - 5
    last = indexed.agg(F.max("ts")).first()[0]
    latest = report.latest_forecast(indexed, {"A": trees}, {"A": windows}, weights, alphas, 6, STEP, horizon).collect()
    assert len(latest) == 1 and latest[0].valid_ts == last + 9 * STEP
    newest = history.where(F.col("valid_ts") == latest[0].valid_ts).first()
    assert newest.model_pred == pytest.approx(latest[0].log_pred) and latest[0].flux_pred == pytest.approx(10 ** latest[0].log_pred)


def test_too_little_history_gives_no_forecast(fitted, indexed):
    _, trees, windows = fitted
    none = evaluate.full_history(indexed.limit(5), {"A": trees}, {"A": windows}, {}, STEP, {"A": 9})
    assert none.isEmpty()


def test_best_round_stops_after_patience():
    assert flat.best_round([5, 4, 4, 3, 9, 9], 3) == (3, False)
    assert flat.best_round([5, 4, 4, 6, 6, 1], 3) == (1, True)
    assert flat.best_round([2, 2, 2], 2) == (0, True)


def test_flat_trees_score_as_their_models(fitted, indexed):
    data, trees, _ = fitted
    rows = learners.assemble(data, INPUTS)
    models = {f"p{n}": learners.boost(rows, n, 3, 0.3, 0.8, 5) for n in (2, 6)}
    arrays = {name: flat.FlatTrees.of(model) for name, model in models.items()}
    scored = flat.score_trees(data, arrays, INPUTS)
    for name, model in models.items():
        own = learners.predict_trees(learners.Fitted(model, INPUTS), scored, "own")
        assert own.agg(F.max(F.abs(F.col("own") - F.col(name)))).first()[0] < 1e-12
    # A longer fit begins with the trees of a shorter one, and one scan gives the error after every round.
    assert (arrays["p6"].value[:len(arrays["p2"].value)] == arrays["p2"].value).all()
    val = rows.where("is_val")
    errors = flat.round_errors(arrays["p6"], val)
    assert errors[1] == pytest.approx(models["p2"].transform(val).agg(rmse("y", "prediction")).first()[0])
    assert errors[5] == pytest.approx(models["p6"].transform(val).agg(rmse("y", "prediction")).first()[0])
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_search_cuts_at_the_best_round(fitted):
    data, trees, _ = fitted
    val = learners.assemble(data, INPUTS).where("is_val")
    errors = flat.round_errors(flat.FlatTrees.of(trees.model), val)
    assert errors[-1] == pytest.approx(trees.val_rmse) == min(errors)
    assert len(errors) <= trees.params["n_estimators"]


def test_search_begins_again_seldom_and_fits_no_model_twice(spark, monkeypatch):
    rng, fits, boost = np.random.default_rng(3), [], learners.boost
    x = rng.normal(size=(400, 2))
    rows = [("A", "val" if i % 4 == 0 else "train", float(x[i, 0]), float(x[i, 1]), float(x[i, 0] + x[i, 1])) for i in range(400)]
    data = spark.createDataFrame(rows, "horizon string, split string, a double, b double, y double").coalesce(1).cache()

    def noted(rows, rounds, *setting):
        fits.append((setting[:3], rounds))
        return boost(rows, rounds, *setting)

    monkeypatch.setattr(learners, "boost", noted)
    monkeypatch.setattr(learners, "FIRST_ROUNDS", 3)
    grid = {"n_estimators": [6, 48], "max_depth": [2], "learning_rate": [0.1], "subsample": [0.8, 1.0]}
    found = learners.train_all_trees({"A": data, "B": data}, ["a", "b"], grid, 5)
    # The errors of this smooth target fall up to the last round; each of the two horizons' settings is fitted thrice, and the best not once more.
    assert sorted(fits) == sorted([((2, 0.1, s), n) for s in (0.8, 1.0) for n in (3, 12, 48)] * 2)
    best = found["A"]
    assert found["B"].trials == best.trials and best.params["n_estimators"] == 48 and best.model.getNumTrees == 48 == best.model.getMaxIter()
    own = boost(learners.assemble(data, ["a", "b"]), 6, 2, 0.1, 1.0, 7)
    learners.save_trees(boost(learners.assemble(data, ["a", "b"]), 9, 2, 0.1, 1.0, 7), path := learners.fresh_path(spark, "nine"))
    cut = learners.cut_trees(path, 6)
    total = lambda model: learners.predict_trees(learners.Fitted(model, ["a", "b"]), data).agg(F.sum("tree_pred")).first()[0]
    assert total(cut) == total(own) and cut.numFeatures == 2 and cut.getNumTrees == 6 == cut.getMaxIter()


def test_lengths_end_with_the_most_and_cost_little_more():
    assert learners.lengths(600) == [32, 139, 600] and learners.lengths(300) == [32, 98, 300] and learners.lengths(8) == [8]


@pytest.mark.parametrize("count, length, chunk_rows", [(60, 5, 7), (40, 5, 4096), (9, 5, 7), (5, 5, 100), (23, 1, 6), (300, 24, 32)])
def test_window_ridge_equals_direct_fit(spark, count, length, chunk_rows):
    rng = np.random.default_rng(count)
    x = rng.normal(size=(count, 3)) * [1, 5, 0.2] + [3, 0, 1]
    y = rng.normal(size=count) + x[:, 0]
    frame = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in rng.permutation(count).tolist()], "i bigint, a double, b double, c double, y double")
    model = lagged.fit_ridge(frame, length, ["a", "b", "c"], "y", "i", 0.01, chunk_rows)
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    flat_windows = np.array([scaled[t - np.arange(length)].ravel() for t in range(length - 1, count)])
    centred, target = flat_windows - flat_windows.mean(axis=0), y[length - 1:]
    weights = np.linalg.solve(centred.T @ centred + 0.01 * len(target) * np.eye(centred.shape[1]), centred.T @ (target - target.mean()))
    got = lagged.score_windows(frame, {"p": model}, ["a", "b", "c"], (), "i", chunk_rows).orderBy("i").collect()
    assert [r.i for r in got] == list(range(length - 1, count))
    assert np.allclose([r.p for r in got], target.mean() + centred @ weights, atol=1e-9)


def test_too_short_series_has_no_window_model(spark):
    frame = spark.createDataFrame([(i, 1.0, 2.0) for i in range(3)], "i bigint, a double, y double")
    assert lagged.fit_ridge(frame, 4, ["a"], "y", "i") is None


def test_history_reads_its_rows_once(fitted, indexed):
    _, trees, windows = fitted
    both = evaluate.full_history(indexed, {"A": trees, "B": trees}, {"A": windows, "B": windows}, {"A": 0.2, "B": 0.7}, STEP, {"A": 9, "B": 12})
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1
    assert both.count() == 2 * (400 - 5)
