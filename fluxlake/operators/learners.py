"""Two regressors per horizon: Spark ML's boosted trees on single rows, a ridge regression on windows of rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.operators.lagged import WindowRidge, fit_ridge, score_windows
from fluxlake.operators.scoring import rmse
from fluxlake.operators.trees import FlatTrees, best_round, model_metadata, round_errors
from fluxlake.session import fresh_path, shared_dir, stage

FITS_AT_ONCE = 12
# Rounds without a gain after which boosting stops, rounds that a fit begins with, and how often it begins again at most.
PATIENCE = 20
FIRST_ROUNDS = 32
RESTARTS = 2
# Rows of a task at least: a round is a dozen short stages, whose cost is that of their tasks.
TASK_ROWS = 16_384


@dataclass
class Fitted:
    """A fitted model with the setting that won and its validation error."""

    model: GBTRegressionModel | WindowRidge
    inputs: list[str]
    params: dict[str, float] = field(default_factory=dict)
    val_rmse: float = float("inf")
    trials: list[tuple[dict[str, float], float]] = field(default_factory=list)


def settings(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """All combinations, the last parameter varying fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _vector(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="inputs").transform(df)


def assemble(dataset: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``(inputs, y, is_val)`` of the ``train`` and ``val`` rows, staged for many fits."""
    rows = dataset.where(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    rows = stage(_vector(rows, inputs).select("inputs", "y", "is_val"), "tree_rows")
    return rows.coalesce(max(1, rows.count() // TASK_ROWS))


def boost(rows: DataFrame, rounds: int, depth: int, step: float, subsample: float, seed: int) -> GBTRegressionModel:
    """Boosted trees on the ``train`` rows; with one seed, more rounds begin with the trees of fewer rounds."""
    learner = GBTRegressor(
        featuresCol="inputs", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed,
    )
    return learner.fit(rows.where("NOT is_val"))


def lengths(most: int) -> list[int]:
    """Rounds of the fits that are tried one after the other: ``FIRST_ROUNDS``, then more by equal factors, the last one ``most``."""
    first = min(FIRST_ROUNDS, most)
    return sorted({round(first * (most / first) ** (i / RESTARTS)) for i in range(RESTARTS + 1)})


def _errors(rows: DataFrame, most: int, depth: int, step: float, subsample: float, patience: int, seed: int) -> tuple[list[float], str]:
    """Validation error after every round, up to ``most`` rounds or beyond ``patience`` rounds without a gain, and where the model is saved.

    Spark ML's trees cannot be grown on, so a fit that has not stopped begins again with more rounds (``lengths``): with ``most`` of 600 that
    is 771 rounds at most.
    """
    for rounds in lengths(most):
        path = fresh_path(rows.sparkSession, "trees")
        save_trees(boost(rows, rounds, depth, step, subsample, seed), path)
        errors = round_errors(FlatTrees.read(path), rows.where("is_val"))
        if best_round(errors, patience)[1]:
            break
    return errors, path


def train_trees(
    dataset: DataFrame, inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS),
    grid: Mapping[str, Sequence[float]] = schemas.TREE_GRID, patience: int = PATIENCE, seed: int = 7,
) -> Fitted:
    """``train_all_trees`` of the rows of one horizon."""
    return train_all_trees({"": dataset}, inputs, grid, patience, seed)[""]


def train_all_trees(
    datasets: Mapping[str, DataFrame], inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS),
    grid: Mapping[str, Sequence[float]] = schemas.TREE_GRID, patience: int = PATIENCE, seed: int = 7,
) -> dict[str, Fitted]:
    """Search the whole grid on the ``train`` rows of each horizon and keep its best on its ``val`` rows.

    Boosting stops after ``patience`` rounds without a gain on the validation rows and the model is cut at its best round.
    The first trees of a longer fit are those of a shorter one, so settings that differ in ``n_estimators`` only share a fit. Of
    equally good settings the first wins. A horizon's assembled rows are staged once for all fits; those of all horizons run a few at a time.
    """
    if not datasets:
        return {}
    shared_dir(next(iter(datasets.values())).sparkSession)
    rows = {name: assemble(dataset, inputs) for name, dataset in datasets.items()}
    candidates = settings(grid)
    family = lambda chosen: (int(chosen["max_depth"]), float(chosen["learning_rate"]), float(chosen["subsample"]))
    most: dict[tuple, int] = {}
    for chosen in candidates:
        most[family(chosen)] = max(most.get(family(chosen), 0), int(chosen["n_estimators"]))
    fits = [(name, one) for one in most for name in rows]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        done = dict(zip(fits, pool.map(lambda fit: _errors(rows[fit[0]], most[fit[1]], *fit[1], patience, seed), fits)))
    found = {}
    for name in rows:
        best, rounds = Fitted(None, list(inputs)), 0
        for chosen in candidates:
            seen = done[name, family(chosen)][0][:int(chosen["n_estimators"])]
            at, _ = best_round(seen, patience)
            best.trials.append((chosen, seen[at]))
            if not rounds or seen[at] < best.val_rmse:
                best.params, best.val_rmse, rounds = chosen, seen[at], at + 1
        best.model = cut_trees(done[name, family(best.params)][1], rounds)
        found[name] = best
    return found


def cut_trees(saved: str, rounds: int) -> GBTRegressionModel:
    """The first ``rounds`` trees of the model saved at ``saved``, which are those that a fit of as many rounds gives."""
    spark = SparkSession.active()
    path, about = fresh_path(spark, "cut_trees"), model_metadata(saved)
    about["numTrees"] = about["paramMap"]["maxIter"] = rounds
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.read.parquet(f"{saved}/treesMetadata").where(F.col("_1") < rounds).write.parquet(f"{path}/treesMetadata")
    spark.read.parquet(f"{saved}/data").where(F.col("treeID") < rounds).write.parquet(f"{path}/data")
    return load_trees(path)


def predict_trees(fitted: Fitted, rows: DataFrame, name: str = "tree_pred") -> DataFrame:
    return fitted.model.transform(_vector(rows, fitted.inputs)).withColumnRenamed("prediction", name).drop("inputs")


def save_trees(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_trees(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def train_windows(
    dataset: DataFrame, length: int, inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS), regularisation: float = 0.01,
) -> Fitted | None:
    """A ridge regression on all ``length`` latest rows of each row; None if no ``train`` row has that many.

    Windows never cross from one split into another.
    """
    model = fit_ridge(dataset.where("split = 'train'"), length, inputs, ridge=regularisation)
    if model is None:
        return None
    fitted = Fitted(model, list(inputs), {"regularisation": regularisation, "length": length})
    error = predict_windows(fitted, dataset.where("split = 'val'")).agg(rmse("y", "sequence_pred").alias("rmse")).first()["rmse"]
    fitted.val_rmse = float("nan") if error is None else error
    return fitted


def predict_windows(
    fitted: Fitted, rows: DataFrame, groups: Sequence[str] = ("horizon", "split"), idx: str = "split_idx",
    name: str = "sequence_pred",
) -> DataFrame:
    """Forecasts for the rows with enough history in their group."""
    return score_windows(rows, {name: fitted.model}, fitted.inputs, groups, idx)
