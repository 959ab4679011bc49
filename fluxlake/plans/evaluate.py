"""Blend weights, model comparison and the score against an independent instrument."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.guards import log_flux
from fluxlake.functions.times import shift_time
from fluxlake.operators.asof import asof_nearest
from fluxlake.operators.lagged import score_windows
from fluxlake.operators.learners import Fitted
from fluxlake.operators.scoring import best_alpha, blend_by_horizon, metric_struct, skill
from fluxlake.operators.trees import FlatTrees, score_trees
from fluxlake.session import stage

MODELS = {"ensemble": "ensemble", "tree_only": "tree_pred", "sequence_only": "sequence_pred"}


def collect_alphas(weights: DataFrame) -> dict[str, float]:
    """Blend weight per horizon: a handful of rows that become literals in later plans."""
    return {row["horizon"]: row["alpha"] for row in weights.select("horizon", "alpha").collect()}


def ensemble_weights(predictions: DataFrame, length: int) -> DataFrame:
    """One row per horizon: weight found on ``val``, then scores of blend and single models on ``test``.

    ``predictions`` holds ``horizon, split, y, tree_pred, sequence_pred``.
    """
    weights = best_alpha(predictions.where("split = 'val'"), "y", "tree_pred", "sequence_pred", ["horizon"])
    weights = stage(weights, "blend_weights")
    test = blend_by_horizon(predictions.where("split = 'test'"), collect_alphas(weights), "tree_pred", "sequence_pred")
    scores = test.groupBy("horizon").agg(*[metric_struct("y", c).alias(f"test_{m}") for m, c in MODELS.items()])
    return weights.join(scores, "horizon", "left").select(
        "horizon", "alpha", "val_rmse", F.lit(length).cast("bigint").alias("sequence_length"), *[f"test_{m}" for m in MODELS]
    )


def to_valid_time(rows: DataFrame, cadence: timedelta) -> DataFrame:
    """Add the stamp each row of a horizon is a forecast for."""
    return rows.withColumn("valid_ts", shift_time("ts", cadence, F.col("steps")))


def full_history(
    indexed: DataFrame, trees: Mapping[str, Fitted], windows: Mapping[str, Fitted], alphas: Mapping[str, float],
    cadence: timedelta, horizons: Mapping[str, int] = schemas.HORIZON_STEPS,
) -> DataFrame:
    """Forecasts from every feature row with enough history, labelled with the time they are for.

    The rows are read once: all horizons' trees are scored side by side, and so are all their windows; models of a
    kind share their inputs and window length. A horizon without
    both models and a blend weight (too little history to train on) has none.
    """
    known = [h for h in horizons if h in trees and h in windows and h in alphas]
    if not known:
        return indexed.sparkSession.createDataFrame([], schemas.PREDICTIONS)
    first = known[0]
    rows = score_trees(indexed, {f"tree_{h}": FlatTrees.of(trees[h].model) for h in known}, trees[first].inputs)
    rows = score_windows(rows, {f"sequence_{h}": windows[h].model for h in known}, windows[first].inputs, (), "row_idx")
    each = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(horizons[h]).cast("bigint").alias("steps"), F.col(f"tree_{h}").alias("tree_pred"), F.col(f"sequence_{h}").alias("sequence_pred"))
        for h in known
    ])
    parts = rows.select("ts", F.col(schemas.LOG_TARGET).alias("persistence_pred"), F.inline(each))
    blended = blend_by_horizon(parts, alphas, "tree_pred", "sequence_pred", "model_pred")
    return to_valid_time(blended, cadence).select("valid_ts", "horizon", "model_pred", "persistence_pred")


def match_truth(predictions: DataFrame, truth: DataFrame, tolerance: timedelta) -> DataFrame:
    """Predictions with the log flux the independent instrument measured nearest to their time."""
    known = truth.where(F.col("electron_flux").isNotNull()).select(
        F.col("ts").alias("truth_ts"), log_flux("electron_flux").alias("truth")
    )
    matched = asof_nearest(predictions, known, ["truth"], tolerance, "valid_ts", "truth_ts")
    return matched.dropna(subset=["truth", "model_pred", "persistence_pred"])


def validate(predictions: DataFrame, truth: DataFrame, tolerance: timedelta) -> DataFrame:
    """Per horizon: matches, scores of model and persistence, skill against persistence."""
    return match_truth(predictions, truth, tolerance).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_matched"),
        metric_struct("truth", "model_pred").alias("model_vs_truth"),
        metric_struct("truth", "persistence_pred").alias("persistence_vs_truth"),
        skill("truth", "model_pred", "persistence_pred").alias("skill_score_vs_persistence"),
    )
