"""Forecast scores and blend weights, as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.operators.horizons import horizon_column


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _pair(truth: Column | str, guess: Column | str) -> tuple[Column, Column]:
    truth, guess = _c(truth), _c(guess)
    both = truth.isNotNull() & guess.isNotNull()
    return F.when(both, truth), F.when(both, truth - guess)


def mae(truth: Column | str, guess: Column | str) -> Column:
    return F.avg(F.abs(_pair(truth, guess)[1]))


def mse(truth: Column | str, guess: Column | str) -> Column:
    error = _pair(truth, guess)[1]
    return F.avg(error * error)


def rmse(truth: Column | str, guess: Column | str) -> Column:
    return F.sqrt(mse(truth, guess))


def r2(truth: Column | str, guess: Column | str) -> Column:
    """1 - SSE/SST; for a constant truth 1 if the forecast is exact and 0 otherwise."""
    y, error = _pair(truth, guess)
    sse, sst = F.sum(error * error), F.var_pop(y) * F.count(y)
    varied = F.when(F.min(y) < F.max(y), sst)
    return F.when(varied > 0, 1 - sse / varied).when(sse == 0, F.lit(1.0)).when(sse > 0, F.lit(0.0))


def metric_struct(truth: Column | str, guess: Column | str) -> Column:
    return F.struct(mae(truth, guess).alias("mae"), rmse(truth, guess).alias("rmse"), r2(truth, guess).alias("r2"))


def regression_metrics(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(_pair(truth, guess)[1]).alias("n"), mae(truth, guess).alias("mae"), rmse(truth, guess).alias("rmse"),
        r2(truth, guess).alias("r2"),
    )


def skill(truth: str, guess: str, baseline: str) -> Column:
    """1 - MSE/MSE of the baseline; NULL where the baseline is perfect."""
    return 1 - mse(truth, guess) / F.nullif(mse(truth, baseline), F.lit(0.0))


def skill_score(df: DataFrame, truth: str, guess: str, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(skill(truth, guess, baseline).alias("skill_score"))


def blend(tree: Column | str, sequence: Column | str, alpha: Column | float) -> Column:
    """``alpha`` parts of the sequence model, the rest from the tree model."""
    alpha = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return alpha * _c(sequence) + (1 - alpha) * _c(tree)


def blend_by_horizon(df: DataFrame, alphas: Mapping[str, float], tree: str, sequence: str, name: str = "ensemble") -> DataFrame:
    return df.withColumn(name, blend(tree, sequence, horizon_column("horizon", alphas)))


def alpha_scores(df: DataFrame, truth: str, tree: str, sequence: str, by: Sequence[str] = (), alphas: Sequence[float] = tuple(schemas.ALPHAS)) -> DataFrame:
    """RMSE of the blend for every candidate weight, from one scan."""
    scores = df.groupBy(*by).agg(
        F.array(*[F.struct(F.lit(a).alias("alpha"), rmse(truth, blend(tree, sequence, a)).alias("rmse")) for a in alphas]).alias("s")
    )
    return scores.select(*by, F.inline("s"))


def best_alpha(df: DataFrame, truth: str, tree: str, sequence: str, by: Sequence[str] = (), alphas: Sequence[float] = tuple(schemas.ALPHAS)) -> DataFrame:
    """``(by.., alpha, val_rmse)`` with the smallest RMSE; the smallest weight wins a tie."""
    scores = df.groupBy(*by).agg(
        F.array_min(F.array(*[F.struct(rmse(truth, blend(tree, sequence, a)).alias("rmse"), F.lit(a).alias("alpha")) for a in alphas])).alias("best")
    )
    return scores.select(*by, F.col("best.alpha").alias("alpha"), F.col("best.rmse").alias("val_rmse"))


def model_comparison(df: DataFrame, truth: str, models: Mapping[str, str], by: Sequence[str] = ("horizon",)) -> DataFrame:
    """``(by.., model, n, mae, rmse, r2)`` for several prediction columns in one pass."""
    scores = df.groupBy(*by).agg(*[
        F.struct(F.count(_pair(truth, c)[1]).alias("n"), mae(truth, c).alias("mae"), rmse(truth, c).alias("rmse"), r2(truth, c).alias("r2")).alias(name)
        for name, c in models.items()
    ])
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.col(name).alias("m")) for name in models])
    return scores.select(*by, F.inline(rows)).select(*by, "model", "m.n", "m.mae", "m.rmse", "m.r2")


def align_predictions(tree: DataFrame, sequence: DataFrame, keys: Sequence[str] = ("horizon", "split", "ts")) -> DataFrame:
    """Put two models' forecasts side by side by what they forecast instead of by position.

    The sequence model has no forecast for the first rows of a split; the inner join drops them.
    """
    return tree.join(sequence, list(keys))
