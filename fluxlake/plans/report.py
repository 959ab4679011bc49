"""The data behind a forecast page: history, current conditions, forecasts, scores."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.guards import confidence_label, flux_from_log
from fluxlake.operators.horizons import horizon_column
from fluxlake.operators.learners import Fitted
from fluxlake.operators.resample import resample_mean
from fluxlake.plans.evaluate import full_history

CONDITION_FORMATS = {"Bx_lag": "0.00", "By_lag": "0.00", "Bz_lag": "0.00", "solar_wind_speed_lag": "0.0", "plasma_density_lag": "0.00"}


def history_series(features: DataFrame, cadence: timedelta | None = None) -> DataFrame:
    """Measured flux over time, averaged to a coarser bin if one is given."""
    series = features.select("ts", schemas.TARGET)
    return series if cadence is None else resample_mean(series, [schemas.TARGET], cadence)


def latest_row(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """The row with the latest stamp: one partial aggregate instead of a sort."""
    return df.agg(F.max_by(F.struct(ts, *columns), ts).alias("row")).select("row.*")


def latest_conditions(features: DataFrame) -> DataFrame:
    """Current driver readings, formatted; ties are rounded by the exact binary value."""
    row = latest_row(features, list(CONDITION_FORMATS))
    text = lambda c, pattern: F.call_function("format_number", F.col(c), F.lit(pattern)).alias(c)
    return row.select("ts", *[text(c, pattern) for c, pattern in CONDITION_FORMATS.items()])


def latest_rows(df: DataFrame, count: int, ts: str = "ts") -> DataFrame:
    """The last ``count`` rows: each partition keeps its own last ones before they are merged."""
    return df.orderBy(F.col(ts).desc()).limit(count)


def metric_report(weights: DataFrame) -> DataFrame:
    """One line per horizon: label, blend weight and rounded test scores."""
    rounded = [F.round(F.col(f"test_ensemble.{m}"), 4).alias(m) for m in ("mae", "rmse", "r2")]
    label: Column = horizon_column("horizon", schemas.HORIZON_LABELS)
    return weights.select("horizon", label.alias("horizon_label"), "alpha", *rounded)


def with_confidence(weights: DataFrame) -> DataFrame:
    r2 = F.col("test_ensemble.r2")
    return weights.select("horizon", r2.alias("r2"), confidence_label(r2).alias("confidence"))


def latest_forecast(
    indexed: DataFrame, trees: Mapping[str, Fitted], windows: Mapping[str, Fitted], weights: DataFrame,
    alphas: Mapping[str, float], length: int, cadence: timedelta, horizons: Mapping[str, int] = schemas.HORIZON_STEPS,
) -> DataFrame:
    """The newest forecast of every horizon with its confidence; none with less than ``length`` rows."""
    recent = latest_rows(indexed, length)
    predictions = full_history(recent, trees, windows, alphas, cadence, horizons)
    return predictions.join(with_confidence(weights), "horizon", "left").select(
        "horizon", "valid_ts", F.col("model_pred").alias("log_pred"), flux_from_log("model_pred").alias("flux_pred"),
        F.format_string("%.2e", flux_from_log("model_pred")).alias("flux_text"), "r2", "confidence",
    )
