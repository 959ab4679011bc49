"""Scalar rules for values that are missing, impossible or out of range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake import schemas


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: Column | str) -> Column:
    """Spark aggregates do not skip NaN, so it becomes NULL where data enters."""
    value = _column(value)
    return F.when(~F.isnan(value), value)


def drop_fill(value: Column | str, two_sided: bool = False) -> Column:
    """NULL for fill values: below -1e20, or beyond it on either side."""
    value = nan_to_null(value)
    size = F.abs(value) <= F.lit(schemas.FILL_LIMIT) if two_sided else value >= F.lit(-schemas.FILL_LIMIT)
    return F.when(size, value)


def drop_nonpositive(value: Column | str) -> Column:
    """NULL for readings of a positive quantity that are zero or negative."""
    value = nan_to_null(value)
    return F.when(value > 0, value)


def log_flux(value: Column | str) -> Column:
    """Base-10 logarithm of a flux, kept finite at zero."""
    return F.log10(_column(value) + F.lit(schemas.EPSILON))


def flux_from_log(value: Column | str) -> Column:
    return F.pow(F.lit(10.0), _column(value))


def vector_length(vector: Column | str) -> Column:
    """Euclidean norm of an array column; NULL if any element is."""
    return F.sqrt(F.aggregate(_column(vector), F.lit(0.0), lambda total, x: total + x * x))


def lag_steps(speed: Column | str, cadence_minutes: float, delta_km: float = schemas.DELTA_X_KM) -> Column:
    """Whole grid steps that matter moving at ``speed`` needs to cover ``delta_km``.

    Half steps round to the even neighbour; unknown, infinite and negative delays are zero.
    """
    minutes = F.try_divide(F.lit(float(delta_km)), nan_to_null(speed) * F.lit(60.0))
    steps = F.rint(minutes / F.lit(float(cadence_minutes)))
    steps = F.when(F.abs(steps) < F.lit(float("inf")), steps)
    bounded = F.least(F.greatest(F.coalesce(steps, F.lit(0.0)), F.lit(0.0)), F.lit(1e15))
    return bounded.cast("bigint")


def confidence_label(r2: Column | str) -> Column:
    r2 = _column(r2)
    return (
        F.when(r2 >= F.lit(schemas.HIGH_R2), F.lit(schemas.CONFIDENCE_TEXT["high"]))
        .when(r2 >= F.lit(schemas.MODERATE_R2), F.lit(schemas.CONFIDENCE_TEXT["moderate"]))
        .otherwise(F.lit(schemas.CONFIDENCE_TEXT["low"]))
    )


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    require(not missing, f"missing columns {missing}; have {df.columns}")
