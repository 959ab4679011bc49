"""Pull values from an earlier row whose distance is computed per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.guards import lag_steps


def gather_backward(
    df: DataFrame, columns: Sequence[str], steps: Column, keys: Sequence[str] = (), idx: str = "row_idx",
    suffix: str = "_lag", keep: Sequence[str] = (),
) -> DataFrame:
    """For each row, ``columns`` of the row ``steps`` positions before it; NULL before the first row.

    One left equi-join on the source position serves all columns. ``keep`` names the columns of the
    row itself to carry along.
    """
    wanted = df.select(*keys, idx, *keep, (F.col(idx) - steps).alias("_source"))
    source = df.select(*keys, F.col(idx).alias("_source"), *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return wanted.join(source, [*keys, "_source"], "left").drop("_source")


def dynamic_lag(
    df: DataFrame, cadence_minutes: float, delta_km: float = schemas.DELTA_X_KM,
    columns: Sequence[str] = tuple(schemas.DRIVERS + schemas.SCALED_DRIVERS), speed: str = "solar_wind_speed",
    keys: Sequence[str] = (), idx: str = "row_idx",
) -> DataFrame:
    """Replace the driver columns by their values when the matter now arriving was measured."""
    keep = [c for c in df.columns if c not in {*columns, *keys, idx}]
    return gather_backward(df, columns, lag_steps(speed, cadence_minutes, delta_km), keys, idx, keep=keep)


def lag_step_stats(df: DataFrame, cadence_minutes: float, delta_km: float = schemas.DELTA_X_KM, speed: str = "solar_wind_speed") -> DataFrame:
    steps = lag_steps(speed, cadence_minutes, delta_km)
    return df.agg(F.avg(steps).alias("mean_steps"), F.max(steps).alias("max_steps"))
