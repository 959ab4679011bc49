"""Grid to clean, log-transformed, scaled series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.guards import log_flux
from fluxlake.operators.position import with_row_index, over_chunks
from fluxlake.operators.scaling import ScalerParam, apply_scaler, fit_robust_scaler
from fluxlake.operators.windows import fill_gaps, null_spikes, spike_reach
from fluxlake.session import stage


def clean_series(
    grid: DataFrame, cadence: timedelta, spike_window: int = schemas.SPIKE_WINDOW,
    threshold: float = schemas.SPIKE_THRESHOLD, max_gap: int = schemas.MAX_GAP, keys: Sequence[str] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """Drop rows without a target, remove spikes, fill short gaps, drop long ones, add the log flux.

    Despiking and gap filling stack in one pass over the same chunks: one shuffle for both. ``grid`` is
    read twice, so pass it staged. An ``observation`` counts ``rows`` and ``spikes`` as they pass.
    """
    indexed = with_row_index(grid.where(F.col(schemas.TARGET).isNotNull()), cadence, keys)

    def build(rows, window):
        rows = null_spikes(rows, window, schemas.TARGET, spike_window, threshold).withColumn(
            "_spiked", F.col(schemas.TARGET).isNull()
        )
        return fill_gaps(rows, window, schemas.GRID_COLUMNS, max_gap)

    back, ahead = spike_reach(spike_window)
    filled = over_chunks(indexed, build, back + max_gap, ahead + max_gap, keys)
    if observation is not None:
        filled = filled.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if("_spiked").alias("spikes"))
    cleaned = filled.dropna(subset=schemas.GRID_COLUMNS)
    return cleaned.drop("row_idx", "_spiked").withColumn(schemas.LOG_TARGET, log_flux(schemas.TARGET))


def prepare(grid: DataFrame, cadence: timedelta, fit_rows: Column | None = None) -> tuple[DataFrame, list[ScalerParam]]:
    """The staged clean series with scaled drivers, and the fitted scaler.

    The scaler is fitted on the whole table; pass a condition as ``fit_rows`` to fit it on, say, the
    training period only.
    """
    cleaned = stage(clean_series(grid, cadence), "clean_series")
    params = fit_robust_scaler(cleaned if fit_rows is None else cleaned.where(fit_rows), schemas.DRIVERS)
    return apply_scaler(cleaned, params), params
