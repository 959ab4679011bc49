"""Clean series to the feature table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from fluxlake import schemas
from fluxlake.operators.gather import dynamic_lag
from fluxlake.operators.position import over_chunks, with_row_index
from fluxlake.operators.windows import difference_expressions, ema_features, lag_expressions, rolling_expressions
from fluxlake.session import stage

DELTAS = {"delta_Bz": "Bz_lag", "delta_speed": "solar_wind_speed_lag", "delta_flux": schemas.LOG_TARGET}


def raw_features(prepared: DataFrame, cadence: timedelta, delta_km: float = schemas.DELTA_X_KM) -> DataFrame:
    """All feature columns, with NULL where a lag or window reaches before the series.

    Shuffles: positions, the lag join, one pass over chunks for the bounded windows, and the blocks of the averages.
    ``prepared`` is read twice, so pass it staged; the numbered rows are staged because both sides of the join read them.
    """
    indexed = stage(with_row_index(prepared, cadence), "numbered_series")
    lagged = dynamic_lag(indexed, cadence.total_seconds() / 60.0, delta_km)

    def build(rows, window):
        return rows.withColumns(
            {
                **lag_expressions(schemas.LOG_TARGET, window),
                **rolling_expressions(schemas.LOG_TARGET, window),
                **difference_expressions(DELTAS, window),
            }
        )

    back = max(*schemas.LAG_STEPS, *schemas.ROLLING_WINDOWS)
    return ema_features(over_chunks(lagged, build, back), schemas.LOG_TARGET)


def feature_table(prepared: DataFrame, cadence: timedelta, delta_km: float = schemas.DELTA_X_KM) -> DataFrame:
    """``(ts, 35 features)`` for the rows where every feature is known."""
    rows = raw_features(prepared, cadence, delta_km).dropna(subset=schemas.FEATURE_COLUMNS)
    return rows.select("ts", *schemas.FEATURE_COLUMNS)
