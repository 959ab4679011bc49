"""Feature table to supervised datasets for every horizon."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import DataFrame

from fluxlake import schemas
from fluxlake.operators.horizons import build_datasets
from fluxlake.operators.position import with_row_index


def horizon_datasets(features: DataFrame, cadence: timedelta, horizons: Mapping[str, int] = schemas.HORIZON_STEPS) -> DataFrame:
    """All horizons in one table; ``features`` is read twice, so pass it staged."""
    return build_datasets(with_row_index(features, cadence), features.count(), horizons)
