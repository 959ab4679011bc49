"""Signals to one aligned grid."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from fluxlake import schemas
from fluxlake.operators.clean import drop_corrupt_stamps
from fluxlake.operators.resample import align_grid
from fluxlake.session import stage
from fluxlake.sources.archives import scan_archives
from fluxlake.sources.records import optional_source, read_directory, scan_flux, scan_plasma, scan_vector

FIVE_MINUTES = timedelta(minutes=5)


def training_grid(
    flux: DataFrame, field: DataFrame, plasma: DataFrame, cadence: timedelta = FIVE_MINUTES
) -> DataFrame:
    """Clean signals on one grid: ``(ts, goes_electron_flux, Bx, By, Bz, solar_wind_speed, plasma_density)``."""
    target = flux.withColumnRenamed("electron_flux", schemas.TARGET)
    return align_grid(
        (target, [schemas.TARGET]), [(field, schemas.FIELD_COLUMNS), (plasma, schemas.PLASMA_COLUMNS)], cadence
    )


def ingest(
    spark: SparkSession, flux_dir: str, field_dir: str, plasma_dir: str, truth_dir: str, now: datetime,
    cadence: timedelta = FIVE_MINUTES, pattern: str = "*.parquet", format: str = "parquet",
    truth_pattern: str = "*.zip",
) -> dict[str, DataFrame]:
    """Read the four sources and return the staged ``training`` grid and the ``validation`` signal.

    Stamps are checked per file before duplicates are dropped. The truth archives may be absent.
    """
    checked = lambda scan: (lambda df, **names: drop_corrupt_stamps(scan(df, **names), now))
    read = lambda path, scan: read_directory(spark, path, checked(scan), pattern, format)
    grid = training_grid(read(flux_dir, scan_flux), read(field_dir, scan_vector), read(plasma_dir, scan_plasma), cadence)
    truth = optional_source(spark, lambda: scan_archives(spark, truth_dir, truth_pattern), schemas.TRUTH_SIGNAL)
    return {"training": stage(grid, "training_grid"), "validation": truth}
