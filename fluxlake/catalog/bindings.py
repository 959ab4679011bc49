"""The driver's tables seen as instrument signals.

``events`` is split over six channels by ``user_id``: target flux, three field components, speed and
density. Records of one kind on the target channel act as the independent instrument. Every record is
used. Grid step and sequence length are the same for tables of any size.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.catalog.derived import source_file
from fluxlake.functions.guards import drop_nonpositive
from fluxlake.operators.position import with_row_index
from fluxlake.operators.resample import align_records
from fluxlake.operators.scaling import ScalerParam, apply_scaler, fit_robust_scaler
from fluxlake.plans.datasets import horizon_datasets
from fluxlake.plans.features import feature_table
from fluxlake.plans.prepare import clean_series
from fluxlake.session import stage, settle

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string"
)
NOW = datetime(2024, 2, 1)
# Grid step, a step short enough for many empty bins and long gaps, and rows per input sequence (a day).
CADENCE = timedelta(hours=2)
FINE_CADENCE = timedelta(minutes=20)
SEQUENCE_LENGTH = 12
# Rows per sequence on the short grid: as many as a day has five-minute steps.
LONG_SEQUENCE = 288

_kept: dict[tuple[str, str, str], object] = {}


def keep(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Stage tables are written once per application and input folder, then shared by all queries."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    """Make the next query build its stages again."""
    _kept.clear()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")


# Distance scaled with the grid step, so that delays stay near 14 rows.
DELTA_KM = schemas.DELTA_X_KM * (CADENCE.total_seconds() / 60.0) / 5.0


def _channel() -> Column:
    """Channel of a record; one without a user counts as user 0."""
    return F.pmod(F.coalesce("user_id", F.lit(0)), F.lit(6))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All training records from one scan: tagged, with one value column set per record."""
    channel, value = _channel(), F.col("value")
    part = F.when((channel == 0) & ~F.col("event_type").eqNullSafe("signup"), "target").when(channel > 0, "driver")
    rows = events(spark, sf_dir).select(
        "ts", part.alias("part"),
        F.when(channel == 0, drop_nonpositive(value)).alias(schemas.TARGET),
        F.when(channel == 1, value - 50).alias("Bx"),
        F.when(channel == 2, value - 50).alias("By"),
        F.when(channel == 3, value - 50).alias("Bz"),
        F.when(channel == 4, value + 300).alias("solar_wind_speed"),
        F.when(channel == 5, drop_nonpositive(value / 10)).alias("plasma_density"),
    )
    return rows.where("part IS NOT NULL")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The independent instrument: native stamps, never on the grid."""
    return events(spark, sf_dir).where((_channel() == 0) & (F.col("event_type") == "signup")).select(
        "ts", drop_nonpositive("value").alias("electron_flux")
    )


def instrument_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The training records as three instruments write them: target flux, field vector, speed and density, with file and place."""
    channel, value, rows = _channel(), F.col("value"), events(spark, sf_dir)
    place = [F.col("ts").alias("Epoch"), source_file().alias("source_file"), F.col("event_id").alias("ordinal")]
    only = lambda number, reading: F.when(channel == number, reading)
    return {
        "flux": rows.where((channel == 0) & ~F.col("event_type").eqNullSafe("signup")).select(*place, F.array(value, value / 2).alias("E2W_COR_FLUX")),
        "field": rows.where(channel.between(1, 3)).select(*place, F.array(*[only(i, value - 50) for i in (1, 2, 3)]).alias("BGSE")),
        "plasma": rows.where(channel > 3).select(*place, only(4, value + 300).alias(schemas.SPEED_NAMES[0]), only(5, value / 10).alias("Np")),
    }


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: stage(align_records(records(spark, sf_dir), schemas.GRID_COLUMNS, CADENCE), "grid")
    return keep(spark, sf_dir, "grid", build)


def fine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid at the short step, with row positions."""

    def build():
        rows = stage(align_records(records(spark, sf_dir), schemas.GRID_COLUMNS, FINE_CADENCE), "fine_grid")
        return with_row_index(rows, FINE_CADENCE)

    return keep(spark, sf_dir, "fine_grid", build)


def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows with a target, with row positions."""
    known = grid(spark, sf_dir).where(F.col(schemas.TARGET).isNotNull())
    return with_row_index(known, CADENCE)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "series", lambda: stage(clean_series(grid(spark, sf_dir), CADENCE), "series"))


def scaler(spark: SparkSession, sf_dir: str) -> list[ScalerParam]:
    return keep(spark, sf_dir, "scaler", lambda: fit_robust_scaler(series(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_scaler(series(spark, sf_dir), scaler(spark, sf_dir))


def prepared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared series with row positions."""
    return with_row_index(prepared(spark, sf_dir), CADENCE)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        table = feature_table(prepared(spark, sf_dir), CADENCE, DELTA_KM)
        return stage(table, "features")

    return keep(spark, sf_dir, "features", build)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_index(features(spark, sf_dir), CADENCE)


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(
        spark, sf_dir, "datasets", lambda: stage(horizon_datasets(features(spark, sf_dir), CADENCE), "datasets")
    )


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows with two fixed forecasts in place of the learners', and persistence."""
    return datasets(spark, sf_dir).withColumns(
        {
            "tree_pred": F.col("log_flux_lag_1"),
            "sequence_pred": F.col("log_flux_roll_mean_6"),
            "persistence_pred": F.col(schemas.LOG_TARGET),
        }
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second binding: log order totals per day for every priority: a series per key."""
    return orders(spark, sf_dir).groupBy("o_orderpriority", F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.log10(F.sum("o_totalprice")).alias("total")
    )
