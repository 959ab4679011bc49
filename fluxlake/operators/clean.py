"""Row-level cleaning of measurement records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.guards import drop_fill, drop_nonpositive
from fluxlake.functions.quantiles import exact_quantiles
from fluxlake.functions.times import DAY_US, to_micros
from fluxlake.operators.keyed import attach
from fluxlake.session import settle, stage


def clean_flux(df: DataFrame, column: str = "electron_flux") -> DataFrame:
    return df.withColumn(column, drop_nonpositive(drop_fill(column)))


def clean_field(df: DataFrame, columns: Sequence[str] = tuple(schemas.FIELD_COLUMNS)) -> DataFrame:
    return df.withColumns({c: drop_fill(c, two_sided=True) for c in columns})


def clean_plasma(df: DataFrame, columns: Sequence[str] = tuple(schemas.PLASMA_COLUMNS)) -> DataFrame:
    return df.withColumns({c: drop_nonpositive(drop_fill(c, two_sided=True)) for c in columns})


def drop_corrupt_stamps(
    df: DataFrame, now: datetime, file: str = "source_file", ts: str = "ts",
) -> DataFrame:
    """Drop records whose stamp is out of bounds or far from the median stamp of their own file.

    The median is taken over the in-bounds records (over all, for a file that has none) and is exact
    for files of any size. ``now`` is an argument so that a run can be repeated.
    """
    settle(df.sparkSession)
    us = to_micros(ts)
    earliest = to_micros(F.lit(schemas.EARLIEST_STAMP).cast("timestamp_ntz"))
    latest = to_micros(F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")) + F.lit(DAY_US)
    in_bounds = us.between(earliest, latest)
    stamps = df.select(file, us.cast("double").alias("any_us"), F.when(in_bounds, us.cast("double")).alias("good_us"))
    medians = exact_quantiles(stamps, ["any_us", "good_us"], [0.5], [file])
    center = medians.groupBy(file).agg(
        F.coalesce(
            F.max(F.when(F.col("name") == "good_us", F.col("q_0"))),
            F.max(F.when(F.col("name") == "any_us", F.col("q_0"))),
        ).alias("_median_us")
    )
    reach = F.lit(float(schemas.MAX_DAYS_FROM_MEDIAN * DAY_US))
    return (
        attach(df, stage(center, "file_medians"), [file])
        .where(in_bounds & (F.abs(us - F.col("_median_us")) <= reach))
        .select(*df.columns)
    )


def dedup_keep_first(df: DataFrame, order: Sequence[str], ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """One row per stamp: the first in ``order``, even where its values are NULL.

    A minimum over a struct is combined before the shuffle, so a stamp with very many copies is reduced
    where its rows are and never gathered in one task.
    """
    key_columns = [*keys, ts]
    rest = [c for c in df.columns if c not in key_columns and c not in order]
    first = df.groupBy(*key_columns).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in key_columns else F.col(f"_first.{c}").alias(c) for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``columns`` (in any column at all by default)."""
    return df.dropna(subset=list(columns) if columns is not None else None)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of NULL per column, as ``(column_name, null_pct)``, from one pass."""
    rates = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_pct")) for c in columns])
    return rates.select(F.inline(entries))
