"""Robust scaling: centre on the median, divide by the interquartile range."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.quantiles import exact_quantiles
from fluxlake.operators.keyed import attach

PARAM_SCHEMA = "name string, center double, scale double"
_CONSTANT = 10 * sys.float_info.epsilon


@dataclass(frozen=True)
class ScalerParam:
    name: str
    center: float
    scale: float


def robust_params(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., name, center, scale)``; a constant column is scaled by 1."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], keys)
    spread = F.col("q_2") - F.col("q_0")
    return quartiles.select(
        *keys, "name", F.col("q_1").alias("center"), F.when(spread < _CONSTANT, F.lit(1.0)).otherwise(spread).alias("scale")
    )


def collect_params(params: DataFrame) -> list[ScalerParam]:
    """The parameters of an unkeyed scaler: one row per column, so they become literals in the plan."""
    return [ScalerParam(r["name"], r["center"], r["scale"]) for r in params.select("name", "center", "scale").collect()]


def fit_robust_scaler(df: DataFrame, columns: Sequence[str] = tuple(schemas.DRIVERS)) -> list[ScalerParam]:
    return collect_params(robust_params(df, columns))


def apply_scaler(df: DataFrame, params: Sequence[ScalerParam], suffix: str = "_scaled") -> DataFrame:
    return df.withColumns({f"{p.name}{suffix}": (F.col(p.name) - F.lit(p.center)) / F.lit(p.scale) for p in params})


def apply_keyed_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], keys: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Scale every key by its own parameters."""
    pivots = [F.max(F.when(F.col("name") == c, F.col(part))).alias(f"_{part}_{c}") for c in columns for part in ("center", "scale")]
    wide = params.groupBy(*keys).agg(*pivots)
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"_center_{c}")) / F.col(f"_scale_{c}") for c in columns}
    joined = attach(df, wide, keys).withColumns(scaled)
    return joined.drop(*[f"_{part}_{c}" for c in columns for part in ("center", "scale")])


def save_scaler(spark: SparkSession, params: Sequence[ScalerParam], path: str) -> None:
    rows = [(p.name, p.center, p.scale) for p in params]
    spark.createDataFrame(rows, PARAM_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> list[ScalerParam]:
    return collect_params(spark.read.schema(PARAM_SCHEMA).parquet(path))
