"""Tables between the stages: CSV, partitioned datasets, JSON metrics, ordered output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").option("timestampNTZFormat", STAMP_FORMAT).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan; columns are matched to the schema by position and nothing is inferred."""
    return (
        spark.read.schema(schema).option("header", "true").option("enforceSchema", "false")
        .option("timestampNTZFormat", STAMP_FORMAT).csv(path)
    )


def write_sorted(df: DataFrame, path: str, by: Sequence[str], partitions: int | None = None) -> None:
    """Globally ordered files: ranges across files, sorted rows within each."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.parquet(path)


def write_datasets(datasets: DataFrame, inputs: Sequence[str], path: str) -> None:
    """Datasets laid out by horizon and split, and the order of their input columns beside them."""
    ranged = datasets.repartitionByRange("horizon", "split", "row_idx")
    ranged.sortWithinPartitions("horizon", "split", "row_idx").write.partitionBy("horizon", "split").parquet(f"{path}/rows")
    order = [(i, name) for i, name in enumerate(inputs)]
    datasets.sparkSession.createDataFrame(order, "position long, feature string").coalesce(1).write.parquet(f"{path}/features")


def read_datasets(spark: SparkSession, path: str, horizon: str | None = None, split: str | None = None) -> DataFrame:
    """Dataset rows; a horizon or split reads only its own folders."""
    rows = spark.read.parquet(f"{path}/rows")
    if horizon is not None:
        rows = rows.where(F.col("horizon") == horizon)
    return rows if split is None else rows.where(F.col("split") == split)


def read_feature_order(spark: SparkSession, path: str) -> list[str]:
    table = spark.read.schema("position long, feature string").parquet(f"{path}/features")
    return [row["feature"] for row in table.orderBy("position").collect()]


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
