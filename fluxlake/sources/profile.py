"""What is in a table: columns, types, counts, a few values, the period covered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 3


def profile_source(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per column ``(column_name, data_type, n_rows, n_nulls, min_value, max_value, sample)``.

    One aggregate for the counts; the sample comes from the first rows in ``order``, which Spark takes
    per partition before it merges them.
    """
    fields = [f for f in df.schema]
    head = df.orderBy(*order).limit(SAMPLE_ROWS).agg(
        *[F.concat_ws(", ", F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(f.name).cast("string"), F.lit("NULL")).alias("_v"))))["_v"]).alias(f.name) for f in fields]
    ).first()
    stats = []
    for f in fields:
        # Adding zero turns a negative zero into zero.
        c = F.col(f.name) + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        stats.append(
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_nulls"),
                F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"),
                F.lit(head[f.name]).alias("sample"),
            ).alias(f.name)
        )
    return df.agg(*stats).select(F.inline(F.array(*[F.col(f.name) for f in fields])))


def time_coverage(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    ).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))
