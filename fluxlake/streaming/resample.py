"""The grid mean over records that keep arriving.

A bin is emitted once the watermark has passed it. Empty bins do not appear in a streaming aggregate;
``operators.resample.resample_mean`` over the closed bins adds them and changes no value.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.session import fresh_path, settle


def stream_resample(
    records: DataFrame, values: Sequence[str], cadence: timedelta, lateness: timedelta, keys: Sequence[str] = (), ts: str = "ts", unique: Sequence[str] = ()
) -> DataFrame:
    """Mean per bin of a stream, for an append sink; records later than ``lateness`` are dropped.

    With ``unique`` columns, a record that comes again within the watermark counts once.
    """
    settle(records.sparkSession)
    seconds = lambda length: f"{length.total_seconds()} seconds"
    stamped = records.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", seconds(lateness))
    if unique:
        stamped = stamped.dropDuplicatesWithinWatermark(list(unique))
    bins = stamped.groupBy(*keys, F.window("_event_time", seconds(cadence))).agg(*[F.avg(c).alias(c) for c in values])
    return bins.select(*keys, F.col("window.start").cast("timestamp_ntz").alias(ts), *values)


def drain(bins: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Run a stream over all that has arrived, then stop: the rows it gave out, and how many records came too late.

    The sink and the state live in the shared folder, so a run that is stopped can go on where it was.
    """
    spark = bins.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    run = bins.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    late = sum(operator["numRowsDroppedByWatermark"] for step in run.recentProgress for operator in step["stateOperators"])
    return spark.read.schema(bins.schema).parquet(out), late
