"""Dense row positions, and windows over one long series that run in many tasks.

Frames count rows, so every row needs its position; ``row_number`` over an unkeyed series would put it
all in one task. Positions come from row counts per time bucket instead, and bounded windows run over
chunks of consecutive rows to which the neighbouring rows a frame can reach have been copied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlake.functions.times import micros_of, to_micros, whole_div
from fluxlake.operators.scan import carried
from fluxlake.session import stage

BUCKET_BINS = 262_144
CHUNK_ROWS = 4_096


def with_row_index(
    df: DataFrame,
    cadence: timedelta,
    keys: Sequence[str] = (),
    ts: str = "ts",
    name: str = "row_idx",
    bucket_bins: int = BUCKET_BINS,
) -> DataFrame:
    """Add the 0-based position of each row in time order, per key.

    ``ts`` must be unique per key with stamps on a grid of ``cadence``, so that a bucket holds at most
    ``bucket_bins`` rows whatever the data looks like. Bucket counts are summed up by a scan in levels, in
    which no task sees more than a fan-out of buckets. Counts are exact up to 2**53 rows.
    ``df`` is read twice: pass a staged table when it is costly to compute.
    """
    width = micros_of(cadence) * bucket_bins
    bucketed = df.withColumn("_bucket", whole_div(to_micros(ts), width))
    counts = stage(bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows")).withColumn("_one", F.lit(1)), "bucket_counts")
    offsets = carried(counts, {"_offset": ("_one", "_rows")}, "_bucket", keys).withColumn("_offset", F.col("_offset").cast("bigint"))
    within = W.partitionBy(*keys, "_bucket").orderBy(ts)
    return (
        bucketed.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_bucket", "_offset")
    )


def over_chunks(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = (),
    idx: str = "row_idx",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run windowed columns over chunks of rows with a halo.

    ``build(rows, window)`` adds columns with frames on ``window``; it may stack several, as long as
    together they reach at most ``back`` rows before and ``ahead`` rows after a row. The result equals
    the same windows over the whole series. One shuffle serves everything ``build`` does.
    """
    home = whole_div(F.col(idx), chunk_rows)
    first = whole_div(F.greatest(F.col(idx) - ahead, F.lit(0)), chunk_rows)
    last = whole_div(F.col(idx) + back, chunk_rows)
    copied = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    window = W.partitionBy(*keys, "_chunk").orderBy(idx)
    return build(copied, window).where(F.col("_chunk") == home).drop("_chunk")
