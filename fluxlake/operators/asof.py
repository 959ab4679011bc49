"""Nearest as-of join within a tolerance, without comparing pairs of rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlake.functions.times import micros_of, to_micros, whole_div
from fluxlake.operators.keyed import attach_salted
from fluxlake.session import settle

CELLS_PER_TOLERANCE = 64
# Slices of the left rows of a stamp; matches, one per stamp, are repeated as often.
HOT_STAMP_SLICES = 4


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    tolerance: timedelta,
    left_ts: str = "ts",
    right_ts: str = "ts",
    keys: Sequence[str] = (),
    matched_ts: str = "matched_ts",
    cells_per_tolerance: int = CELLS_PER_TOLERANCE,
) -> DataFrame:
    """Inner nearest-time join: each left row with ``values`` of the closest right row.

    The tolerance is inclusive, a tie goes to the earlier right row and unmatched left rows are
    dropped. ``right`` should hold one row per key and stamp; the smallest is taken if it does not.

    Both sides are first reduced to distinct stamps. Stamps are then ordered inside cells far narrower
    than the tolerance (a cell of w microseconds cannot hold more than w stamps per side, however the
    data is spread), and what a cell cannot see is carried over from one summary row per cell.
    """
    settle(left.sparkSession)
    width = max(1, micros_of(tolerance) // cells_per_tolerance)
    reach = micros_of(tolerance) // width + 1
    group = [*keys, "cell"]

    payload = F.struct(*[F.col(c) for c in values])
    known = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, to_micros(right_ts).alias("us"), right_ts).agg(F.min(payload).alias("v"))
    known = known.select(*keys, "us", F.struct("us", F.col(right_ts).alias("t"), "v").alias("r"))
    asked = left.where(F.col(left_ts).isNotNull()).select(*keys, to_micros(left_ts).alias("us")).distinct()
    stamps = (
        asked.withColumn("asked", F.lit(True))
        .unionByName(known.withColumn("asked", F.lit(False)), allowMissingColumns=True)
        .withColumn("cell", whole_div(F.col("us"), width))
    )

    upward = W.partitionBy(*group).orderBy(F.col("us"), F.col("asked")).rowsBetween(W.unboundedPreceding, 0)
    downward = W.partitionBy(*group).orderBy(F.col("us").desc(), F.col("asked")).rowsBetween(W.unboundedPreceding, 0)
    in_cell = stamps.withColumns(
        {"before": F.last("r", ignorenulls=True).over(upward), "after": F.last("r", ignorenulls=True).over(downward)}
    ).where("asked").select(*group, "us", "before", "after")

    cells = stamps.groupBy(*group).agg(
        F.min_by("r", F.when(F.col("r").isNotNull(), F.col("us"))).alias("first_r"),
        F.max_by("r", F.when(F.col("r").isNotNull(), F.col("us"))).alias("last_r"),
        F.bool_or("asked").alias("asked"),
    )
    block = whole_div(F.col("cell"), reach)
    spread = cells.withColumn("home", block).withColumn(
        "block",
        F.explode(F.when(F.col("last_r").isNotNull(), F.array(block - 1, block, block + 1)).otherwise(F.array(block))),
    )
    forward = W.partitionBy(*keys, "block").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    backward = W.partitionBy(*keys, "block").orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = spread.withColumns(
        {
            "carry_before": F.last("last_r", ignorenulls=True).over(forward),
            "carry_after": F.last("first_r", ignorenulls=True).over(backward),
        }
    ).where("asked AND block = home").select(*group, "carry_before", "carry_after")

    near = in_cell.join(carried, group)
    before, after = F.coalesce("before", "carry_before"), F.coalesce("after", "carry_after")
    candidates = near.select(*keys, "us", before.alias("before"), after.alias("after"))
    gap_before, gap_after = F.col("us") - F.col("before.us"), F.col("after.us") - F.col("us")
    take_before = F.coalesce(gap_before <= gap_after, gap_after.isNull())
    best = candidates.withColumn("best", F.when(take_before, F.col("before")).otherwise(F.col("after")))
    matches = best.where(F.abs(F.col("best.us") - F.col("us")) <= F.lit(micros_of(tolerance))).select(
        *keys, F.col("us").alias("_us"), F.col("best.t").alias(matched_ts), *[F.col(f"best.v.{c}").alias(c) for c in values]
    )
    # Many left rows may share one stamp, so they are dealt to slices; unmatched rows go with the inner join.
    return attach_salted(left.withColumn("_us", to_micros(left_ts)), matches, [*keys, "_us"], HOT_STAMP_SLICES).drop("_us")
