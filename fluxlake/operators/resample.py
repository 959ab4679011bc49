"""Bring irregular signals onto one regular grid whose empty bins are explicit."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.functions.times import DAY_US, bin_number, bin_start, micros_of, to_micros
from fluxlake.session import stage, settle

SPINE_CHUNK = 65_536


def _origin_us(df: DataFrame, ts: str, cadence: timedelta) -> int:
    """Bins start at midnight; that is 1970-aligned unless the width does not divide a day."""
    if DAY_US % micros_of(cadence) == 0:
        return 0
    first = df.agg(F.min(to_micros(ts))).first()[0] or 0
    return first - first % DAY_US


def _spine(bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every bin number between ``lo`` and ``hi``, a bounded array at a time."""
    if not keys:
        lo, hi = bounds.select("lo", "hi").first() or (None, None)
        if lo is None or hi is None or hi < lo:
            return bounds.sparkSession.range(0).withColumnRenamed("id", "bin")
        return bounds.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "bin")
    blocks = bounds.where("hi >= lo").select(
        *keys, "hi", F.explode(F.sequence("lo", "hi", F.lit(SPINE_CHUNK))).alias("start")
    )
    upto = F.least(F.col("hi"), F.col("start") + (SPINE_CHUNK - 1))
    return blocks.select(*keys, F.explode(F.sequence(F.col("start"), upto)).alias("bin"))


def _on_spine(binned: DataFrame, bounds: DataFrame, values: Sequence[str], keys, ts, cadence, origin) -> DataFrame:
    full = _spine(bounds, keys).join(binned, [*keys, "bin"], "left")
    return full.select(*keys, bin_start("bin", cadence, origin).alias(ts), *values)


def resample_mean(
    df: DataFrame, values: Sequence[str], cadence: timedelta, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Mean per bin, with a NULL row for every empty bin between the first and the last one.

    The raw rows are scanned once: bins are averaged (partial sums before the shuffle), staged, and
    only that small table is read again to find the bounds and fill the spine.
    """
    settle(df.sparkSession)
    origin = _origin_us(df, ts, cadence)
    binned = stage(
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, bin_number(ts, cadence, origin).alias("bin"))
        .agg(*[F.avg(c).alias(c) for c in values]),
        "binned",
    )
    bounds = binned.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    return _on_spine(binned, bounds, values, keys, ts, cadence, origin)


def unite_signals(parts: dict[str, tuple[DataFrame, Sequence[str]]], ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Union of signals, each with its own value columns, tagged with the name of its group."""
    united = None
    for tag, (df, columns) in parts.items():
        rows = df.select(*keys, ts, *columns, F.lit(tag).alias("part"))
        united = rows if united is None else united.unionByName(rows, allowMissingColumns=True)
    return united


def merge_signals(
    signals: Sequence[tuple[DataFrame, Sequence[str]]], cadence: timedelta, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Full outer join of resampled signals on the bin, dense over the union of their periods.

    Resampling the union gives that join in one aggregate: a bin only one signal reaches has NULL in
    the other's columns.
    """
    values = list(dict.fromkeys(c for _, columns in signals for c in columns))
    united = unite_signals({str(i): signal for i, signal in enumerate(signals)}, ts, keys)
    return resample_mean(united, values, cadence, keys, ts)


def align_records(
    records: DataFrame,
    values: Sequence[str],
    cadence: timedelta,
    target: str = "target",
    keys: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Inner join of the target's grid with the grid of everything else, from tagged records.

    Both grids are dense, so the join is the overlap of their periods: one aggregate with bounds per
    side replaces two resamples, an outer and an inner join.
    """
    settle(records.sparkSession)
    origin = _origin_us(records, ts, cadence)
    of_target = F.col("part") == target
    binned = stage(
        records.where(F.col(ts).isNotNull())
        .groupBy(*keys, bin_number(ts, cadence, origin).alias("bin"))
        .agg(
            *[F.avg(c).alias(c) for c in values],
            F.count_if(of_target).alias("_target"),
            F.count_if(~of_target).alias("_driver"),
        ),
        "binned",
    )
    target_bin, driver_bin = F.when(F.col("_target") > 0, F.col("bin")), F.when(F.col("_driver") > 0, F.col("bin"))
    bounds = (
        binned.groupBy(*keys)
        .agg(
            F.min(target_bin).alias("t0"), F.max(target_bin).alias("t1"),
            F.min(driver_bin).alias("d0"), F.max(driver_bin).alias("d1"),
        )
        .dropna(subset=["t0", "d0"])
        .select(*keys, F.greatest("t0", "d0").alias("lo"), F.least("t1", "d1").alias("hi"))
    )
    return _on_spine(binned, bounds, values, keys, ts, cadence, origin)


def align_grid(
    target: tuple[DataFrame, Sequence[str]],
    drivers: Sequence[tuple[DataFrame, Sequence[str]]],
    cadence: timedelta,
    keys: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """``align_records`` for signals that come from separate tables."""
    parts = {"target": target, **{f"driver{i}": signal for i, signal in enumerate(drivers)}}
    values = list(dict.fromkeys(c for _, columns in parts.values() for c in columns))
    return align_records(unite_signals(parts, ts, keys), values, cadence, "target", keys, ts)
