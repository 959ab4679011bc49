"""Supervised datasets for several forecast horizons, split in time order."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.times import whole_div
from fluxlake.operators.position import CHUNK_ROWS, over_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def horizon_column(name: Column | str, values: Mapping[str, float]) -> Column:
    """Look a horizon up in a small mapping, as an expression (no join); what it doesn't hold is NULL."""
    if not values:
        return F.lit(None).cast("double")
    key = F.col(name) if isinstance(name, str) else name
    pairs = [part for horizon, value in values.items() for part in (F.lit(horizon), F.lit(value))]
    return F.create_map(*pairs)[key]


def add_targets(
    df: DataFrame, column: str = schemas.LOG_TARGET, horizons: Mapping[str, int] = schemas.HORIZON_STEPS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``y_<horizon>``: the value that many rows ahead, all horizons in one pass."""
    leads = lambda rows, window: rows.withColumns({f"y_{h}": F.lead(column, k).over(window) for h, k in horizons.items()})
    return over_chunks(df, leads, 0, max(horizons.values()), keys, chunk_rows=max(CHUNK_ROWS, *horizons.values()))


def horizon_rows(df: DataFrame, horizons: Mapping[str, int] = schemas.HORIZON_STEPS) -> DataFrame:
    """One row per input row and horizon that has a target, as columns ``horizon, steps, y``."""
    options = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(k).cast("bigint").alias("steps"), F.col(f"y_{h}").alias("y"))
        for h, k in horizons.items()
    ])
    rest = [c for c in df.columns if c not in {f"y_{h}" for h in horizons}]
    return df.select(*rest, F.inline(options)).where("y IS NOT NULL")


def split_label(idx: Column, rows: Column, train: float = schemas.TRAIN_FRACTION, validation: float = schemas.VALIDATION_FRACTION) -> Column:
    """Chronological split of ``rows`` rows: the cut points are truncated to whole rows."""
    train_end = F.floor(rows * F.lit(train))
    validation_end = F.floor(rows * F.lit(train + validation))
    return F.when(idx < train_end, "train").when(idx < validation_end, "val").otherwise("test")


def split_start(split: Column, rows: Column, train: float = schemas.TRAIN_FRACTION, validation: float = schemas.VALIDATION_FRACTION) -> Column:
    return (
        F.when(split == "train", F.lit(0))
        .when(split == "val", F.floor(rows * F.lit(train)))
        .otherwise(F.floor(rows * F.lit(train + validation)))
        .cast("bigint")
    )


def chrono_split(df: DataFrame, total_rows: int, idx: str = "row_idx") -> DataFrame:
    """Add ``split`` and ``split_idx`` (position inside the split) to horizon rows.

    The last ``steps`` rows of a horizon have no target, so it has ``total_rows - steps`` rows, and a
    row's position among them is its position in the table.
    """
    rows = F.lit(total_rows).cast("bigint") - F.col("steps")
    labelled = df.withColumn("split", split_label(F.col(idx), rows))
    return labelled.withColumn("split_idx", F.col(idx) - split_start(F.col("split"), rows))


def build_datasets(
    features: DataFrame, total_rows: int, horizons: Mapping[str, int] = schemas.HORIZON_STEPS,
    inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS), target: str = schemas.LOG_TARGET,
) -> DataFrame:
    """``(ts, row_idx, inputs.., horizon, steps, y, split, split_idx)`` for all horizons in one plan."""
    columns = list(dict.fromkeys(["ts", "row_idx", *inputs, target]))
    rows = horizon_rows(add_targets(features.select(*columns), target, horizons), horizons)
    return chrono_split(rows.select("ts", "row_idx", *inputs, "horizon", "steps", "y"), total_rows)


def sequence_windows(
    datasets: DataFrame, length: int, inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS),
    groups: Sequence[str] = ("horizon", "split"), idx: str = "split_idx",
) -> DataFrame:
    """The ``length`` latest rows as ``ARRAY<ARRAY<FLOAT>>``, for rows that have that much history.

    Every row repeats ``length`` rows of input, so use it at a sink or on a filtered table; ``sequence_chunks`` holds the same windows once.
    """
    row = F.array(*[F.col(c).cast("float") for c in inputs])

    def build(rows, window):
        frame = window.rowsBetween(-(length - 1), 0)
        return rows.withColumn("sequence", F.collect_list(row).over(frame))

    built = over_chunks(datasets, build, length - 1, 0, groups, idx, max(CHUNK_ROWS, length))
    return built.where(F.size("sequence") == length)


def sequence_chunks(
    datasets: DataFrame, length: int, inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS),
    groups: Sequence[str] = ("horizon", "split"), idx: str = "split_idx", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(groups.., first_idx, n_rows, values)``: consecutive rows, flat, of which every run of ``length`` is a window.

    A chunk also holds the ``length - 1`` rows before its own, so each window lies in exactly one chunk and all chunks together have at most
    twice the rows of the input, whatever the length. ``values`` has ``n_rows`` times the inputs, row by row, as floats. Positions
    count from 0 without gaps in each group; NULL inputs stay; a group with fewer rows than a window has none.
    """
    chunk_rows = max(chunk_rows, length)
    home = whole_div(F.col(idx), chunk_rows)
    last = F.least(whole_div(F.col(idx) + (length - 1), chunk_rows), home + 1)
    copied = datasets.withColumn("_chunk", F.explode(F.sequence(home, last)))
    row = F.struct(F.col(idx).cast("bigint").alias("at"), F.array(*[F.col(c).cast("float") for c in inputs]).alias("x"))
    rows = F.array_sort(F.collect_list(row))
    built = copied.groupBy(*groups, "_chunk").agg(rows.alias("rows")).where(F.size("rows") >= length)
    return built.select(*groups, F.col("rows")[0]["at"].alias("first_idx"), F.size("rows").alias("n_rows"), F.flatten(F.col("rows.x")).alias("values"))


def map_windows(
    chunks: DataFrame, length: int, apply: Callable[[np.ndarray], Mapping[str, np.ndarray]], columns: str,
    groups: Sequence[str] = ("horizon", "split"), idx: str = "split_idx",
) -> DataFrame:
    """``(groups.., idx, columns..)``: what ``apply`` makes of the windows of ``sequence_chunks``, at each window's last row.

    ``apply`` gets all windows of a chunk as one array (window, row, input) that shares the chunk's memory, NULL as NaN; it must not change it.
    ``columns`` declares what it returns.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for *group, first, n_rows, values in frame[[*groups, "first_idx", "n_rows", "values"]].itertuples(index=False, name=None):
                tensor = np.asarray(values, dtype=np.float32).reshape(n_rows, -1)
                views = np.lib.stride_tricks.sliding_window_view(tensor, length, axis=0).transpose(0, 2, 1)
                yield pd.DataFrame({**dict(zip(groups, group)), idx: first + length - 1 + np.arange(len(views)), **apply(views)})

    kept = "".join(f"`{g}` {chunks.schema[g].dataType.simpleString()}, " for g in groups)
    return chunks.mapInPandas(run, f"{kept}`{idx}` bigint, {columns}")


def summarise_windows(
    datasets: DataFrame, length: int, inputs: Sequence[str] = tuple(schemas.MODEL_INPUTS),
    groups: Sequence[str] = ("horizon", "split"), idx: str = "split_idx",
) -> DataFrame:
    """Mean and net change of each input over the ``length`` latest rows, without building them.

    Differences of running sums inside a chunk make the cost per row independent of ``length``.
    ``inputs`` must have no NULL.
    """

    def build(rows, window):
        running = window.rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumns({f"{c}__sum": F.sum(c).over(running) for c in inputs})
        columns = {"_full": F.lag(idx, length - 1).over(window).isNotNull()}
        for c in inputs:
            before = F.coalesce(F.lag(f"{c}__sum", length).over(window), F.lit(0.0))
            columns[f"{c}__mean"] = (F.col(f"{c}__sum") - before) / F.lit(float(length))
            columns[f"{c}__change"] = F.col(c) - F.lag(c, length - 1).over(window)
        return rows.withColumns(columns).drop(*[f"{c}__sum" for c in inputs])

    # One more row back than the window, so that the sum before its first row is there.
    built = over_chunks(datasets, build, length, 0, groups, idx, max(CHUNK_ROWS, length))
    return built.where("_full").drop("_full")
