"""A ridge regression on all rows of a window, without building windows.

A window of L rows with F inputs is a vector of L * F numbers, of which neighbouring rows share all but F. The normal equations
therefore need no windows: their block for lags j and k sums x[s] x[s-d]' with d = k - j over all rows but a few at either end, so
L blocks of F x F, summed over chunks of rows, and the first and last L - 1 rows give the whole matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.functions.times import whole_div
from fluxlake.operators.position import CHUNK_ROWS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class WindowRidge:
    """Weights per lag and input (lag 0 is the row itself), for inputs as they are."""

    weights: np.ndarray
    intercept: float

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Forecasts for the rows of a series from the ``L``-th on."""
        length, count = len(self.weights), len(rows) - len(self.weights) + 1
        out = np.full(max(count, 0), self.intercept)
        for lag in range(length if count > 0 else 0):
            out += rows[length - 1 - lag:length - 1 - lag + count] @ self.weights[lag]
        return out


def _chunks(rows: DataFrame, groups: Sequence[str], idx: str, back: int, chunk_rows: int) -> DataFrame:
    """Rows with ``_chunk``, each also copied to the following chunks that look back at it."""
    first, last = whole_div(F.col(idx), chunk_rows), whole_div(F.col(idx) + back, chunk_rows)
    return rows.withColumn("_chunk", F.explode(F.sequence(first, last)))


def normal_blocks(rows: DataFrame, length: int, inputs: Sequence[str], target: str, idx: str, center: Sequence[float], scale: Sequence[float], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(lag, cross, with_target, total, n, sum_y)``: per lag, sums over one series of rows at positions 0, 1, 2, ..

    ``cross``: x[s] x[s-lag]' over all s >= lag, row by row; ``with_target`` and ``total``: x[t-lag] y[t] and x[t-lag] over the rows t with a whole
    window, whose number is ``n`` and whose targets' sum is ``sum_y``. ``x`` is centred and scaled. Blocks are added up in each task before they move.
    """
    width, chunk_rows = len(inputs), max(chunk_rows, length)
    center, scale = np.asarray(center, float), np.asarray(scale, float)
    shape = "lag int, cross array<double>, with_target array<double>, total array<double>, n bigint, sum_y double"
    names = ["lag", "cross", "with_target", "total", "n", "sum_y"]

    def blocks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(idx)
        at, y = frame[idx].to_numpy(), frame[target].to_numpy(float)
        x = (frame[list(inputs)].to_numpy(float) - center) / scale
        home = int(np.searchsorted(at, frame["_chunk"].iloc[0] * chunk_rows))
        out = []
        for lag in range(length):
            since = max(home, lag)
            # Rows of a series follow each other without a gap, so a lag is a difference of places.
            cross = x[since:].T @ x[since - lag:len(x) - lag] if since < len(x) else np.zeros((width, width))
            whole = max(home, int(np.searchsorted(at, length - 1)))
            behind, now = x[whole - lag:len(x) - lag], y[whole:]
            if whole >= len(x):
                behind, now = np.zeros((0, width)), y[:0]
            out.append((lag, cross.ravel(), behind.T @ now, behind.sum(axis=0), len(now), now.sum()))
        return pd.DataFrame(out, columns=names)

    def added(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for frame in frames:
            for lag, *parts in frame.itertuples(index=False, name=None):
                parts = [np.asarray(p) if i < 3 else p for i, p in enumerate(parts)]
                sums[lag] = [a + b for a, b in zip(sums[lag], parts)] if lag in sums else parts
        if sums:
            yield pd.DataFrame([(lag, *parts) for lag, parts in sums.items()], columns=names)

    copied = _chunks(rows.select(idx, target, *inputs), (), idx, length - 1, chunk_rows)
    partial = copied.groupBy("_chunk").applyInPandas(blocks, shape).mapInPandas(added, shape)
    return partial.repartition("lag").mapInPandas(added, shape)


def gram(cross: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The window's Gram matrix, ordered by lag and input, from the blocks per lag and the first and last ``L - 1`` rows."""
    length, width = len(cross), cross.shape[1]
    out = np.empty((length, width, length, width))
    for d in range(length):
        # For lags j and j + d: all rows but those before L - 1 - j and the last j.
        block = cross[d].copy()
        for s in range(d, length - 1):
            block -= np.outer(first[s], first[s - d])
        for j in range(length - d):
            out[j, :, j + d, :], out[j + d, :, j, :] = block, block.T
            s = length - 2 - j
            if s >= d:
                block = block + np.outer(first[s], first[s - d])
            if j < length - d - 1:
                # ``last`` ends with the series; the row behind ``d`` others back lies in it as long as j + d < L - 1.
                at = len(last) - 1 - j
                block = block - np.outer(last[at], last[at - d])
    return out.reshape(length * width, length * width)


def fit_ridge(rows: DataFrame, length: int, inputs: Sequence[str], target: str = "y", idx: str = "split_idx", ridge: float = 0.01, chunk_rows: int = CHUNK_ROWS) -> WindowRidge | None:
    """Weights that minimise the squared error of all rows with a whole window, plus ``ridge`` times their number times the squared scaled weights.

    ``rows``: one series, its positions ``idx`` counting from 0 without gaps, inputs and target without NULL. What comes to the driver depends
    on the window alone: one block per lag, and ``2 (L - 1)`` rows. None where no row has a whole window.
    """
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(inputs)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(inputs)]).first()
    count, width = stats["n"], len(inputs)
    if count < length:
        return None
    center = np.array([stats[f"m_{i}"] for i in range(width)])
    scale = np.array([stats[f"s_{i}"] or 1.0 for i in range(width)])
    found = sorted(normal_blocks(rows, length, inputs, target, idx, center, scale, chunk_rows).collect(), key=lambda r: r["lag"])
    edges = rows.where((F.col(idx) < length - 1) | (F.col(idx) >= count - length + 1)).select(idx, *inputs).orderBy(idx).collect()
    value = lambda keep: (np.array([list(r)[1:] for r in edges if keep(r[0])], float).reshape(-1, width) - center) / scale
    first, last = value(lambda i: i < length - 1), value(lambda i: i >= count - length + 1)
    matrix = gram(np.array([r["cross"] for r in found]).reshape(length, width, width), first, last)
    n, mean = found[0]["n"], np.concatenate([r["total"] for r in found]) / found[0]["n"]
    mean_y = found[0]["sum_y"] / n
    matrix = matrix - n * np.outer(mean, mean) + ridge * n * np.eye(len(matrix))
    weights = np.linalg.solve(matrix, np.concatenate([r["with_target"] for r in found]) - n * mean * mean_y)
    intercept = mean_y - mean @ weights
    weights = weights.reshape(length, width) / scale
    return WindowRidge(weights, float(intercept - (weights * center).sum()))


def score_windows(rows: DataFrame, models: Mapping[str, WindowRidge], inputs: Sequence[str], groups: Sequence[str] = ("horizon", "split"), idx: str = "split_idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows with a whole window in their group, with a forecast column per model; all models share one shuffle."""
    names, length = list(models), max(len(m.weights) for m in models.values())
    chunk_rows = max(chunk_rows, length)
    known = rows.sparkSession.sparkContext.broadcast(dict(models))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(idx).reset_index(drop=True)
        home = int(np.searchsorted(frame[idx].to_numpy(), frame["_chunk"].iloc[0] * chunk_rows))
        x = frame[list(inputs)].to_numpy(float)
        out = frame.drop(columns="_chunk")
        for name in names:
            forecast = known.value[name].predict(x)
            out[name] = np.concatenate((np.full(len(x) - len(forecast), np.nan), forecast))
        # A home row has a whole window exactly if so many rows lie before it.
        return out.iloc[max(home, length - 1):]

    copied = _chunks(rows, groups, idx, length - 1, chunk_rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", `{name}` double" for name in names)
    return copied.groupBy(*groups, "_chunk").applyInPandas(score, schema)
