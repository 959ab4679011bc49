"""Windowed columns over one time series: despiking, gap filling, lags, rolling statistics, EMA.

Each operator exists as a function of ``(rows, window)`` for ``position.over_chunks``, so that a plan can
stack several behind one shuffle, and as a stand-alone DataFrame operator. Frames count rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.functions.times import whole_div
from fluxlake.operators.position import BUCKET_BINS, CHUNK_ROWS, over_chunks
from fluxlake.operators.scan import carried
from fluxlake.session import stage

EMA_BLOCK = 512


# ---- centred median and spikes -------------------------------------------------------------------


def centred_reach(size: int) -> tuple[int, int]:
    """Rows before and after the row in a centred frame; an even frame leans back by one."""
    ahead = (size - 1) // 2
    return size - 1 - ahead, ahead


def _centred_median(column: str, window: WindowSpec, size: int) -> Column:
    back, ahead = centred_reach(size)
    frame = window.rowsBetween(-back, ahead)
    return F.when(F.count(column).over(frame) >= max(1, size // 2), F.percentile(column, F.lit(0.5)).over(frame))


def add_spike_columns(
    rows: DataFrame, window: WindowSpec, column: str, size: int = schemas.SPIKE_WINDOW,
    threshold: float = schemas.SPIKE_THRESHOLD,
) -> DataFrame:
    """``_median``, ``_deviation``, ``_mad`` and ``_spike``.

    The deviation of a row is from its own rolling median; the rolling median of those deviations then
    gives the scale. A zero scale flags any deviation at all.
    """
    rows = rows.withColumn("_median", _centred_median(column, window, size))
    rows = rows.withColumn("_deviation", F.abs(F.col(column) - F.col("_median")))
    rows = rows.withColumn("_mad", _centred_median("_deviation", window, size))
    limit = F.lit(float(threshold)) * (F.col("_mad") * F.lit(schemas.MAD_TO_SIGMA))
    return rows.withColumn("_spike", F.coalesce(F.col("_deviation") > limit, F.lit(False)))


def spike_reach(size: int) -> tuple[int, int]:
    back, ahead = centred_reach(size)
    return 2 * back, 2 * ahead


def rolling_median(df: DataFrame, column: str, size: int = schemas.SPIKE_WINDOW, keys: Sequence[str] = ()) -> DataFrame:
    back, ahead = centred_reach(size)
    return over_chunks(
        df, lambda rows, window: rows.withColumn("rolling_median", _centred_median(column, window, size)),
        back, ahead, keys,
    )


def flag_spikes(
    df: DataFrame, column: str, size: int = schemas.SPIKE_WINDOW, threshold: float = schemas.SPIKE_THRESHOLD,
    keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Spike diagnostics per row: ``rolling_median, abs_dev, rolling_mad, is_spike``."""
    flagged = over_chunks(
        df, lambda rows, window: add_spike_columns(rows, window, column, size, threshold),
        *spike_reach(size), keys, chunk_rows=chunk_rows,
    )
    return flagged.withColumnsRenamed(
        {"_median": "rolling_median", "_deviation": "abs_dev", "_mad": "rolling_mad", "_spike": "is_spike"}
    )


def null_spikes(rows: DataFrame, window: WindowSpec, column: str, size: int, threshold: float) -> DataFrame:
    rows = add_spike_columns(rows, window, column, size, threshold)
    return rows.withColumn(column, F.when(~F.col("_spike"), F.col(column))).drop("_median", "_deviation", "_mad", "_spike")


def remove_spikes(
    df: DataFrame, column: str, size: int = schemas.SPIKE_WINDOW, threshold: float = schemas.SPIKE_THRESHOLD,
    keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Replace spikes by NULL."""
    return over_chunks(
        df, lambda rows, window: null_spikes(rows, window, column, size, threshold),
        *spike_reach(size), keys, chunk_rows=chunk_rows,
    )


# ---- gaps ------------------------------------------------------------------------------------------


def fill_gaps(rows: DataFrame, window: WindowSpec, columns: Sequence[str], max_gap: int, idx: str = "row_idx") -> DataFrame:
    """Linear interpolation of NULL runs of at most ``max_gap`` rows; longer runs stay NULL whole.

    Looking ``max_gap`` rows either way settles it: if both neighbours are in reach the run length
    follows from their positions, and a run that touches the first or last row takes the one value it has.
    """
    before, after = window.rowsBetween(-max_gap, -1), window.rowsBetween(1, max_gap)
    seen = {"_rows_after": F.count(F.lit(1)).over(after)}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(c).cast("double").alias("v")))
        seen[f"_prev_{c}"] = F.last(at, ignorenulls=True).over(before)
        seen[f"_next_{c}"] = F.first(at, ignorenulls=True).over(after)
    rows = rows.withColumns(seen)
    here, end = F.col(idx), F.col(idx) + F.col("_rows_after")
    filled = {}
    for c in columns:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        slope = (nxt["v"] - prev["v"]) / (nxt["i"] - prev["i"])
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNotNull() & nxt.isNotNull() & (nxt["i"] - prev["i"] - 1 <= max_gap),
                  slope * (here - prev["i"]) + prev["v"])
            .when(prev.isNull() & nxt.isNotNull() & (here < max_gap) & (nxt["i"] <= max_gap), nxt["v"])
            .when(nxt.isNull() & prev.isNotNull() & (F.col("_rows_after") < max_gap) & (end - prev["i"] <= max_gap),
                  prev["v"])
        )
    return rows.withColumns(filled).drop("_rows_after", *[f"_{side}_{c}" for side in ("prev", "next") for c in columns])


def interpolate_gaps(
    df: DataFrame, columns: Sequence[str], max_gap: int = schemas.MAX_GAP, keys: Sequence[str] = (),
    drop_unfilled: bool = True, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Fill short gaps, then drop the rows of longer ones (or keep them as NULL)."""
    filled = over_chunks(
        df, lambda rows, window: fill_gaps(rows, window, columns, max_gap), max_gap, max_gap, keys, chunk_rows=chunk_rows
    )
    return filled.dropna(subset=list(columns)) if drop_unfilled else filled


def null_runs(df: DataFrame, column: str, keys: Sequence[str] = (), idx: str = "row_idx", chunk_rows: int = BUCKET_BINS) -> DataFrame:
    """Every maximal run of NULLs as ``(keys.., first_idx, last_idx, run_length)``, of any length.

    Runs are found per chunk. How long a run was when a chunk began is a carry that a chunk of NULLs alone goes on with and any other
    sets anew; it is scanned in levels. A run is given out where it ends.
    """
    chunked = df.select(*keys, idx, F.col(column).isNull().alias("gap")).withColumn("_chunk", whole_div(F.col(idx), chunk_rows))
    running = W.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    islands = chunked.withColumn("_island", F.count_if(~F.col("gap")).over(running)).where("gap")
    pieces = islands.groupBy(*keys, "_chunk", "_island").agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"))
    begins = F.col("first_idx") == F.col("_chunk") * chunk_rows
    goes_on = F.col("last_idx") == (F.col("_chunk") + 1) * chunk_rows - 1
    pieces = stage(pieces.select(*keys, "_chunk", "first_idx", "last_idx", begins.alias("_begins"), goes_on.alias("_goes_on")), "null_pieces")
    open_ends = pieces.where("_goes_on").select(
        *keys, "_chunk", F.col("_begins").cast("int").alias("_keeps"), (F.col("last_idx") - F.col("first_idx") + 1).alias("_adds"),
    )
    # A chunk behind one without an open run starts from nothing; it needs an element so that its own is not reached by an older run.
    chunks = stage(
        chunked.select(*keys, "_chunk").distinct().join(open_ends, [*keys, "_chunk"], "left").na.fill(0, ["_keeps", "_adds"]), "null_chunks"
    )
    before = carried(chunks, {"_before": ("_keeps", "_adds")}, "_chunk", keys)
    continued = pieces.where("_begins").select(*keys, (F.col("_chunk") - 1).alias("_chunk"), F.lit(True).alias("_continued"))
    last = pieces.join(continued, [*keys, "_chunk"], "left").where(~(F.col("_goes_on") & F.coalesce("_continued", F.lit(False))))
    whole = last.join(before, [*keys, "_chunk"])
    first = F.col("first_idx") - F.when(F.col("_begins"), F.col("_before").cast("bigint")).otherwise(F.lit(0))
    return whole.select(*keys, first.alias("first_idx"), "last_idx", (F.col("last_idx") - first + 1).alias("run_length"))


# ---- lags, differences, rolling statistics ---------------------------------------------------------


def lag_expressions(column: str, window: WindowSpec, steps: Sequence[int] = schemas.LAG_STEPS, prefix: str = "log_flux") -> dict[str, Column]:
    return {f"{prefix}_lag_{k}": F.lag(column, k).over(window) for k in steps}


def rolling_expressions(
    column: str, window: WindowSpec, sizes: Sequence[int] = schemas.ROLLING_WINDOWS, prefix: str = "log_flux"
) -> dict[str, Column]:
    """Mean, sample deviation, maximum and minimum over full trailing windows; NULL before that."""
    columns = {}
    for k in sizes:
        frame = window.rowsBetween(-(k - 1), 0)
        full = F.count(column).over(frame) == k
        for stat, function in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            columns[f"{prefix}_roll_{stat}_{k}"] = F.when(full, function(column).over(frame))
    return columns


def difference_expressions(sources: dict[str, str], window: WindowSpec) -> dict[str, Column]:
    """``{name: column}`` to the change of each column since the row before."""
    return {name: F.col(c) - F.lag(c, 1).over(window) for name, c in sources.items()}


def lag_features(df: DataFrame, column: str, steps: Sequence[int] = schemas.LAG_STEPS, prefix: str = "log_flux", keys: Sequence[str] = ()) -> DataFrame:
    return over_chunks(df, lambda rows, w: rows.withColumns(lag_expressions(column, w, steps, prefix)), max(steps), 0, keys)


def rolling_stats(
    df: DataFrame, column: str, sizes: Sequence[int] = schemas.ROLLING_WINDOWS, prefix: str = "log_flux",
    keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    return over_chunks(
        df, lambda rows, w: rows.withColumns(rolling_expressions(column, w, sizes, prefix)), max(sizes) - 1, 0, keys,
        chunk_rows=chunk_rows,
    )


def delta_features(df: DataFrame, sources: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    return over_chunks(df, lambda rows, w: rows.withColumns(difference_expressions(sources, w)), 1, 0, keys)


# ---- exponential moving average --------------------------------------------------------------------


def ema_decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _starts(ends: DataFrame, spans: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """``(keys.., _block, _start_<span>..)``: the average that each block starts from, given what each adds by its end."""
    steps = {f"_start_{s}": (f"_decay_{s}", f"_end_{s}") for s in spans}
    ends = ends.withColumns({f"_decay_{s}": F.lit(ema_decay(s) ** EMA_BLOCK) for s in spans})
    return carried(stage(ends, "ema_ends"), steps, "_block", keys)


def ema_features(
    df: DataFrame, column: str, spans: Sequence[int] = schemas.ROLLING_WINDOWS, prefix: str = "log_flux",
    keys: Sequence[str] = (), idx: str = "row_idx",
) -> DataFrame:
    """The recursion ``e = a*x + (1-a)*e_before`` seeded with the first value, over the whole history of a row.

    Within a block of 512 rows the recursion is a weighted running sum; the value that a block starts from is folded
    exactly from the ends of all blocks before it. ``column`` must have no NULL, and positions no gap. ``df`` is staged
    once with the running sums, as the block ends and the result both read them.
    """
    inner = [s for s in spans if s > 1]
    result = {f"{prefix}_ema_{s}": F.col(column).cast("double") for s in spans if s == 1}
    if not inner:
        return df.withColumns(result)
    rows = df.withColumns({"_block": whole_div(F.col(idx), EMA_BLOCK), "_place": F.pmod(F.col(idx), F.lit(EMA_BLOCK))})
    window = W.partitionBy(*keys, "_block").orderBy(idx)
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    local = {}
    for s in inner:
        d, weight = F.lit(ema_decay(s)), F.when(F.col(idx) == 0, F.lit(1.0)).otherwise(F.lit(2.0 / (s + 1.0)))
        local[f"_local_{s}"] = F.pow(d, F.col("_place")) * F.sum(weight * F.col(column) * F.pow(d, -F.col("_place"))).over(upto)
    rows = stage(rows.withColumns(local), "ema_blocks")
    ends = rows.groupBy(*keys, "_block").agg(*[F.max_by(f"_local_{s}", "_place").alias(f"_end_{s}") for s in inner])
    starts = _starts(ends, inner, keys)
    for s in inner:
        result[f"{prefix}_ema_{s}"] = F.col(f"_local_{s}") + F.pow(F.lit(ema_decay(s)), F.col("_place") + 1) * F.col(f"_start_{s}")
    names = ["_block", "_place", *local, *[f"_start_{s}" for s in inner]]
    return rows.join(starts, [*keys, "_block"]).withColumns(result).drop(*names)
