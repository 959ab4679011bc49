"""Decoded instrument records: tables whose variable names and shapes differ from file to file."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake import schemas
from fluxlake.functions.guards import nan_to_null, require, vector_length
from fluxlake.sources.folders import open_folder
from fluxlake.operators.clean import clean_field, clean_flux, clean_plasma, dedup_keep_first

SCHEMA_THREADS = 16


def resolve_column(available: Sequence[str], candidates: Sequence[str], label: str, override: str | None = None) -> str:
    """The first candidate that exists; ``override`` skips the search."""
    if override is not None:
        return override
    for name in candidates:
        if name in available:
            return name
    raise ValueError(f"no {label} variable: none of {list(candidates)} in {sorted(available)}")


def _is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("source_file", "ordinal") if c in df.columns]


def _stamp(df: DataFrame, epoch: str):
    return F.col(epoch).cast("timestamp_ntz").alias("ts")


def scan_flux(df: DataFrame, flux_var: str | None = None, epoch_var: str | None = None) -> DataFrame:
    """Particle flux records as ``(ts, electron_flux)``; of several channels the first is taken."""
    epoch = resolve_column(df.columns, ["ts", *schemas.FLUX_EPOCH_NAMES], "epoch", epoch_var)
    flux = resolve_column(df.columns, schemas.FLUX_NAMES, "electron flux", flux_var)
    value = F.get(F.col(flux), 0) if _is_vector(df, flux) else F.col(flux)
    return clean_flux(df.select(_stamp(df, epoch), value.cast("double").alias("electron_flux"), *_carried(df)))


def scan_vector(df: DataFrame, field_var: str | None = None, epoch_var: str | None = None) -> DataFrame:
    """Field vector records as ``(ts, Bx, By, Bz)``; extra components are ignored."""
    epoch = resolve_column(df.columns, ["ts", *schemas.EPOCH_NAMES], "epoch", epoch_var)
    field = resolve_column(df.columns, schemas.FIELD_NAMES, "field vector", field_var)
    require(_is_vector(df, field), f"'{field}' must be a vector of three components, not {df.schema[field].dataType.simpleString()}")
    parts = [F.get(F.col(field), i).cast("double").alias(c) for i, c in enumerate(schemas.FIELD_COLUMNS)]
    return clean_field(df.select(_stamp(df, epoch), *parts, *_carried(df)))


def scan_plasma(
    df: DataFrame, speed_var: str | None = None, density_var: str | None = None, epoch_var: str | None = None
) -> DataFrame:
    """Plasma records as ``(ts, solar_wind_speed, plasma_density)``; a velocity vector gives its length."""
    epoch = resolve_column(df.columns, ["ts", *schemas.EPOCH_NAMES], "epoch", epoch_var)
    speed = resolve_column(df.columns, schemas.SPEED_NAMES, "speed", speed_var)
    density = resolve_column(df.columns, schemas.DENSITY_NAMES, "density", density_var)
    velocity = F.transform(F.col(speed), lambda x: x.cast("double")) if _is_vector(df, speed) else None
    length = vector_length(velocity) if velocity is not None else F.col(speed).cast("double")
    return clean_plasma(
        df.select(
            _stamp(df, epoch), length.alias("solar_wind_speed"), F.col(density).cast("double").alias("plasma_density"),
            *_carried(df),
        )
    )


# ---- folders -----------------------------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files of a folder that match ``pattern``, in name order; only their metadata is read."""
    files = open_folder(spark, path, pattern).select("path")
    names = sorted(row["path"] for row in files.toLocalIterator())
    if not names:
        raise FileNotFoundError(f"no files matching {pattern!r} in {path}")
    return names


def _read(spark: SparkSession, paths: Sequence[str], format: str, base: str | None = None) -> DataFrame:
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if base is not None:
        reader = reader.option("basePath", base)
    if format == "csv":
        reader = reader.option("header", "true")
    return reader.format(format).load(list(paths))


# Errors that say a file is not what its format wants; others (a time-out, denied access) are not passed over.
_UNREADABLE = ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "Could not read footer", "not a Parquet file", "Malformed ORC")


def _schema_of(spark: SparkSession, path: str, format: str) -> tuple[tuple[str, ...] | None, str]:
    """Columns of a file, or None and the reason why it cannot be read."""
    try:
        found = tuple(f"{f.name}:{f.dataType.simpleString()}" for f in _read(spark, [path], format).schema)
        return (found, "") if found else (None, "no columns")
    except Exception as error:
        reason = next((text for text in _UNREADABLE if text in str(error)), None)
        if reason is None:
            raise
        return None, reason


def skipped_files(spark: SparkSession, path: str, pattern: str = "*.parquet", format: str = "parquet") -> DataFrame:
    """``(source_file, reason)`` of the files of a folder that ``read_directory`` passes over as unreadable."""
    names = list_files(spark, path, pattern)
    with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
        found = list(pool.map(lambda p: _schema_of(spark, p, format), names))
    rows = [(name, reason) for name, (schema, reason) in zip(names, found) if schema is None]
    return spark.createDataFrame(rows, "source_file string, reason string")


def schema_groups(spark: SparkSession, paths: Sequence[str], format: str) -> list[list[str]]:
    """Files with the same columns together. Only footers or headers are read, several at a time."""
    with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
        found = list(pool.map(lambda p: _schema_of(spark, p, format), paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, (schema, _) in zip(paths, found):
        if schema:
            groups.setdefault(schema, []).append(path)
    if not groups:
        raise ValueError("none of the files could be read")
    return list(groups.values())


def union_signals(signals: Sequence[DataFrame]) -> DataFrame:
    """All rows of several signals with the same columns; columns only some have are NULL elsewhere."""
    united = signals[0]
    for signal in signals[1:]:
        united = united.unionByName(signal, allowMissingColumns=True)
    return united


def read_directory(spark: SparkSession, path: str, scan=scan_flux, pattern: str = "*.parquet", format: str = "parquet", **names) -> DataFrame:
    """Every readable file of a folder through ``scan``, one row per stamp.

    Each group of files with one schema is a single distributed scan whose variable names are resolved
    once. Of several records of a stamp the one from the first file by name is kept; a folder laid out as
    ``source_file=..`` counts each of those as a file. A file without the needed variables is skipped; it
    is an error if that leaves none.
    """
    signals, problems = [], []
    for paths in schema_groups(spark, list_files(spark, path, pattern), format):
        rows = _read(spark, paths, format, path)
        if "source_file" not in rows.columns:
            rows = rows.withColumn("source_file", F.col("_metadata.file_path"))
        try:
            signals.append(scan(rows, **names))
        except ValueError as error:
            problems.append(str(error))
    if not signals:
        raise ValueError("; ".join(problems))
    united = union_signals(signals)
    order = [c for c in ("source_file", "ordinal") if c in united.columns]
    return dedup_keep_first(united, order)


def optional_source(spark: SparkSession, load, schema: T.StructType) -> DataFrame:
    """``load()``, or an empty table of the right type where its files do not exist."""
    try:
        return load()
    except (FileNotFoundError, ValueError):
        return spark.createDataFrame([], schema)


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, for tables written by other tools."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in floating})
