"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake import schemas
from fluxlake.catalog import bindings as b
from fluxlake.catalog import derived
from fluxlake.functions import guards
from fluxlake.functions.times import bin_number, bin_start, seconds_between, shift_time
from fluxlake.operators import asof, clean, gather, horizons, learners, resample, scaling, scoring, windows
from fluxlake.operators.lagged import gram, normal_blocks
from fluxlake.operators.position import with_row_index
from fluxlake.operators.trees import FlatTrees, round_errors
from fluxlake.plans import evaluate, ingest, report
from fluxlake.plans.features import DELTAS
from fluxlake.plans.prepare import clean_series
from fluxlake.session import fresh_path, stage
from fluxlake.sources import archives, profile, records, tables, text_layouts
from fluxlake.streaming.resample import drain, stream_resample

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


STREAM_LATENESS = timedelta(hours=6)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (summation order differs between engines), whole numbers to bigint."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


# ---- sources and sinks -------------------------------------------------------------------------------


@query
def scan_flux(spark, sf_dir):
    return records.scan_flux(derived.flux_records(b.events(spark, sf_dir)))


@query
def scan_vector(spark, sf_dir):
    return records.scan_vector(derived.field_records(b.events(spark, sf_dir)))


@query
def scan_plasma(spark, sf_dir):
    return records.scan_plasma(derived.plasma_records(b.events(spark, sf_dir)))


@query
def scan_directory(spark, sf_dir):
    path = fresh_path(spark, "records")
    derived.hourly_records(b.events(spark, sf_dir)).write.partitionBy("source_file").parquet(path)
    return records.read_directory(spark, path).select("ts", "electron_flux", "source_file", "ordinal")


@query
def skipped_files(spark, sf_dir):
    """A folder with a file for every day, of which each fifth holds plain text: the days that are passed over."""
    path, number = fresh_path(spark, "days"), F.datediff(F.col("day"), F.lit("2024-01-01"))
    rows = b.events(spark, sf_dir).withColumn("day", F.col("ts").cast("date")).repartition("day")
    rows.where(number % 5 != 0).write.partitionBy("day").parquet(path)
    rows.where(number % 5 == 0).select("day", F.col("event_id").cast("string").alias("line")).write.mode("append").partitionBy("day").text(path)
    found = records.skipped_files(spark, path, "part-*")
    return found.select(F.regexp_extract("source_file", "day=([0-9-]+)", 1).alias("day")).distinct()


@query
def stream_bins(spark, sf_dir):
    """Records that arrive in three batches, some of them twice and some late: the bins that a stream closes, with the empty ones between.

    A batch drops what is late by the watermark that the batch before it began with, so the last one drops by the first one's records.
    """
    # Whole numbers, whose sums do not depend on the order in which state adds them up.
    folder, rows = fresh_path(spark, "arriving"), b.events(spark, sf_dir).select("event_id", "ts", F.round(F.col("value") * 100).alias("value"))
    third = rows.agg((F.max("event_id") / 3).cast("bigint").alias("third")).first()["third"]
    first, second = rows.where(F.col("event_id") <= third), rows.where((F.col("event_id") > third) & (F.col("event_id") <= 2 * third))
    again = first.where("event_id % 7 = 0")
    late = first.where("event_id % 50 = 1").select((-F.col("event_id")).alias("event_id"), "ts", (F.col("value") + 1000).alias("value"))
    for batch in (first.unionByName(again), second, rows.where(F.col("event_id") > 2 * third).unionByName(late)):
        batch.coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    bins, _ = drain(stream_resample(arriving, ["value"], b.CADENCE, STREAM_LATENESS, unique=["event_id"]), "bins")
    return resample.resample_mean(bins, ["value"], b.CADENCE)


@query
def resolve_column(spark, sf_dir):
    rows = b.events(spark, sf_dir)
    newer, older = F.col("user_id") % 2 == 0, F.col("user_id") % 2 == 1
    parts = [
        records.scan_flux(derived.flux_records(rows.where(which), name)).withColumn("resolved", F.lit(name))
        for which, name in ((newer, "E2W_COR_FLUX"), (older, "e2_flux"))
    ]
    return records.union_signals(parts)


@query
def scan_archive(spark, sf_dir):
    members = archives.expand_archives(derived.archives(b.events(spark, sf_dir)))
    return archives.combine_archives(archives.archive_flux(members))


@query
def xml_flatten(spark, sf_dir):
    return archives.archive_metadata(archives.expand_archives(derived.archives(b.events(spark, sf_dir)), ("xml",)))


@query
def metadata_maps(spark, sf_dir):
    metadata = archives.archive_metadata(archives.expand_archives(derived.archives(b.events(spark, sf_dir)), ("xml",)))
    maps = archives.metadata_maps(metadata)
    return maps.select("archive", F.size("metadata").alias("n_fields"), F.col("metadata")["product/first"].alias("first"))


@query
def archives_with_damage(spark, sf_dir):
    """Archives of which every seventh has a member with a wrong checksum: it goes whole."""
    members = archives.expand_archives(derived.archives(b.events(spark, sf_dir), damaged=7), ("txt",))
    return archives.combine_archives(archives.archive_flux(members))


@query
def skipped_archives(spark, sf_dir):
    members = archives.expand_archives(derived.archives(b.events(spark, sf_dir), damaged=7), ())
    return archives.skipped_archives(members).select("archive", F.substring_index("reason", ":", 1).alias("reason"))


def _archive_folder(spark, sf_dir) -> str:
    path = fresh_path(spark, "archive_folder")
    derived.write_archive_folder(b.events(spark, sf_dir), path, damaged=7, strange=5)
    return path


@query
def archive_folder(spark, sf_dir):
    """A folder of archives on disk, some damaged and some files no archives, as one signal."""
    return archives.scan_archives(spark, _archive_folder(spark, sf_dir), "part-*")


@query
def ingest_folders(spark, sf_dir):
    """Three folders of records and one of archives, from files to the training grid, beside the truth's mean of every bin."""
    folders = {}
    for name, table in b.instrument_tables(spark, sf_dir).items():
        folders[name] = fresh_path(spark, name)
        table.write.partitionBy("source_file").parquet(folders[name])
    got = ingest.ingest(spark, *folders.values(), _archive_folder(spark, sf_dir), b.NOW, b.CADENCE, truth_pattern="part-*")
    truth = resample.resample_mean(got["validation"].withColumnRenamed("electron_flux", "truth_flux"), ["truth_flux"], b.CADENCE)
    return got["training"].join(truth, "ts", "left").select("ts", *schemas.GRID_COLUMNS, "truth_flux")


@query
def archive_folder_report(spark, sf_dir):
    """Every file of the folder with its number of lines, or why it was skipped."""
    members = archives.expand_archives(archives.list_archives(spark, _archive_folder(spark, sf_dir), "part-*"), ("txt",))
    read = F.col("kind") == "txt"
    return members.groupBy("archive").agg(
        F.count_if(read).alias("n_lines"), F.max(F.when(~read, F.substring_index("line", ":", 1))).alias("reason")
    )


@query
def rejected_lines(spark, sf_dir):
    """Every file has data lines that fit; a fourth one of other words has none."""
    lines = derived.text_lines(b.events(spark, sf_dir))
    odd = lines.where(F.col("line_no") % 3 == 1).select("archive", F.lit("odd.txt").alias("member"), "line_no", F.concat(F.lit("value "), F.col("line_no").cast("string")).alias("line"))
    return text_layouts.rejected_lines(stage(lines.unionByName(odd), "lines_with_rejects"))


@query
def parse_layout_a(spark, sf_dir):
    lines = b.events(spark, sf_dir).select("event_id", derived.line_a().alias("line"))
    return text_layouts.layout_rows(lines, "a", ["event_id"])


@query
def parse_layout_b(spark, sf_dir):
    lines = b.events(spark, sf_dir).select("event_id", derived.line_b().alias("line"))
    return text_layouts.layout_rows(lines, "b", ["event_id"])


@query
def parse_text_auto(spark, sf_dir):
    lines = stage(derived.text_lines(b.events(spark, sf_dir)), "text_lines")
    return text_layouts.parse_text(lines)


@query
def optional_source(spark, sf_dir):
    absent = records.optional_source(
        spark, lambda: archives.scan_archives(spark, sf_dir, "*.zip"), schemas.TRUTH_SIGNAL
    )
    return records.union_signals([b.truth(spark, sf_dir), absent])


@query
def csv_roundtrip(spark, sf_dir):
    rows, path = b.grid(spark, sf_dir), fresh_path(spark, "grid_csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query
def dataset_sink(spark, sf_dir):
    path = fresh_path(spark, "datasets")
    tables.write_datasets(b.datasets(spark, sf_dir), schemas.MODEL_INPUTS, path)
    order = tables.read_feature_order(spark, path)
    counts = tables.read_datasets(spark, path).groupBy("horizon", "split").agg(F.count("*").alias("n_rows"))
    return counts.withColumns({"n_features": F.lit(len(order)), "features": F.lit(",".join(order))})


@query
def dataset_scan(spark, sf_dir):
    path = fresh_path(spark, "datasets")
    tables.write_datasets(b.datasets(spark, sf_dir), schemas.MODEL_INPUTS, path)
    return tables.read_datasets(spark, path, "A", "val").select("ts", "row_idx", *schemas.MODEL_INPUTS, "y")


@query
def metrics_json(spark, sf_dir):
    weights, path = evaluate.ensemble_weights(b.stand_ins(spark, sf_dir), b.SEQUENCE_LENGTH), fresh_path(spark, "weights")
    tables.write_json(weights, path)
    back = tables.read_json(spark, path, weights.schema)
    return back.select("horizon", "alpha", "val_rmse", "sequence_length", "test_ensemble.*")


@query
def scaler_apply(spark, sf_dir):
    path = fresh_path(spark, "scaler")
    scaling.save_scaler(spark, b.scaler(spark, sf_dir), path)
    scaled = scaling.apply_scaler(b.series(spark, sf_dir), scaling.load_scaler(spark, path))
    return scaled.select("ts", *schemas.SCALED_DRIVERS)


@query
def profile_source(spark, sf_dir):
    return profile.profile_source(b.events(spark, sf_dir), ["event_id"])


@query
def time_coverage(spark, sf_dir):
    return profile.time_coverage(b.grid(spark, sf_dir))


# ---- projections and filters -------------------------------------------------------------------------


@query
def null_fill_values(spark, sf_dir):
    rows = b.events(spark, sf_dir).select("event_id", derived.damaged_value().alias("raw"))
    return rows.select(
        "event_id", guards.drop_fill("raw").alias("one_sided"), guards.drop_fill(-F.col("raw"), two_sided=True).alias("two_sided")
    )


@query
def null_nonpositive(spark, sf_dir):
    rows = b.events(spark, sf_dir).select("event_id", derived.damaged_value().alias("raw"))
    return rows.select("event_id", guards.drop_nonpositive("raw").alias("electron_flux"))


@query
def drop_corrupt_ts(spark, sf_dir):
    return clean.drop_corrupt_stamps(derived.misdated_records(b.events(spark, sf_dir)), b.NOW)


@query
def drop_missing_target(spark, sf_dir):
    return clean.drop_missing(b.grid(spark, sf_dir), [schemas.TARGET])


@query
def interpolate_gaps(spark, sf_dir):
    filled = windows.interpolate_gaps(b.fine_grid(spark, sf_dir), schemas.GRID_COLUMNS, drop_unfilled=False)
    return filled.select("ts", *schemas.GRID_COLUMNS)


@query
def feature_table(spark, sf_dir):
    return b.features(spark, sf_dir)


@query
def align_grid(spark, sf_dir):
    rows = b.records(spark, sf_dir)
    target = (rows.where("part = 'target'"), [schemas.TARGET])
    drivers = [(rows.where(F.col("part") == "driver"), schemas.DRIVERS)]
    return resample.align_grid(target, drivers, b.CADENCE).select("ts", *schemas.GRID_COLUMNS)


@query
def dynamic_lag(spark, sf_dir):
    minutes = b.CADENCE.total_seconds() / 60.0
    return gather.dynamic_lag(b.prepared_rows(spark, sf_dir), minutes, b.DELTA_KM)


@query
def select_features(spark, sf_dir):
    return b.features(spark, sf_dir).select("ts", *schemas.MODEL_INPUTS)


@query
def log_transform(spark, sf_dir):
    return b.grid(spark, sf_dir).select("ts", guards.log_flux(schemas.TARGET).alias(schemas.LOG_TARGET))


@query
def valid_time(spark, sf_dir):
    rows = evaluate.to_valid_time(b.datasets(spark, sf_dir), b.CADENCE)
    return rows.select("horizon", "ts", "valid_ts")


@query
def align_predictions(spark, sf_dir):
    rows, length = b.stand_ins(spark, sf_dir), b.SEQUENCE_LENGTH
    tree = rows.select("horizon", "split", "ts", "y", "tree_pred")
    sequence = rows.where(F.col("split_idx") >= length - 1).select("horizon", "split", "ts", "sequence_pred")
    return scoring.align_predictions(tree, sequence)


# ---- joins ---------------------------------------------------------------------------------------------


@query
def merge_signals(spark, sf_dir):
    drivers = b.records(spark, sf_dir).where("part = 'driver'")
    field, plasma = schemas.DRIVERS[:3], schemas.DRIVERS[3:]
    return resample.merge_signals([(drivers, field), (drivers, plasma)], b.CADENCE)


@query
def asof_nearest(spark, sf_dir):
    step = b.CADENCE
    measured = b.truth(spark, sf_dir).withColumnRenamed("electron_flux", "truth")
    return asof.asof_nearest(b.features(spark, sf_dir).select("ts", schemas.LOG_TARGET), measured, ["truth"], step / 2)


@query
def horizon_lookup(spark, sf_dir):
    rows = b.datasets(spark, sf_dir)
    return rows.select(
        "ts", "horizon", "steps", horizons.horizon_column("horizon", schemas.HORIZON_LABELS).alias("horizon_label"),
        horizons.horizon_column("horizon", {"A": 0.2, "B": 0.5, "C": 0.8}).alias("alpha"),
    )


# ---- aggregates ----------------------------------------------------------------------------------------


@query
def resample_mean(spark, sf_dir):
    return resample.resample_mean(b.events(spark, sf_dir), ["value"], b.FINE_CADENCE)


@query
def dedup_keep_first(spark, sf_dir):
    rows = clean.clean_flux(derived.hourly_records(b.events(spark, sf_dir)))
    return clean.dedup_keep_first(rows, ["source_file", "ordinal"])


@query
def union_signals(spark, sf_dir):
    rows = b.events(spark, sf_dir)
    flux = records.scan_flux(derived.flux_records(rows))
    return records.union_signals([flux, records.scan_vector(derived.field_records(rows))])


@query
def null_rates(spark, sf_dir):
    return clean.null_rates(b.grid(spark, sf_dir), schemas.GRID_COLUMNS)


@query
def robust_scale(spark, sf_dir):
    return scaling.robust_params(b.series(spark, sf_dir), schemas.DRIVERS)


@query
def regression_metrics(spark, sf_dir):
    return scoring.regression_metrics(b.stand_ins(spark, sf_dir), "y", "tree_pred", ["horizon", "split"])


@query
def skill_score(spark, sf_dir):
    return scoring.skill_score(b.stand_ins(spark, sf_dir), "y", "sequence_pred", "persistence_pred", ["horizon", "split"])


@query
def best_alpha(spark, sf_dir):
    val = b.stand_ins(spark, sf_dir).where("split = 'val'")
    return scoring.best_alpha(val, "y", "tree_pred", "sequence_pred", ["horizon"])


@query
def step_counts(spark, sf_dir):
    seen = Observation("clean_series")
    grid_rows = b.grid(spark, sf_dir)
    cleaned = stage(clean_series(grid_rows, b.CADENCE, observation=seen), "observed_series")
    got, total, kept = seen.get, grid_rows.count(), cleaned.count()
    steps = [
        ("missing_target", total, total - got["rows"], 0),
        ("spikes", got["rows"], 0, got["spikes"]),
        ("long_gaps", got["rows"], got["rows"] - kept, 0),
        ("features", kept, kept - b.features(spark, sf_dir).count(), 0),
    ]
    return spark.createDataFrame(steps, "step string, rows_in bigint, rows_dropped bigint, values_nulled bigint")


@query
def lag_step_stats(spark, sf_dir):
    minutes = b.CADENCE.total_seconds() / 60.0
    return gather.lag_step_stats(b.series(spark, sf_dir), minutes, b.DELTA_KM)


@query
def split_counts(spark, sf_dir):
    return b.datasets(spark, sf_dir).groupBy("horizon", "split").agg(F.count("*").alias("n_rows"))


# ---- windows -------------------------------------------------------------------------------------------


@query
def rolling_median(spark, sf_dir):
    rows = windows.rolling_median(b.target_rows(spark, sf_dir), schemas.TARGET)
    return rows.select("ts", schemas.TARGET, "rolling_median")


@query
def despike_mad(spark, sf_dir):
    rows = windows.flag_spikes(b.target_rows(spark, sf_dir), schemas.TARGET)
    return rows.select("ts", schemas.TARGET, "rolling_median", "abs_dev", "rolling_mad", "is_spike")


@query
def lag_features(spark, sf_dir):
    rows = windows.lag_features(b.prepared_rows(spark, sf_dir), schemas.LOG_TARGET)
    return rows.select("ts", *schemas.LAG_COLUMNS)


@query
def rolling_stats(spark, sf_dir):
    rows = windows.rolling_stats(b.prepared_rows(spark, sf_dir), schemas.LOG_TARGET)
    return rows.select("ts", *schemas.ROLLING_COLUMNS)


@query
def ema(spark, sf_dir):
    rows = windows.ema_features(b.prepared_rows(spark, sf_dir), schemas.LOG_TARGET)
    return rows.select("ts", *schemas.EMA_COLUMNS)


@query
def delta_features(spark, sf_dir):
    minutes = b.CADENCE.total_seconds() / 60.0
    lagged = gather.dynamic_lag(b.prepared_rows(spark, sf_dir), minutes, b.DELTA_KM)
    return windows.delta_features(lagged, DELTAS).select("ts", *schemas.DELTA_COLUMNS)


@query
def horizon_target(spark, sf_dir):
    rows = horizons.add_targets(b.feature_rows(spark, sf_dir).select("ts", "row_idx", schemas.LOG_TARGET))
    return rows.select("ts", *[f"y_{h}" for h in schemas.HORIZON_STEPS])


@query
def null_runs(spark, sf_dir):
    return windows.null_runs(b.fine_grid(spark, sf_dir), schemas.TARGET)


@query
def row_index(spark, sf_dir):
    return b.target_rows(spark, sf_dir).select("ts", "row_idx")


@query
def sequence_windows(spark, sf_dir):
    inputs = list(schemas.MODEL_INPUTS)
    rows = horizons.sequence_windows(b.datasets(spark, sf_dir), b.SEQUENCE_LENGTH, inputs)
    flux = inputs.index(schemas.LOG_TARGET)
    cell = lambda i, j: F.col("sequence")[i][j].cast("double")
    total = lambda j: F.aggregate(F.col("sequence"), F.lit(0.0), lambda t, x: t + x[j].cast("double"))
    last = F.size("sequence") - 1
    return rows.select(
        "horizon", "split", "ts", "y", F.size("sequence").alias("length"), F.size(F.col("sequence")[0]).alias("width"),
        cell(0, flux).alias("oldest_flux"), cell(last, flux).alias("newest_flux"), *[total(j).alias(f"sum_{c}") for j, c in enumerate(inputs)],
    )


@query
def sequence_chunks(spark, sf_dir):
    """Long windows of the fine grid, gaps among their rows, held once and looked at as one array per chunk."""
    inputs = list(schemas.GRID_COLUMNS)
    chunks = horizons.sequence_chunks(b.fine_grid(spark, sf_dir), b.LONG_SEQUENCE, inputs, (), "row_idx")

    def summary(views):
        known = ~np.isnan(views)
        out = {"n_known": known.sum(axis=(1, 2)), "moment": np.nansum(views[:, :, 0] * np.arange(views.shape[1], dtype=float), axis=1)}
        return {**out, **{f"sum_{c}": np.nansum(views[:, :, k], axis=1, dtype=float) for k, c in enumerate(inputs)}}

    columns = "n_known bigint, moment double, " + ", ".join(f"sum_{c} double" for c in inputs)
    return horizons.map_windows(chunks, b.LONG_SEQUENCE, summary, columns, (), "row_idx")


@query
def chrono_split(spark, sf_dir):
    return b.datasets(spark, sf_dir).select("horizon", "ts", "row_idx", "y", "split", "split_idx")


@query
def persistence(spark, sf_dir):
    rows = evaluate.to_valid_time(b.stand_ins(spark, sf_dir), b.CADENCE)
    return rows.select("horizon", "valid_ts", "persistence_pred")


# ---- order and fan-out ---------------------------------------------------------------------------------


@query
def sorted_sink(spark, sf_dir):
    rows, path = b.features(spark, sf_dir).select("ts", schemas.TARGET), fresh_path(spark, "sorted")
    tables.write_sorted(rows, path, ["ts"])
    return spark.read.schema(rows.schema).parquet(path)


@query
def latest_conditions(spark, sf_dir):
    return report.latest_conditions(b.features(spark, sf_dir))


@query
def latest_window(spark, sf_dir):
    return report.latest_rows(b.features(spark, sf_dir).select("ts", *schemas.MODEL_INPUTS), b.SEQUENCE_LENGTH)


@query
def multi_horizon(spark, sf_dir):
    targets = horizons.add_targets(b.feature_rows(spark, sf_dir).select("ts", "row_idx", schemas.LOG_TARGET))
    return horizons.horizon_rows(targets).select("horizon", "steps", "ts", "y")


# ---- scalar functions ----------------------------------------------------------------------------------


@query
def scalar_math(spark, sf_dir):
    v = F.col("value")
    return b.events(spark, sf_dir).select(
        "event_id", F.abs(v - 50).alias("abs_value"), guards.log_flux(v).alias("log_value"), F.sqrt(v).alias("root_value"),
        guards.flux_from_log(v / 100).alias("power_value"), F.round(v / 7, 4).alias("rounded_value"), F.rint(v / 2).alias("even_value"),
    )


@query
def lag_steps(spark, sf_dir):
    speed = F.when(F.col("event_id") % 97 == 0, F.lit(0.0)).when(F.col("event_id") % 89 == 0, F.lit(None)).otherwise(F.col("value") * 2 - 20)
    return b.events(spark, sf_dir).select("event_id", guards.lag_steps(speed, 5.0).alias("steps"))


@query
def scalar_time(spark, sf_dir):
    step = b.CADENCE
    start = bin_start(bin_number("ts", step), step)
    return b.events(spark, sf_dir).select(
        "event_id", start.alias("bin_ts"), shift_time("ts", step, 9).alias("later_ts"),
        seconds_between("ts", start).alias("seconds_into_bin"), F.dayofyear("ts").alias("doy"),
    )


@query
def vector_norm(spark, sf_dir):
    rows = b.events(spark, sf_dir).select("event_id", derived.vector().alias("v"))
    return rows.select(
        "event_id", guards.drop_fill(guards.vector_length("v"), two_sided=True).alias("length"),
        guards.drop_fill(F.element_at("v", 1), two_sided=True).alias("first_part"),
    )


@query
def confidence_label(spark, sf_dir):
    return report.with_confidence(evaluate.ensemble_weights(b.stand_ins(spark, sf_dir), b.SEQUENCE_LENGTH))


# ---- forecasts -----------------------------------------------------------------------------------------


def _trees(spark, sf_dir) -> dict[str, learners.Fitted]:
    def build():
        rows = b.datasets(spark, sf_dir)
        present = [r["horizon"] for r in rows.where("split = 'val'").select("horizon").distinct().collect()]
        return learners.train_all_trees({h: rows.where(F.col("horizon") == h) for h in sorted(present)})

    return b.keep(spark, sf_dir, "trees", build)


def _window_models(spark, sf_dir) -> dict[str, learners.Fitted]:
    def build():
        rows, length = b.datasets(spark, sf_dir), b.SEQUENCE_LENGTH
        found = {h: learners.train_windows(rows.where(F.col("horizon") == h), length) for h in sorted(_trees(spark, sf_dir))}
        return {h: model for h, model in found.items() if model is not None}

    return b.keep(spark, sf_dir, "window_models", build)


def _predictions(spark, sf_dir) -> DataFrame:
    """Both models' forecasts on every split, aligned."""

    def build():
        both = None
        for horizon, windows_ in _window_models(spark, sf_dir).items():
            rows = b.datasets(spark, sf_dir).where(F.col("horizon") == horizon)
            rows = learners.predict_windows(windows_, learners.predict_trees(_trees(spark, sf_dir)[horizon], rows))
            both = rows if both is None else both.unionByName(rows)
        return stage(both.select("ts", "horizon", "split", "y", "tree_pred", "sequence_pred"), "predictions")

    return b.keep(spark, sf_dir, "predictions", build)


def _weights(spark, sf_dir) -> DataFrame:
    build = lambda: stage(evaluate.ensemble_weights(_predictions(spark, sf_dir), b.SEQUENCE_LENGTH), "weights")
    return b.keep(spark, sf_dir, "weights", build)


@query
def gbt_grid(spark, sf_dir):
    rows = [
        (h, float(p["n_estimators"]), float(p["max_depth"]), float(p["learning_rate"]), float(p["subsample"]), error, p == fitted.params)
        for h, fitted in _trees(spark, sf_dir).items() for p, error in fitted.trials
    ]
    return spark.createDataFrame(
        rows, "horizon string, n_estimators double, max_depth double, learning_rate double, subsample double, val_rmse double, best boolean"
    )


@query
def gbt_predict(spark, sf_dir):
    return gbt_predict_raw(spark, sf_dir)


def gbt_predict_raw(spark, sf_dir):
    """Every tree model saved, loaded and applied to its test rows."""
    parts = None
    for horizon, fitted in _trees(spark, sf_dir).items():
        path = fresh_path(spark, f"trees_{horizon}")
        learners.save_trees(fitted.model, path)
        loaded = learners.Fitted(learners.load_trees(path), fitted.inputs)
        test = b.datasets(spark, sf_dir).where((F.col("horizon") == horizon) & (F.col("split") == "test"))
        rows = learners.predict_trees(loaded, test).select("horizon", "ts", "y", "tree_pred")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


@query
def seq_regressor(spark, sf_dir):
    return _predictions(spark, sf_dir).select("horizon", "split", "ts", "y", "sequence_pred")


@query
def ensemble_blend(spark, sf_dir):
    blended = scoring.blend_by_horizon(b.stand_ins(spark, sf_dir), {"A": 0.2, "B": 0.5, "C": 0.8}, "tree_pred", "sequence_pred")
    return blended.select("horizon", "ts", "ensemble")


@query
def model_comparison(spark, sf_dir):
    test = b.stand_ins(spark, sf_dir).where("split = 'test'")
    test = scoring.blend_by_horizon(test, {"A": 0.2, "B": 0.5, "C": 0.8}, "tree_pred", "sequence_pred")
    return scoring.model_comparison(test, "y", evaluate.MODELS)


@query
def full_history_predictions(spark, sf_dir):
    return full_history_raw(spark, sf_dir)


def full_history_raw(spark, sf_dir):
    alphas = evaluate.collect_alphas(_weights(spark, sf_dir))
    return evaluate.full_history(
        b.feature_rows(spark, sf_dir), _trees(spark, sf_dir), _window_models(spark, sf_dir), alphas, b.CADENCE
    )


@query
def validate_truth(spark, sf_dir):
    step = b.CADENCE
    rows = evaluate.to_valid_time(b.stand_ins(spark, sf_dir), step)
    rows = scoring.blend_by_horizon(rows, {"A": 0.2, "B": 0.5, "C": 0.8}, "tree_pred", "sequence_pred", "model_pred")
    scores = evaluate.validate(rows.select("valid_ts", "horizon", "model_pred", "persistence_pred"), b.truth(spark, sf_dir), step / 2)
    named = [F.col(f"{who}_vs_truth.{m}").alias(f"{who}_{m}") for who in ("model", "persistence") for m in ("mae", "rmse", "r2")]
    return scores.select("horizon", "n_matched", *named, "skill_score_vs_persistence")


@query
def latest_forecast(spark, sf_dir):
    return latest_forecast_raw(spark, sf_dir)


def latest_forecast_raw(spark, sf_dir):
    weights = _weights(spark, sf_dir)
    return report.latest_forecast(
        b.feature_rows(spark, sf_dir), _trees(spark, sf_dir), _window_models(spark, sf_dir), weights,
        evaluate.collect_alphas(weights), b.SEQUENCE_LENGTH, b.CADENCE,
    )


# What must hold of the learners' results whatever they have learnt, in a form that SQL can repeat.


@query
def gbt_search_rule(spark, sf_dir):
    """Per horizon: settings tried, settings marked as best, and whether that is the first with the least error."""
    rows = []
    for horizon, fitted in _trees(spark, sf_dir).items():
        errors = [error for _, error in fitted.trials]
        first = fitted.trials[errors.index(min(errors))][0]
        rows.append((horizon, len(errors), sum(p == fitted.params for p, _ in fitted.trials), first == fitted.params and fitted.val_rmse == min(errors)))
    return spark.createDataFrame(rows, "horizon string, n_trials bigint, n_best bigint, first_smallest boolean")


@query
def gbt_saved_rows(spark, sf_dir):
    """Test rows of every horizon, and whether the saved and loaded model forecasts as the one in memory."""
    loaded = gbt_predict_raw(spark, sf_dir)
    own = None
    for horizon, fitted in _trees(spark, sf_dir).items():
        test = b.datasets(spark, sf_dir).where((F.col("horizon") == horizon) & (F.col("split") == "test"))
        rows = learners.predict_trees(fitted, test, "own_pred").select("horizon", "ts", "own_pred")
        own = rows if own is None else own.unionByName(rows)
    both = loaded.join(own, ["horizon", "ts"])
    return both.select("horizon", "ts", "y", (F.col("tree_pred") == F.col("own_pred")).alias("same"))


@query
def seq_rows(spark, sf_dir):
    known = ~F.isnan("sequence_pred") & F.col("sequence_pred").isNotNull() & F.col("tree_pred").isNotNull()
    return _predictions(spark, sf_dir).select("horizon", "split", "ts", "y", known.alias("forecast"))


@query
def full_history_rows(spark, sf_dir):
    rows = full_history_raw(spark, sf_dir)
    return rows.select("valid_ts", "horizon", "persistence_pred", F.col("model_pred").isNotNull().alias("forecast"))


@query
def latest_forecast_rows(spark, sf_dir):
    rows = latest_forecast_raw(spark, sf_dir)
    text = F.format_string("%.2e", F.pow(F.lit(10.0), F.col("log_pred")))
    return rows.select("horizon", "valid_ts", (F.col("flux_text") == text).alias("text_fits"), F.col("confidence").isNotNull().alias("rated"))


# Small models whose every number SQL can repeat: trees of one split on the place in the day, windows of two rows of one input.

STUMP = {"depth": 1, "step": 0.3, "subsample": 1.0, "seed": 7}
STUMP_ROUNDS = 3


def _with_slot(rows: DataFrame) -> DataFrame:
    """Grid step of the day that a row lies in."""
    return rows.withColumn("slot", F.pmod(bin_number("ts", b.CADENCE), F.lit(12)).cast("double"))


def _small_models(spark, sf_dir) -> tuple[dict[str, learners.Fitted], dict[str, learners.Fitted]]:
    def build():
        rows, trees, pairs = _with_slot(b.datasets(spark, sf_dir)), {}, {}
        for h in sorted(r["horizon"] for r in rows.where("split = 'val'").select("horizon").distinct().collect()):
            mine = rows.where(F.col("horizon") == h)
            staged = learners.assemble(mine, ["slot"])
            trees[h] = learners.Fitted(learners.boost(staged, STUMP_ROUNDS, **STUMP), ["slot"], {"rows": staged})
            pairs[h] = learners.train_windows(mine, 2, [schemas.LOG_TARGET])
        return trees, pairs

    return b.keep(spark, sf_dir, "small_models", build)


@query
def gbt_rounds(spark, sf_dir):
    """Validation error after each boosting round."""
    rows = [
        (h, at + 1, error) for h, fitted in _small_models(spark, sf_dir)[0].items()
        for at, error in enumerate(round_errors(FlatTrees.of(fitted.model), fitted.params["rows"].where("is_val")))
    ]
    return spark.createDataFrame(rows, "horizon string, round bigint, val_rmse double")


@query
def seq_pairs(spark, sf_dir):
    """Forecasts by windows of two rows."""
    parts = None
    for h, fitted in _small_models(spark, sf_dir)[1].items():
        rows = learners.predict_windows(fitted, b.datasets(spark, sf_dir).where(F.col("horizon") == h)).select("horizon", "split", "ts", "y", "sequence_pred")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


@query
def window_gram(spark, sf_dir):
    """The Gram matrix of flattened windows over the training rows of horizon A, from blocks per lag and the rows at both ends."""
    inputs, length = [schemas.LOG_TARGET, "delta_flux"], b.SEQUENCE_LENGTH
    rows = b.datasets(spark, sf_dir).where("horizon = 'A' AND split = 'train'")
    found = sorted(normal_blocks(rows, length, inputs, "y", "split_idx", [0.0, 0.0], [1.0, 1.0]).collect(), key=lambda r: r["lag"])
    values = rows.select("split_idx", *inputs)
    first = np.array([list(r)[1:] for r in values.where(F.col("split_idx") < length - 1).orderBy("split_idx").collect()])
    last = np.array([list(r)[1:] for r in reversed(values.orderBy(F.col("split_idx").desc()).limit(length - 1).collect())])
    matrix = gram(np.array([r["cross"] for r in found]).reshape(length, 2, 2), first, last)
    cells = [(i // 2, inputs[i % 2], j // 2, inputs[j % 2], float(matrix[i, j])) for i in range(2 * length) for j in range(2 * length)]
    return spark.createDataFrame(cells, "lag_a bigint, input_a string, lag_b bigint, input_b string, total double")


def _small_alphas(spark, sf_dir) -> dict[str, float]:
    return {h: 0.3 for h in _small_models(spark, sf_dir)[0]}


@query
def full_history_values(spark, sf_dir):
    """Blended forecasts of the small models from every feature row with a whole window."""
    trees, pairs = _small_models(spark, sf_dir)
    return evaluate.full_history(_with_slot(b.feature_rows(spark, sf_dir)), trees, pairs, _small_alphas(spark, sf_dir), b.CADENCE)


@query
def latest_forecast_values(spark, sf_dir):
    """The newest of those forecasts, rated by the test scores of the stand-in blend."""
    trees, pairs = _small_models(spark, sf_dir)
    weights = evaluate.ensemble_weights(b.stand_ins(spark, sf_dir), 2)
    rows = report.latest_forecast(_with_slot(b.feature_rows(spark, sf_dir)), trees, pairs, weights, _small_alphas(spark, sf_dir), 2, b.CADENCE)
    return rows.select("horizon", "valid_ts", "log_pred", "flux_pred", "r2", "confidence")


# ---- reports -------------------------------------------------------------------------------------------


@query
def history_series(spark, sf_dir):
    return report.history_series(b.features(spark, sf_dir), b.CADENCE * 4)


@query
def metric_report(spark, sf_dir):
    return report.metric_report(evaluate.ensemble_weights(b.stand_ins(spark, sf_dir), b.SEQUENCE_LENGTH))


# ---- the same operators on many series at once -----------------------------------------------------------


def _order_rows(spark, sf_dir) -> DataFrame:
    def build():
        daily = stage(b.daily_orders(spark, sf_dir), "daily_orders")
        return stage(with_row_index(daily, timedelta(days=1), ["o_orderpriority"]), "daily_orders_indexed")

    return b.keep(spark, sf_dir, "daily_orders", build)


@query
def rolling_stats_by_key(spark, sf_dir):
    rows = windows.rolling_stats(_order_rows(spark, sf_dir), "total", prefix="total", keys=["o_orderpriority"])
    return rows.drop("total")


@query
def despike_by_key(spark, sf_dir):
    return windows.flag_spikes(_order_rows(spark, sf_dir), "total", keys=["o_orderpriority"])


@query
def ema_by_key(spark, sf_dir):
    rows = windows.ema_features(_order_rows(spark, sf_dir), "total", prefix="total", keys=["o_orderpriority"])
    return rows.drop("total")


@query
def resample_by_key(spark, sf_dir):
    orders = b.orders(spark, sf_dir)
    return resample.resample_mean(orders, ["o_totalprice"], timedelta(days=1), ["o_orderpriority", "o_orderstatus"], "o_orderdate")


@query
def robust_scale_by_key(spark, sf_dir):
    params = scaling.robust_params(b.orders(spark, sf_dir), ["o_totalprice"], ["o_orderpriority"])
    scaled = scaling.apply_keyed_scaler(b.orders(spark, sf_dir), params, ["o_totalprice"], ["o_orderpriority"])
    return scaled.select("o_orderkey", "o_orderpriority", "o_totalprice_scaled")


def _user_rows(spark, sf_dir) -> DataFrame:
    """A series per user: mean value on the grid step, with positions. Its rows grow with the users and the days."""

    def build():
        grid = stage(resample.resample_mean(b.events(spark, sf_dir), ["value"], b.CADENCE, ["user_id"]), "user_grid")
        return stage(with_row_index(grid, b.CADENCE, ["user_id"]), "user_grid_indexed")

    return b.keep(spark, sf_dir, "user_rows", build)


@query
def interpolate_gaps_by_key(spark, sf_dir):
    return windows.interpolate_gaps(_user_rows(spark, sf_dir), ["value"], keys=["user_id"], drop_unfilled=False)


@query
def null_runs_by_key(spark, sf_dir):
    return windows.null_runs(_user_rows(spark, sf_dir), "value", keys=["user_id"])


@query
def lag_features_by_key(spark, sf_dir):
    rows = windows.lag_features(_user_rows(spark, sf_dir), "value", prefix="value", keys=["user_id"])
    return windows.delta_features(rows, {"delta_value": "value"}, keys=["user_id"]).drop("value")


@query
def asof_by_key(spark, sf_dir):
    """Each user's purchases with the nearest of their views within a day."""
    rows = b.events(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("viewed"))
    return asof.asof_nearest(left, right, ["viewed"], timedelta(days=1), keys=["user_id"])
