"""Table layouts and the names and numbers that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _S, _TS = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


FLUX_SIGNAL = _struct(ts=_TS, electron_flux=_D, source_file=_S, ordinal=_L)
FIELD_SIGNAL = _struct(ts=_TS, Bx=_D, By=_D, Bz=_D, source_file=_S, ordinal=_L)
PLASMA_SIGNAL = _struct(ts=_TS, solar_wind_speed=_D, plasma_density=_D, source_file=_S, ordinal=_L)
TRUTH_SIGNAL = _struct(ts=_TS, electron_flux=_D)
MEMBER_LINES = _struct(archive=_S, member=_S, member_no=_L, kind=_S, line_no=_L, path=_S, line=_S)
PREDICTIONS = _struct(valid_ts=_TS, horizon=_S, model_pred=_D, persistence_pred=_D)
METRICS = _struct(mae=_D, rmse=_D, r2=_D)

# ---- fixed values: names tried in this order when a record file is opened --------------------
EPOCH_NAMES = ["Epoch", "epoch", "TIME", "time", "Time", "Epoch_0", "EPOCH"]
FLUX_EPOCH_NAMES = EPOCH_NAMES + ["time_tags"]
FLUX_NAMES = [
    "E2W_COR_FLUX", "E2E_COR_FLUX", "e2_flux", "E2", "e2", "gt2mev", "mev2", "AvgDiffElectronFlux",
    "electron_flux", "Flux", "flux", "p8", "p9", "FLUX",
]
FIELD_NAMES = ["BGSE", "BGSEc", "B_GSE", "b_gse", "bgsec", "BF1", "B", "BFIELD", "IMF"]
SPEED_NAMES = ["Proton_V_nonlin", "V_GSE", "Vp", "vp", "bulk_speed", "SW_V", "V", "velocity", "Speed"]
DENSITY_NAMES = [
    "Proton_Np_nonlin", "Np", "np", "Density", "density", "proton_density", "N_p", "Np_moment",
]

# ---- fixed values: cleaning and feature parameters --------------------------------------------
FILL_LIMIT = 1e20
EARLIEST_STAMP = "1994-11-01 00:00:00"
MAX_DAYS_FROM_MEDIAN = 60
EPSILON = 1e-10
DELTA_X_KM = 1.5e6
SPIKE_WINDOW = 12
SPIKE_THRESHOLD = 5.0
MAD_TO_SIGMA = 1.4826
MAX_GAP = 6
LAG_STEPS = [1, 2, 6, 12, 24]
ROLLING_WINDOWS = [6, 12, 24]
HORIZON_STEPS = {"A": 9, "B": 72, "C": 144}
HORIZON_LABELS = {"A": "30-45 min", "B": "6 hours", "C": "12 hours"}
TRAIN_FRACTION = 0.8
VALIDATION_FRACTION = 0.1
SEQUENCE_LENGTH = 288
ALPHAS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
TREE_GRID = {
    "n_estimators": [300, 600], "max_depth": [4, 6], "learning_rate": [0.05, 0.1], "subsample": [0.8, 1.0],
}
HIGH_R2, MODERATE_R2 = 0.5, 0.0
CONFIDENCE_TEXT = {
    "high": "High",
    "moderate": "Moderate",
    "low": "Low (test R2 < 0 - model underperforms a mean-flux baseline on held-out data)",
}

# ---- fixed values: column names of the grid and of the feature table ---------------------------
TARGET = "goes_electron_flux"
LOG_TARGET = "log_electron_flux"
FIELD_COLUMNS = ["Bx", "By", "Bz"]
PLASMA_COLUMNS = ["solar_wind_speed", "plasma_density"]
DRIVERS = FIELD_COLUMNS + PLASMA_COLUMNS
SCALED_DRIVERS = [f"{name}_scaled" for name in DRIVERS]
GRID_COLUMNS = [TARGET, *DRIVERS]
LAGGED = [f"{name}_lag" for name in DRIVERS + SCALED_DRIVERS]
LAG_COLUMNS = [f"log_flux_lag_{k}" for k in LAG_STEPS]
ROLLING_COLUMNS = [
    f"log_flux_roll_{stat}_{k}" for k in ROLLING_WINDOWS for stat in ("mean", "std", "max", "min")
]
EMA_COLUMNS = [f"log_flux_ema_{k}" for k in ROLLING_WINDOWS]
DELTA_COLUMNS = ["delta_Bz", "delta_speed", "delta_flux"]
FEATURE_COLUMNS = [TARGET, LOG_TARGET, *LAGGED, *LAG_COLUMNS, *ROLLING_COLUMNS, *EMA_COLUMNS, *DELTA_COLUMNS]
NOT_MODEL_INPUT = [TARGET, *[f"{name}_lag" for name in DRIVERS]]
MODEL_INPUTS = [name for name in FEATURE_COLUMNS if name not in NOT_MODEL_INPUT]
