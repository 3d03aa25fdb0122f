"""Explicit schemas (no inference at scan time)."""

from __future__ import annotations

from pyspark.sql import types as T

from fluvio.config import METEO_COLUMNS, REQUEST_FEATURES

_D = T.DoubleType()

STATION_MONTH = T.StructType(
    [T.StructField("station_id", T.LongType()), T.StructField("year", T.IntegerType()),
     T.StructField("month", T.IntegerType())]
    + [T.StructField(c, _D) for c in METEO_COLUMNS]
    + [T.StructField(c, _D) for c in ("flow_next_month", "flow_next_month_min", "flow_next_month_max")]
)

# Normalised geometry: one column cannot hold two array depths, so a point and
# the rings of a polygon live in separate fields, guarded by ``type``.
GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("point", T.ArrayType(_D)),
    T.StructField("rings", T.ArrayType(T.ArrayType(T.ArrayType(_D)))),
])

# Raw GeoJSON-like geometry as read from JSON: coordinates stay VARIANT until
# the type is known.
RAW_GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.VariantType()),
])

OBSERVATIONS_RAW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", _D),
    T.StructField("unit", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("geometry", RAW_GEOMETRY),
    T.StructField("location_name", T.StringType()),
])

FORECASTS_RAW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("result", T.VariantType()),
    T.StructField("confidence", _D),
    T.StructField("timestamp", T.StringType()),
    T.StructField("forecast_time", T.StringType()),
    T.StructField("geometry", RAW_GEOMETRY),
    T.StructField("location_name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("precipitation_probability", _D),
    T.StructField("expected_intensity", T.StringType()),
    T.StructField("min_temp", _D),
    T.StructField("max_temp", _D),
    T.StructField("alert_level", T.StringType()),
    T.StructField("phenomena", T.ArrayType(T.StringType())),
])

REQUEST = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("station_id", T.LongType()),
     T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
    + [T.StructField(c, _D) for c in REQUEST_FEATURES]
)

SCORED_SERIES = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("observed", _D),
    T.StructField("predicted", _D),
    T.StructField("lower_bound", _D),
    T.StructField("upper_bound", _D),
    T.StructField("obs_min", _D),
    T.StructField("obs_max", _D),
    T.StructField("uncertainty", _D),
])

METRICS = T.StructType([T.StructField(c, _D) for c in
                        ("rmse", "mae", "r2", "nse", "kge", "pbias", "pearson", "nse_peaks")])

LEARNER_METRICS = T.StructType([T.StructField(c, _D) for c in
                                ("net_rmse", "net_r2", "tree_rmse", "tree_r2", "ensemble_rmse", "ensemble_r2")])

MODEL_RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("station_id", T.LongType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("train_metrics", METRICS),
    T.StructField("test_metrics", METRICS),
    T.StructField("learner_metrics", LEARNER_METRICS),
    T.StructField("sigma_A", _D),
    T.StructField("sigma_B", _D),
    T.StructField("s_opt", _D),
    T.StructField("coverage", _D),
    T.StructField("train_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("trained_on", T.TimestampType()),
])
