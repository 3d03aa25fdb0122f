"""Prediction-request source (A4).

The original takes one JSON body of 25 fields per call; here a request is a
row, so a batch (or a stream) of requests is a DataFrame with the REQUEST
schema. ``read_requests`` scans JSON with the declared schema;
``requests_from_frame`` derives a batch from the test split of the feature
frame, with some fields nulled or out of range (keyed by
``(station_id + month) % 7``) so that validation has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvio import config as C
from fluvio.sources.panel import nan_to_null
from fluvio.sources.schemas import REQUEST

CORRUPTION_MODULUS = 7


CORRUPT = "_corrupt_record"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON request lines with the declared schema; NaN counts as missing.

    A line that is no valid JSON keeps its text in ``_corrupt_record`` (and is
    rejected by validation), so nothing is lost silently.
    """
    schema = T.StructType([*REQUEST.fields, T.StructField(CORRUPT, T.StringType())])
    return nan_to_null(spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path))


def request_id() -> F.Column:
    return F.concat_ws("-", F.col("station_id").cast("string"), F.col("year").cast("string"),
                       F.format_string("%02d", F.col("month")))


def requests_from_frame(frame: DataFrame, split: str = "test", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = frame.where(F.col("split") == split)
    key = F.pmod(F.col("station_id") + F.col("month"), F.lit(CORRUPTION_MODULUS))
    cols = [request_id().alias("request_id"), F.col("station_id").cast("long").alias("station_id"),
            F.when(key == 1, F.lit(1990)).otherwise(F.col("year")).cast("int").alias("year"),
            F.when(key == 0, F.lit(13)).otherwise(F.col("month")).cast("int").alias("month")]
    for c in C.REQUEST_FEATURES:
        v = F.col(c).cast("double")
        if c == "y_lag1":
            v = F.when(key != 2, v)
        elif c in ("pr_sum3", "u2_min"):
            v = F.when(key != 3, v)
        cols.append(v.alias(c))
    return rows.select(*cols, *keep)
