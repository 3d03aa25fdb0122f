"""Feature scaling statistics and standardisation.

The original fits the scaler on train UNION val (G1) with the population sd
and a unit scale for zero-variance features. Per station that is a masked
aggregate; ``standardize`` attaches it through an unbounded window on the
station partition (no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio import config as C

FIT_SPLITS = ("train", "val")


def _fit_mask(splits=FIT_SPLITS) -> Column:
    return F.col("split").isin(*splits)


def unit_scale(sd: Column) -> Column:
    """Zero (or undefined) spread -> 1, as the original's scaler does."""
    return F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)


def scaler_stats(frame: DataFrame, features=C.FEATURE_COLUMNS, splits=FIT_SPLITS) -> DataFrame:
    """Per-station mean and population sd of each feature over ``splits``."""
    m = _fit_mask(splits)
    aggs = []
    for c in features:
        v = F.when(m, F.col(c))
        aggs += [F.avg(v).alias(f"mean_{c}"), F.stddev_pop(v).alias(f"sd_{c}")]
    return frame.groupBy("station_id").agg(F.count(F.when(m, F.lit(1))).alias("n_fit"), *aggs)


def standardize(frame: DataFrame, features=C.FEATURE_COLUMNS, splits=FIT_SPLITS, prefix: str = "z_") -> DataFrame:
    """(x - mean) / scale with the station's train+val statistics."""
    ws = Window.partitionBy("station_id")
    m = _fit_mask(splits)
    cols = []
    for c in features:
        v = F.when(m, F.col(c))
        mean = F.avg(v).over(ws)
        sd = unit_scale(F.stddev_pop(v).over(ws))
        cols.append(((F.col(c) - mean) / sd).alias(f"{prefix}{c}"))
    return frame.select("*", *cols)
