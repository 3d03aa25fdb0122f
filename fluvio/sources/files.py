"""File sources and sinks.

All writes go below a caller-given path (on a cluster: the shared folder,
see ``fluvio.session.shared_dir``); Spark writes one file per task, so a sink
scales with the number of partitions, never through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.sources.schemas import SCORED_SERIES


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def scored_series(band: DataFrame) -> DataFrame:
    """A5 rows: the calibration split's observed / predicted / band / observed range."""
    return band.select(
        F.col("station_id").cast("long").alias("station_id"),
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        F.col("obs").alias("observed"),
        F.col("pred").alias("predicted"),
        "lower_bound", "upper_bound",
        F.col("flow_next_month_min").alias("obs_min"),
        F.col("flow_next_month_max").alias("obs_max"),
        F.col("sigma").alias("uncertainty"),
    )


def write_scored_series(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted by station inside the files, not ``partitionBy(station_id)``.

    A directory per station would mean millions of tiny files at full scale.
    The band comes hashed by station, so a station lies in one file without a
    further exchange (range sampling would run the windows twice), and sorted
    row groups let a pushed ``station_id = k`` filter skip the others.
    """
    series.sortWithinPartitions("station_id", "year", "month").write.mode(mode).parquet(path)


def read_scored_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED_SERIES).parquet(path)


def response_projection(series: DataFrame, digits: int = 2) -> DataFrame:
    """The served test-data rows, values rounded half-even to 2 decimals."""
    vals = ["observed", "predicted", "lower_bound", "upper_bound", "obs_min", "obs_max", "uncertainty"]
    keep = [c for c in series.columns if c not in vals]
    return series.select(*keep, *[F.bround(F.col(c), digits).alias(c) for c in vals if c in series.columns])


def served_test_data(spark: SparkSession, path: str, station_id: int | None = None) -> DataFrame:
    """The stored test series as served: optionally one station (a pushed
    ``station_id = k`` filter), ordered by
    month, values rounded for the response (B18)."""
    series = read_scored_series(spark, path)
    if station_id is not None:
        series = series.where(F.col("station_id") == F.lit(station_id))
    return response_projection(series).orderBy("station_id", "year", "month")


def export_run_tables(tables: dict[str, DataFrame], run_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """One dataset per table (train metrics, test metrics, monthly coverage) under one run dir."""
    paths = {}
    for name, df in tables.items():
        p = f"{run_dir.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(p)
        else:
            w.parquet(p)
        paths[name] = p
    return paths
