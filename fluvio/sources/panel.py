"""Station-month panel (A1).

Two ways in:

* ``read_station_month_csv`` / ``read_station_month_parquet``: the panel as a
  file with an explicit schema (the original reads one station's CSV).
* ``panel_from_lineitem``: the fixture panel derived from the driver's
  ``lineitem`` table. One grouped aggregate (partial aggregation before the
  shuffle, so a hot supplier costs no more than any other) and a ``lead``
  over the station window for the next-month targets.

Panel rows per station are bounded by the number of calendar months, so
every later per-station window or exact percentile holds a bounded group
no matter how many raw rows a station has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvio.sources.schemas import STATION_MONTH
from fluvio.sources.tables import table

def _meteo_source() -> dict:
    """Fixture mapping lineitem -> meteo columns (min and max of each per month)."""
    return {
        "u2": F.col("l_discount") * 100,
        "tmin": F.col("l_tax") * 100,
        "tmax": F.col("l_quantity"),
        "rs": F.col("l_extendedprice") / 1000,
        "rh": F.col("l_linenumber").cast("double"),
        "eto": (F.col("l_partkey") % 97).cast("double"),
        "pr": F.col("l_quantity") * (1 - F.col("l_discount")),
    }


def station_window() -> Window:
    return Window.partitionBy("station_id").orderBy("year", "month")


def panel_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """station_month with this-month flow and next-month targets."""
    flow = F.col("l_extendedprice") / 100
    # Mean flow in exact fixed point: prices carry cents, so the sum of
    # integer cents is exact and the mean is the same double on any engine
    # and in any summation order.
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    mean_flow = F.sum(cents).cast("double") / F.count(cents) / 10000.0
    aggs = []
    for name, expr in _meteo_source().items():
        aggs += [F.min(expr).alias(f"{name}_min"), F.max(expr).alias(f"{name}_max")]
    aggs += [mean_flow.alias("flow"), F.min(flow).alias("flow_min"), F.max(flow).alias("flow_max")]
    monthly = (
        lineitem.groupBy(
            F.col("l_suppkey").alias("station_id"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
        ).agg(*aggs)
    )
    w = station_window()
    return monthly.select(
        "*",
        F.lead("flow", 1).over(w).alias("flow_next_month"),
        F.lead("flow_min", 1).over(w).alias("flow_next_month_min"),
        F.lead("flow_max", 1).over(w).alias("flow_next_month_max"),
    )


def station_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from_lineitem(table(spark, sf_dir, "lineitem"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Stray NaN -> NULL in double columns: Spark aggregates skip NULL but
    propagate NaN, and the original treats NaN as missing."""
    cols = [F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
            if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def read_station_month_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV with the declared schema (year, month typed at scan, B12); NaN -> NULL."""
    return nan_to_null(spark.read.schema(STATION_MONTH).option("header", True).option("mode", "FAILFAST").csv(path))


def write_station_month(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stored panel: parquet partitioned by ``year`` (a year filter prunes
    directories), dealt by ranges of (year, station): a year is spread over as
    many tasks and files as its rows ask for, and a station filter skips files
    and row groups through min/max statistics."""
    (panel.repartitionByRange("year", "station_id").sortWithinPartitions("year", "station_id", "month")
     .write.mode(mode).partitionBy("year").parquet(path))


def read_station_month_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The stored panel; ``year`` comes back as the partition column."""
    return nan_to_null(spark.read.parquet(path).select(*[f.name for f in STATION_MONTH.fields if f.name != "year"],
                                                       F.col("year").cast("int").alias("year")))
