"""Calendar gap report.

The original builds a years x months product. Here the spine is implicit:
for each station-month the previous present month comes from ``lag`` on the
station window, and every month strictly between the two is emitted with
``explode(sequence(...))``. No cross join and no anti join; work is linear
in the panel plus the number of missing months. The calendar bounds are one
scalar subquery (two numbers), not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio.session import scratch_path


def month_index(year="year", month="month") -> Column:
    y = F.col(year) if isinstance(year, str) else year
    m = F.col(month) if isinstance(month, str) else month
    return y.cast("long") * 12 + m.cast("long") - 1


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """(station_id, year, month) of months a station lacks within the panel's calendar.

    The calendar runs from the panel's first to its last month (one scalar
    subquery). Per row, the months after the previous present month (or
    after the calendar start) are missing; the last row of a station also
    reports the months up to the calendar end.
    """
    # The station-months are written once (two numbers each); the bounds and the gaps both read them, so the facts are scanned once.
    spark = panel.sparkSession
    path = scratch_path(spark, "calendar")
    panel.select(F.col("station_id").cast("long").alias("station_id"), month_index().cast("long").alias("_idx")).write.parquet(path)
    idx = spark.read.schema("station_id long, _idx long").parquet(path)
    rng = idx.select(F.struct(F.min("_idx").alias("lo"), F.max("_idx").alias("hi"))).scalar()
    w = Window.partitionBy("station_id").orderBy("_idx")
    x = idx.select("station_id", "_idx", F.lag("_idx", 1).over(w).alias("_prev"),
                   F.lead("_idx", 1).over(w).alias("_next"), rng.alias("_rng"))
    lo, hi = F.col("_rng.lo"), F.col("_rng.hi")
    start = F.coalesce(F.col("_prev") + 1, lo)
    empty = F.array().cast("array<bigint>")
    before = F.when(F.col("_idx") > start, F.sequence(start, F.col("_idx") - 1)).otherwise(empty)
    after = F.when(F.col("_next").isNull() & (F.col("_idx") < hi),
                   F.sequence(F.col("_idx") + 1, hi)).otherwise(empty)
    gaps = x.select("station_id", F.explode(F.concat(before, after)).alias("_m"))
    return gaps.select(
        "station_id",
        F.floor(F.col("_m") / 12).cast("int").alias("year"),
        (F.pmod(F.col("_m"), F.lit(12)) + 1).cast("int").alias("month"),
    )
