"""Robust per-station statistics (D9, D10) and how they reach the rows.

The original computes one-row statistics and applies them to every row.
Here a statistic is per station. Two shapes are offered:

* ``*_by_station``: one row per station (a grouped aggregate).
* ``with_*``: the statistic attached to every row through an unbounded
  window over ``partitionBy(station_id)``. The rows are already clustered
  by station for the lag windows, so this needs no join and no extra
  exchange; it replaces the "broadcast the scalar" step.

Exact ``percentile`` keeps a group's values in memory. Groups here are one
station's months (bounded by the calendar), never raw rows. For groups
without such a bound pass ``approx=True``: the quantiles are then grouped
``percentile_approx`` aggregates, whose sketches are partially aggregated
before the shuffle (a station holding a third of all rows is merged from
per-task sketches, never gathered in one task), joined back on
``station_id`` (one row per station; AQE decides broadcast vs shuffle by
measured size and splits skewed join partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio import config as C


def _pct(col: Column, q, approx: bool) -> Column:
    if approx:
        return F.percentile_approx(col, q, 100000)
    return F.percentile(col, q)


def _masked(value: str | Column, where: Column | None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return v if where is None else F.when(where, v)


def upper_fence_exprs(value, where: Column | None = None, approx: bool = False) -> list[Column]:
    """Q1, Q3 (linear interpolation) and UF = Q3 + 1.5 (Q3 - Q1)."""
    v = _masked(value, where)
    q1, q3 = _pct(v, 0.25, approx), _pct(v, 0.75, approx)
    return [q1.alias("q1"), q3.alias("q3"), (q3 + F.lit(C.FENCE_K) * (q3 - q1)).alias("upper_fence")]


def upper_fence_by_station(df: DataFrame, value=C.TARGET_A, where: Column | None = None,
                           approx: bool = False) -> DataFrame:
    return df.groupBy("station_id").agg(*upper_fence_exprs(value, where, approx))


def with_upper_fence(df: DataFrame, value=C.TARGET_A, where: Column | None = None, name="upper_fence",
                     approx: bool = False) -> DataFrame:
    if approx:
        st = df.groupBy("station_id").agg(*upper_fence_exprs(value, where, approx=True))
        return df.join(st.select("station_id", F.col("upper_fence").alias(name)), "station_id", "left")
    v = _masked(value, where)
    ws = Window.partitionBy("station_id")
    q1, q3 = _pct(v, 0.25, approx).over(ws), _pct(v, 0.75, approx).over(ws)
    return df.withColumn(name, q3 + F.lit(C.FENCE_K) * (q3 - q1))


def with_mad_sigma(df: DataFrame, residual, where: Column | None = None, name="sigma",
                   approx: bool = False) -> DataFrame:
    """1.4826 * median(|res - median(res)|) per station, attached to rows.

    Exact: two unbounded windows on the same partitioning (Catalyst stacks
    two Window operators on one exchange). Approx: two grouped sketch
    aggregates joined back on ``station_id`` (skew-proof for unbounded groups).
    """
    r = _masked(residual, where)
    med_name = f"_{name}_med"
    if approx:
        med = df.groupBy("station_id").agg(_pct(r, 0.5, True).alias(med_name))
        tagged = df.join(med, "station_id", "left")
        dev = F.abs(_masked(residual, where) - F.col(med_name))
        sig = tagged.groupBy("station_id").agg((F.lit(C.MAD_SCALE) * _pct(dev, 0.5, True)).alias(name))
        return df.join(sig, "station_id", "left")
    ws = Window.partitionBy("station_id")
    out = df.withColumn(med_name, _pct(r, 0.5, approx).over(ws))
    dev = F.abs(r - F.col(med_name))
    out = out.withColumn(name, F.lit(C.MAD_SCALE) * _pct(dev, 0.5, approx).over(ws))
    return out.drop(med_name)


def mad_sigma_by_station(df: DataFrame, residuals: dict[str, Column], where: Column | None = None,
                         approx: bool = False) -> DataFrame:
    """D10 for several residual columns at once, one row per station.

    Step 1: median of each residual per station (window when exact, grouped
    sketch + join when approx). Step 2: grouped aggregate of the absolute
    deviations (on the same clustering when exact: no new exchange).
    """
    ws = Window.partitionBy("station_id")
    base = df.select("station_id", *[_masked(r, where).alias(f"_r_{k}") for k, r in residuals.items()])
    if approx:
        meds = base.groupBy("station_id").agg(*[_pct(F.col(f"_r_{k}"), 0.5, True).alias(f"_m_{k}") for k in residuals])
        base = base.join(meds, "station_id", "left")
    else:
        base = base.select("*", *[_pct(F.col(f"_r_{k}"), 0.5, approx).over(ws).alias(f"_m_{k}") for k in residuals])
    aggs = []
    for k in residuals:
        aggs.append(F.first(F.col(f"_m_{k}"), ignorenulls=True).alias(f"median_{k}"))
        aggs.append((F.lit(C.MAD_SCALE) * _pct(F.abs(F.col(f"_r_{k}") - F.col(f"_m_{k}")), 0.5, approx))
                    .alias(f"sigma_{k}"))
    return base.groupBy("station_id").agg(*aggs)
