"""Filtered listings and quality checks of geo records.

Filters are compositions of ``DataFrame.filter``; an argument that is None
or the empty string means "no filter", the present ones are ANDed (B3).
Case-insensitive equality on the geometry type uses the lower-case
``geometry_type`` key stored at ingest, so it is a plain equality that
reaches the parquet scan as a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(v: str | None) -> bool:
    return bool(v)


def filter_observations(obs: DataFrame, geometry_type: str | None = None, data_type: str | None = None) -> DataFrame:
    """B1 (geometry type, case-insensitive =), B2 (data type, case-insensitive =), B3."""
    out = obs
    if _given(geometry_type):
        out = out.filter(F.col("geometry_type") == geometry_type.lower())
    if _given(data_type):
        out = out.filter(F.lower(F.col("type")) == data_type.lower())
    return out


def filter_forecasts(fc: DataFrame, geometry_type: str | None = None, model_name: str | None = None) -> DataFrame:
    """B7 (geometry type, case-insensitive =), B8 (model, case-insensitive substring), B3."""
    out = fc
    if _given(geometry_type):
        out = out.filter(F.col("geometry_type") == geometry_type.lower())
    if _given(model_name):
        out = out.filter(F.contains(F.lower(F.col("model")), F.lit(model_name.lower())))
    return out


def points(df: DataFrame) -> DataFrame:
    """Exact, case-sensitive ``geometry.type = 'Point'``."""
    return df.filter(F.col("geometry.type") == "Point")


def polygons(df: DataFrame) -> DataFrame:
    """Exact ``geometry.type = 'Polygon'``."""
    return df.filter(F.col("geometry.type") == "Polygon")


def locations(obs: DataFrame) -> DataFrame:
    """One row per observation (no dedup), ``data_types = [type]``."""
    return obs.select("id", "location_name", F.col("geometry.type").alias("geometry_type"),
                      F.array(F.col("type")).alias("data_types"))


def forecast_areas(fc: DataFrame) -> DataFrame:
    """B9."""
    return fc.select("id", "location_name", F.col("geometry.type").alias("geometry_type"), "model", "forecast_time")


def point_lon() -> Column:
    return F.element_at(F.col("geometry.point"), 1)


def point_lat() -> Column:
    return F.element_at(F.col("geometry.point"), 2)


def quality_rules(kind: str = "observation", location: str = "location_name") -> dict[str, Column]:
    """One boolean per rule, true = violated.

    * bad_geometry_type: type not in {Point, Polygon}
    * point_arity: a point without exactly 2 numeric coordinates
    * ring_too_short: a polygon without rings or with a ring of < 4 points
    * ring_not_closed: a ring whose first and last points differ
    * missing_location: empty or null location_name
    * confidence_range (forecasts): confidence outside [0, 1] or null
    * missing_forecast_time (forecasts)
    """
    t = F.col("geometry.type")
    pt = F.col("geometry.point")
    rings = F.col("geometry.rings")
    is_pt, is_poly = t == "Point", t == "Polygon"
    rules = {
        "bad_geometry_type": ~F.coalesce(t.isin("Point", "Polygon"), F.lit(False)),
        "point_arity": is_pt & ~F.coalesce((F.size(pt) == 2) & F.forall(pt, lambda x: x.isNotNull()), F.lit(False)),
        "ring_too_short": is_poly & ~F.coalesce((F.size(rings) >= 1) & F.forall(rings, lambda r: F.size(r) >= 4),
                                               F.lit(False)),
        "ring_not_closed": is_poly & F.coalesce(
            F.exists(rings, lambda r: (F.size(r) >= 1) & (F.element_at(r, 1) != F.element_at(r, -1))), F.lit(False)),
        "missing_location": F.coalesce(F.length(F.trim(F.col(location))) == 0, F.lit(True)),
    }
    if kind == "forecast":
        rules["confidence_range"] = ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
        rules["missing_forecast_time"] = F.col("forecast_time").isNull()
    return rules


def quality_report(df: DataFrame, kind: str = "observation") -> DataFrame:
    """Violation count per rule: one aggregate pass, then (rule, n) rows."""
    return quality_reports(df, {kind: "location_name"})


def quality_reports(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``quality_report`` of several kinds of record kept in one table, in one pass.

    ``kinds`` maps each kind to the column that holds its location.
    """
    rules = [(kind, name, c) for kind, location in kinds.items() for name, c in quality_rules(kind, location).items()]
    agg = df.agg(F.count(F.lit(1)).alias("n_records"), *[F.count(F.when(c, F.lit(1))).alias(f"n{i}") for i, (_, _, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(kind).alias("source"), F.lit(name).alias("rule"), F.col(f"n{i}").alias("n")) for i, (kind, name, _) in enumerate(rules)])
    return agg.select("n_records", F.explode(rows).alias("r")).select("r.source", "n_records", "r.rule", F.col("r.n").alias("n_violations"))


def quality_flags(df: DataFrame, kind: str = "observation") -> DataFrame:
    """Per record: the array of violated rule names (empty when clean)."""
    rules = quality_rules(kind)
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
