"""Geo-tagged observation and forecast records.

Raw records carry a GeoJSON-like geometry whose ``coordinates`` depth
depends on ``type`` (a point is ``[lon, lat]``, a polygon a list of rings of
``[lon, lat]``). One column cannot hold both depths, so the raw coordinates
are read as VARIANT and normalised on ingest into
``geometry STRUCT<type, point ARRAY<DOUBLE>, rings ARRAY<ARRAY<ARRAY<DOUBLE>>>>``,
each cast guarded by the type (a cast at the wrong depth yields an array of
NULLs, not NULL). A lower-case ``geometry_type`` key column is stored next
to it so that filters are plain equalities Catalyst pushes into parquet.

The forecast ``result`` is polymorphic (string, number or object) and stays
VARIANT; ``try_variant_get`` reads it per kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.sources.schemas import FORECASTS_RAW, OBSERVATIONS_RAW
from fluvio.sources.tables import table


def normalize_geometry(raw: Column) -> Column:
    t = raw.getField("type")
    coords = raw.getField("coordinates")
    point = F.when(t == "Point", F.try_variant_get(coords, "$", "array<double>"))
    rings = F.when(t == "Polygon", F.try_variant_get(coords, "$", "array<array<array<double>>>"))
    return F.struct(t.alias("type"), point.alias("point"), rings.alias("rings"))


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text (``...Z``) -> TIMESTAMP (session time zone UTC)."""
    return F.to_timestamp(c)


def normalize_observations(raw: DataFrame) -> DataFrame:
    ts = raw.schema["timestamp"].dataType.simpleString()
    tcol = iso_timestamp(F.col("timestamp")) if ts == "string" else F.col("timestamp")
    return raw.select(
        "id", "type", F.col("value").cast("double").alias("value"), "unit", tcol.alias("timestamp"),
        normalize_geometry(F.col("geometry")).alias("geometry"),
        F.lower(F.col("geometry.type")).alias("geometry_type"),
        "location_name",
    )


def normalize_forecasts(raw: DataFrame) -> DataFrame:
    cols = []
    for f in raw.schema.fields:
        if f.name == "geometry":
            cols += [normalize_geometry(F.col("geometry")).alias("geometry"),
                     F.lower(F.col("geometry.type")).alias("geometry_type")]
        elif f.name in ("timestamp", "forecast_time") and f.dataType.simpleString() == "string":
            cols.append(iso_timestamp(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return raw.select(*cols)


def read_observations_json(spark: SparkSession, path: str) -> DataFrame:
    """A2: JSON records with the declared schema, normalised."""
    return normalize_observations(spark.read.schema(OBSERVATIONS_RAW).json(path))


def read_forecasts_json(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``result`` is VARIANT in the read schema (a bare JSON string keeps its type)."""
    return normalize_forecasts(spark.read.schema(FORECASTS_RAW).json(path))


# --- records derived from the driver's ``events`` table -----------------------------------

def _lon_lat() -> tuple[Column, Column]:
    uid = F.col("user_id")
    lon = F.lit(-43.0) - (uid % 100) / 100.0
    lat = F.lit(-22.0) - (uid % 50) / 50.0
    return lon, lat


def _raw_geometry(defects: bool = False) -> Column:
    """Raw geometry with VARIANT coordinates: even event ids are points, odd ones 5-point closed squares.

    With ``defects`` some ids have an unknown type, a point of one coordinate,
    a ring of two points or an open ring (for the quality rules).
    """
    lon, lat = _lon_lat()
    d = F.lit(0.1)
    ring = F.array(F.array(lon, lat), F.array(lon + d, lat), F.array(lon + d, lat - d),
                   F.array(lon, lat - d), F.array(lon, lat))
    is_point = F.col("event_id") % 2 == 0
    t = F.when(is_point, F.lit("Point")).otherwise(F.lit("Polygon"))
    coords = F.when(is_point, F.to_variant_object(F.array(lon, lat))).otherwise(F.to_variant_object(F.array(ring)))
    if defects:
        i = F.col("event_id")
        bad_type, short_point = i % 29 == 3, is_point & (i % 31 == 4)
        short_ring, open_ring = ~is_point & (i % 37 == 5), ~is_point & (i % 41 == 7)
        t = F.when(bad_type, F.lit("Line")).otherwise(t)
        coords = (F.when(short_point, F.to_variant_object(F.array(lon)))
                  .when(short_ring, F.to_variant_object(F.array(F.slice(ring, 1, 2))))
                  .when(open_ring, F.to_variant_object(F.array(F.slice(ring, 1, 4)))).otherwise(coords))
    return F.struct(t.alias("type"), coords.alias("coordinates"))


def flawed_records(events: DataFrame) -> DataFrame:
    """Forecast records with planted defects, and the location of the observation at the same event (``obs_location``)."""
    i = F.col("event_id")
    raw = events.select(
        i.alias("id"), _raw_geometry(defects=True).alias("geometry"),
        F.when(i % 43 == 8, F.lit(" ")).otherwise(F.concat(F.lit("Area "), F.col("user_id").cast("string"))).alias("location_name"),
        F.when(i % 59 == 11, F.lit(None)).otherwise(F.concat(F.lit("Station "), F.col("user_id").cast("string"))).alias("obs_location"),
        F.when(i % 47 == 9, F.lit(1.5)).otherwise((i % 100) / 100.0).alias("confidence"),
        F.when(i % 53 != 10, F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("forecast_time"))
    return normalize_forecasts(raw)


def observations_raw_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        F.col("value"),
        F.upper(F.substring("event_type", 1, 3)).alias("unit"),
        F.col("ts").alias("timestamp"),
        _raw_geometry().alias("geometry"),
        F.concat(F.lit("Station "), F.col("user_id").cast("string")).alias("location_name"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_observations(observations_raw_from_events(table(spark, sf_dir, "events")))


def _raw_result() -> Column:
    """Polymorphic result by ``event_id % 3``: string, number, or object holding the props."""
    kind = F.col("event_id") % 3
    obj = F.to_variant_object(F.struct(F.parse_json(F.col("props")).alias("props"), F.col("value").alias("speed_avg")))
    return (
        F.when(kind == 0, F.col("event_type").cast("variant"))
        .when(kind == 1, F.col("value").cast("variant"))
        .otherwise(obj)
    )


def forecasts_raw_from_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 3
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit("_model")).alias("model"),
        _raw_result().alias("result"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence"),
        F.col("ts").alias("timestamp"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("forecast_time"),
        _raw_geometry().alias("geometry"),
        F.concat(F.lit("Area "), F.col("user_id").cast("string")).alias("location_name"),
        F.when(kind == 1, F.lit("C")).alias("unit"),
        F.when(kind == 0, F.col("value") % 100).alias("precipitation_probability"),
        F.when(F.col("event_type") == "error", F.lit("amber")).alias("alert_level"),
        F.when(F.col("event_type") == "error", F.array(F.lit("queue"), F.lit("detour")))
        .alias("phenomena"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_forecasts(forecasts_raw_from_events(table(spark, sf_dir, "events")))


def result_kind(result: Column) -> Column:
    """'string' / 'number' / 'object' / other, from the VARIANT's own type."""
    t = F.schema_of_variant(result)
    return (
        F.when(t == "STRING", F.lit("string"))
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT", "BIGINT", "INT", "SMALLINT", "TINYINT"),
              F.lit("number"))
        .when(t.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lower(t))
    )


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store normalised records; clustered by the geometry-type key so a
    pushed ``geometry_type = 'point'`` filter skips whole row groups."""
    df.sortWithinPartitions("geometry_type").write.mode(mode).parquet(path)


#: Writing a VARIANT column shreds it: fields of one type in a file become typed Parquet columns of their own.
_SHRED = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema")


def write_forecasts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store forecast records with their polymorphic ``result`` shredded.

    Results of one kind go to a partition (``result_kind``), so the files of
    objects hold each field as a typed column that a filter on
    ``try_variant_get(result, '$.field', type)`` is pushed to.
    """
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SHRED}
    for k in _SHRED:
        spark.conf.set(k, "true")
    try:
        df.withColumn("result_kind", result_kind(F.col("result"))).write.mode(mode).partitionBy("result_kind").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def objects_with(stored: DataFrame, field: str, above: float) -> DataFrame:
    """Stored records whose result is an object with a numeric ``field`` above a value: one partition, a pushed filter."""
    return stored.where((F.col("result_kind") == "object") & (F.try_variant_get("result", f"$.{field}", "double") > above))
