"""A2/A3 JSON ingest with VARIANT, B1-B9 listings, B20 quality rules on hand-made records."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from fluvio.operators import catalog
from fluvio.sources import records


def _box(x, y, side=0.01):
    return [[[x, y], [x, y + side], [x + side, y + side], [x + side, y], [x, y]]]


def _seen(id_, kind, value, unit, where, at):
    shape = "Point" if isinstance(at[0], float) else "Polygon"
    return {"id": id_, "type": kind, "value": value, "unit": unit, "timestamp": "2031-05-02T06:30:00Z",
            "geometry": {"type": shape, "coordinates": at}, "location_name": where}


# A harbour's sensors: berths and quays.
OBS = [
    _seen(41, "noise", 61.5, "dB", "Quay 7", [10.71, 59.9]),
    _seen(42, "queue", 12, "vehicles", "Gate north", [10.74, 59.91]),
    _seen(43, "salinity", 31.2, "psu", "Basin", _box(10.7, 59.88)),
    _seen(44, "noise", 48.0, "dB", "Silo", [10.72, 59.89]),
    _seen(45, "turbidity", 3.4, "NTU", "Fairway", _box(10.66, 59.85, 0.05)),
    _seen(46, "draught", 7.9, "m", "Berth 2", [10.73, 59.9]),
    _seen(47, "salinity", 28.8, "psu", "River mouth", _box(10.76, 59.9)),
]


def _ahead(id_, model, result, confidence, where, at, **more):
    return _seen(id_, "", 0, "", where, at) | {"model": model, "result": result, "confidence": confidence,
                                               "forecast_time": "2031-05-02T09:00:00Z"} | more


FORECASTS = [
    _ahead(71, "berth_occupancy", 0.62, 0.55, "Berth 2", [10.73, 59.9]),
    _ahead(72, "queue_length", {"lanes": 3, "speed_avg": 1.25}, 0.71, "Gate north", [10.74, 59.91]),
    _ahead(73, "algae_bloom", "unlikely", 0.94, "Basin", _box(10.7, 59.88)),
    _ahead(74, "queue_closure", "gate closed", 0.5, "Gate south", _box(10.75, 59.87), alert_level="amber", phenomena=["queue", "detour"]),
    _ahead(75, "silt_transport", 4, 0.33, "Fairway", _box(10.66, 59.85, 0.05)),
]


def _write(rows):
    d = tempfile.mkdtemp(prefix="fluvio-json-")
    with open(os.path.join(d, "part.json"), "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")
    return d


def test_observation_listings(spark):
    obs = records.read_observations_json(spark, _write(OBS))
    assert catalog.points(obs).count() == 4
    assert catalog.polygons(obs).count() == 3
    assert catalog.locations(obs).count() == 7
    assert sorted(r.id for r in catalog.filter_observations(obs, data_type="NOISE").collect()) == [41, 44]
    assert catalog.filter_observations(obs, geometry_type="", data_type=None).count() == 7
    pts = catalog.filter_observations(obs, geometry_type="point").collect()
    assert all(len(r.geometry.point) == 2 and r.geometry.rings is None for r in pts)
    polys = catalog.polygons(obs).collect()
    assert all(len(r.geometry.rings[0]) >= 4 and r.geometry.point is None for r in polys)
    assert obs.where("id = 42").collect()[0].value == 12.0
    assert obs.schema["timestamp"].dataType.simpleString() == "timestamp"


def test_forecast_listings_and_variant(spark):
    fc = records.read_forecasts_json(spark, _write(FORECASTS))
    assert catalog.points(fc).count() == 2 and catalog.polygons(fc).count() == 3
    assert sorted(r.id for r in catalog.filter_forecasts(fc, model_name="queue").collect()) == [72, 74]
    assert [r.id for r in catalog.filter_forecasts(fc, model_name="TRANSPORT").collect()] == [75]
    assert catalog.forecast_areas(fc).count() == 5
    kinds = {r.id: r.k for r in fc.select("id", records.result_kind(F.col("result")).alias("k")).collect()}
    assert kinds == {71: "number", 72: "object", 73: "string", 74: "string", 75: "number"}
    speed = fc.select("id", F.try_variant_get("result", "$.speed_avg", "double").alias("s")).where("id = 72").collect()
    assert speed[0].s == 1.25
    assert fc.where("id = 74").collect()[0].phenomena == ["queue", "detour"]


def test_quality_rules_flag_bad_geometries(spark):
    bad = [
        {"id": 10, "type": "t", "value": 1, "unit": "u", "timestamp": "2025-01-01T00:00:00Z",
         "geometry": {"type": "Line", "coordinates": [[0, 0], [1, 1]]}, "location_name": "x"},
        {"id": 11, "type": "t", "value": 1, "unit": "u", "timestamp": "2025-01-01T00:00:00Z",
         "geometry": {"type": "Point", "coordinates": [1.5]}, "location_name": "x"},
        {"id": 12, "type": "t", "value": 1, "unit": "u", "timestamp": "2025-01-01T00:00:00Z",
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]}, "location_name": ""},
        {"id": 13, "type": "t", "value": 1, "unit": "u", "timestamp": "2025-01-01T00:00:00Z",
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}, "location_name": "y"},
    ]
    obs = records.read_observations_json(spark, _write(OBS + bad))
    flags = {r.id: set(r.violations) for r in catalog.quality_flags(obs).collect()}
    assert all(not flags[r["id"]] for r in OBS)
    assert flags[10] == {"bad_geometry_type"}
    assert flags[11] == {"point_arity"}
    assert flags[12] == {"ring_too_short", "missing_location"}
    assert flags[13] == {"ring_not_closed"}
    rep = {r.rule: r.n_violations for r in catalog.quality_report(obs).collect()}
    assert rep["point_arity"] == 1 and rep["ring_too_short"] == 1 and rep["bad_geometry_type"] == 1


def test_forecast_quality_rules(spark):
    bad = dict(FORECASTS[1], id=9, confidence=1.5)
    fc = records.read_forecasts_json(spark, _write(FORECASTS + [bad]))
    rep = {r.rule: r.n_violations for r in catalog.quality_report(fc, "forecast").collect()}
    assert rep["confidence_range"] == 1 and rep["missing_forecast_time"] == 0


def test_geometry_filter_is_pushed_to_parquet(spark, tmp_path):
    obs = records.read_observations_json(spark, _write(OBS))
    p = str(tmp_path / "obs")
    records.write_records(obs, p)
    stored = spark.read.parquet(p)
    q = catalog.filter_observations(stored, geometry_type="POINT").select("id", "location_name")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(geometry_type,point)" in plan
    assert "ReadSchema: struct<id:bigint,geometry_type:string,location_name:string>" in plan
    assert sorted(r.id for r in q.collect()) == [41, 42, 44, 46]


def test_stored_results_are_shredded_and_filters_pushed(spark, sf_small, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from fluvio.sources import records
    path = str(tmp_path / "forecasts")
    records.write_forecasts(records.forecasts(spark, sf_small).select("id", "model", "result"), path)
    schema = str(pq.ParquetFile(next((tmp_path / "forecasts/result_kind=object").glob("*.parquet"))).schema)
    assert "typed_value" in schema and "speed_avg" in schema
    stored = spark.read.parquet(path)
    q = records.objects_with(stored, "speed_avg", 50.0).select("id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(result" in plan and "PartitionFilters: [isnotnull(result_kind" in plan and "struct<0:double>" in plan
    text = lambda df: sorted((r.id, r.k, r.j) for r in df.select("id", records.result_kind(F.col("result")).alias("k"), F.to_json("result").alias("j")).collect())
    assert text(stored) == text(records.forecasts(spark, sf_small))
