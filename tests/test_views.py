"""SQL over the registered views; serving read of one station prunes the stored series."""

from pyspark.sql import functions as F

from fluvio.plans.views import register_views
from fluvio.sources import files


def test_sql_over_views(spark, sf_small):
    names = register_views(spark, sf_small)
    assert "station_band" in names
    got = spark.sql("""
        SELECT station_id, avg(CASE WHEN obs BETWEEN lower_bound AND upper_bound THEN 1.0 ELSE 0.0 END) AS coverage
        FROM station_band WHERE split = 'test' GROUP BY station_id""").collect()
    assert got and all(0.0 <= r.coverage <= 1.0 for r in got)
    pts = spark.sql("SELECT count(*) AS n FROM observations WHERE geometry.type = 'Point'").first().n
    assert pts > 0


def test_one_station_read_is_pushed_down(spark, sf_small, tmp_path):
    register_views(spark, sf_small)
    band = spark.table("station_band").where(F.col("split") == "test")
    path = str(tmp_path / "series")
    files.write_scored_series(files.scored_series(band), path)
    q = files.read_scored_series(spark, path).where(F.col("station_id") == 3)
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = q._jdf.queryExecution().explainString(mode)
    assert "EqualTo(station_id,3)" in plan
    assert q.count() == band.where("station_id = 3").count()


def test_served_test_data_one_station(spark, sf_small, tmp_path):
    register_views(spark, sf_small)
    band = spark.table("station_band").where(F.col("split") == "test")
    path = str(tmp_path / "served")
    files.write_scored_series(files.scored_series(band), path)
    rows = files.served_test_data(spark, path, station_id=3).collect()
    assert rows and all(r.station_id == 3 for r in rows)
    assert [(r.year, r.month) for r in rows] == sorted((r.year, r.month) for r in rows)
    assert all(round(r.observed, 2) == r.observed for r in rows)
