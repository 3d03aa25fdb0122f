"""H2-H6, H10-H14, H19 on months 1..12."""

import math

import pytest
from pyspark.sql import functions as F

from fluvio.functions import season
from fluvio.functions import uncertainty as U


def test_season_weights_and_legacy_month(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    rows = df.select("month", season.gate().alias("g"), season.disagreement_weight().alias("w"),
                     season.season_factor().alias("f"), season.month_sin().alias("s"),
                     season.month_from_sin(season.month_sin()).alias("rec")).orderBy("month").collect()
    wet = {11, 12, 1, 2}
    for r in rows:
        assert r["g"] == (0.3 if r["month"] in wet else 0.7)
        assert r["w"] == (0.22 if r["month"] in wet else 0.08)
        assert r["f"] == (1.0 if r["month"] in wet else 0.75)
        assert r["s"] == pytest.approx(math.sin(2 * math.pi * r["month"] / 12))
    assert [r["rec"] for r in rows] == [2, 3, 4, 3, 2, 1, 12, 11, 10, 11, 12, 1]


def test_sigma_forms(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 100.0, 90.0), (6, 10.0, 20.0, 100.0, 90.0)],
                               "month int, sa double, sb double, pa double, pb double")
    r = df.select("month", U.mixed_sigma("sa", "sb", "pa", "pb").alias("m"),
                  U.serving_sigma_mix("sa", "sb").alias("sm"),
                  U.serving_sigma("sa", "sb", F.lit(None).cast("double")).alias("ss"),
                  U.legacy_sigma().alias("ls")).orderBy("month").collect()
    jan, jun = r
    assert jan["m"] == pytest.approx(math.sqrt(0.3 * 100 + 0.7 * 400 + 0.22 * 100) * 1.0)
    assert jun["m"] == pytest.approx(math.sqrt(0.7 * 100 + 0.3 * 400 + 0.08 * 100) * 0.75)
    assert jun["sm"] == pytest.approx(math.sqrt(0.7 * 100 + 0.3 * 400 + 0.08 * 100))
    assert jun["ss"] == pytest.approx(jun["sm"] * 0.75 * 1.2)
    assert jan["ls"] == pytest.approx(15 * 1.0 * 1.2) and jun["ls"] == pytest.approx(10 * 0.75 * 1.2)


def test_serving_defaults_and_clip(spark):
    df = spark.createDataFrame([(7, None, None, 5.0)], "month int, sa double, sb double, pred double")
    r = df.select(U.serving_sigma_mix("sa", "sb").alias("sm"),
                  U.lower("pred", F.lit(8.0), clip_at_zero=True).alias("lo"),
                  U.lower("pred", F.lit(8.0)).alias("raw")).collect()[0]
    assert r["sm"] == pytest.approx(math.sqrt(0.7 * 225 + 0.3 * 225 + 0.08 * 100))
    assert r["lo"] == 0.0 and r["raw"] == -3.0
