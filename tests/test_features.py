"""E1-E5, H1, B11 on a hand-made 6-month, 1-station table."""

import math

import pytest

from fluvio import config as C
from fluvio.operators import features as feat


def _panel(spark, flows, prs, station=7):
    rows = []
    for i, (f, p) in enumerate(zip(flows, prs)):
        r = {"station_id": station, "year": 2000, "month": i + 1}
        for c in C.METEO_COLUMNS:
            r[c] = 1.0
        r["pr_min"], r["pr_max"] = p - 1.0, p + 1.0  # pr_mean = p
        r["flow_next_month"] = f
        r["flow_next_month_min"] = None if f is None else f - 1
        r["flow_next_month_max"] = None if f is None else f + 2
        rows.append(r)
    from fluvio.sources.schemas import STATION_MONTH
    return spark.createDataFrame([tuple(r[f.name] for f in STATION_MONTH.fields) for r in rows], STATION_MONTH)


def test_lags_and_trailing_windows(spark):
    flows = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    prs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    out = {r["month"]: r for r in feat.add_lag_features(_panel(spark, flows, prs)).collect()}
    assert out[1]["pr_lag1"] is None and out[1]["pr_sum3"] is None and out[1]["y_rm3"] is None
    # partial trailing windows before the complete-case filter
    assert out[2]["pr_sum3"] == 1.0 and out[2]["y_rm3"] == 10.0
    assert out[3]["pr_sum3"] == 3.0 and out[3]["y_rm3"] == 15.0
    assert out[4]["pr_sum3"] == 6.0 and out[4]["y_rm3"] == 20.0
    assert out[5]["pr_sum3"] == 9.0 and out[5]["y_rm3"] == 30.0
    assert (out[4]["y_lag1"], out[4]["y_lag2"], out[4]["y_lag3"]) == (30.0, 20.0, 10.0)
    assert out[4]["pr_api3"] == pytest.approx(0.5 * 3 + 0.3 * 2 + 0.2 * 1)
    assert out[3]["pr_api3"] is None
    assert out[3]["month_sin"] == pytest.approx(math.sin(2 * math.pi * 3 / 12))


def test_complete_cases_keep_full_windows_only(spark):
    flows = [10.0, 20.0, 30.0, 40.0, 50.0, None]
    prs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    cc = feat.complete_cases(feat.add_lag_features(_panel(spark, flows, prs))).orderBy("month").collect()
    # rows 1-3 lack lag 3, row 6 lacks its target
    assert [r["month"] for r in cc] == [4, 5]
    for r in cc:
        assert r["pr_sum3"] == pytest.approx(r["pr_lag1"] + r["pr_lag2"] + r["pr_lag3"])
        assert r["y_rm3"] == pytest.approx((r["y_lag1"] + r["y_lag2"] + r["y_lag3"]) / 3)


def test_split_and_holdout(spark):
    df = spark.createDataFrame([(1, y, 1) for y in (1994, 1995, 1998, 1999, 2000, 2001, 2002)],
                               "station_id long, year int, month int")
    got = {r["year"]: r["split"] for r in feat.add_split(df).collect()}
    assert got == {1994: None, 1995: "train", 1998: "train", 1999: "val", 2000: "test", 2001: "test", 2002: None}
    h = feat.hash_holdout(df).collect()
    assert {r["holdout"] for r in h} <= {"train", "test"}


def test_lags_are_per_station(spark):
    a = _panel(spark, [1.0, 2.0, 3.0, 4.0], [1.0] * 4, station=1)
    b = _panel(spark, [100.0, 200.0, 300.0, 400.0], [1.0] * 4, station=2)
    out = feat.add_lag_features(a.unionByName(b))
    for r in out.where("month = 1").collect():
        assert r["y_lag1"] is None
    assert {r["station_id"]: r["y_lag1"] for r in out.where("month = 2").collect()} == {1: 1.0, 2: 100.0}


def test_csv_ingest_turns_nan_into_null(spark, tmp_path):
    from fluvio.sources.panel import read_station_month_csv
    from fluvio.sources.schemas import STATION_MONTH
    header = ",".join(f.name for f in STATION_MONTH.fields)
    vals = ["1", "2000", "1"] + ["1.0"] * 14 + ["NaN", "", "3.0"]
    p = tmp_path / "panel.csv"
    p.write_text(header + "\n" + ",".join(vals) + "\n")
    r = read_station_month_csv(spark, str(p)).collect()[0]
    assert r.flow_next_month is None and r.flow_next_month_min is None and r.flow_next_month_max == 3.0
    assert r.year == 2000 and r.u2_min == 1.0
