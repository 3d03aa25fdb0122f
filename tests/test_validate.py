"""Request validation and fills."""

from fluvio import config as C
from fluvio.operators import validate as V


def _req(spark, **over):
    row = {"request_id": "r", "station_id": 1, "year": 2024, "month": 6}
    row.update({c: 1.0 for c in C.REQUEST_FEATURES})
    row.update(over)
    from fluvio.sources.schemas import REQUEST
    return spark.createDataFrame([tuple(row[f.name] for f in REQUEST.fields)], REQUEST)


def test_valid_request(spark):
    acc, q = V.split_valid(_req(spark))
    assert acc.count() == 1 and q.count() == 0


def test_out_of_range_and_missing(spark):
    reqs = _req(spark, request_id="a", month=13).unionByName(_req(spark, request_id="b", year=1990)) \
        .unionByName(_req(spark, request_id="c", y_lag1=None, pr_sum3=None))
    v = {r.request_id: r.violations for r in V.with_violations(reqs).collect()}
    assert v["a"] == ["month out of range [1, 12]"]
    assert v["b"] == ["year out of range [1998, 2030]"]
    assert v["c"] == ["missing y_lag1", "missing pr_sum3"]
    acc, q = V.split_valid(reqs)
    assert acc.count() + q.count() == reqs.count() and acc.count() == 0


def test_only_year_and_month_is_rejected(spark):
    df = spark.createDataFrame([("x", 1, 2024, 6)], "request_id string, station_id long, year int, month int")
    v = V.with_violations(df).collect()[0].violations
    assert len(v) == len(C.REQUEST_FEATURES)


def test_fill_zero_and_train_mean(spark):
    df = _req(spark, y_lag1=None)
    z = V.fill_zero(df, C.REQUEST_FEATURES).collect()[0]
    assert z.y_lag1 == 0.0
    frame = spark.createDataFrame([(1, "train", 10.0), (1, "train", 20.0), (1, "test", 99.0)],
                                  "station_id long, split string, y_lag1 double")
    m = V.fill_train_mean(df, frame, ["y_lag1"]).collect()[0]
    assert m.y_lag1 == 15.0
