"""Property checks: NSE(o,o)=1, PBIAS(o,o)=0, MAE <= RMSE, band contains the prediction."""

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from fluvio.functions import uncertainty as U
from fluvio.operators import metrics as M

vals = st.lists(st.floats(min_value=1.0, max_value=1e4, allow_nan=False), min_size=3, max_size=12)


@settings(max_examples=12, deadline=None)
@given(o=vals, noise=st.floats(min_value=-50, max_value=50))
def test_metric_invariants(spark, o, noise):
    if max(o) - min(o) < 1e-6:
        return
    df = spark.createDataFrame([(x, x, x + noise) for x in o], "o double, same double, p double")
    perfect = df.agg(*M.skill_exprs("o", "same")).first()
    assert perfect["nse"] == pytest.approx(1.0) and perfect["pbias"] == pytest.approx(0.0, abs=1e-9)
    r = df.agg(*M.skill_exprs("o", "p")).first()
    assert r["mae"] <= r["rmse"] + 1e-9
    assert r["nse"] <= 1.0 + 1e-12


@settings(max_examples=10, deadline=None)
@given(pred=st.floats(min_value=-1e3, max_value=1e3), sigma=st.floats(min_value=0, max_value=1e3),
       month=st.integers(min_value=1, max_value=12))
def test_band_contains_prediction(spark, pred, sigma, month):
    df = spark.createDataFrame([(pred, sigma, month)], "p double, s double, month int")
    r = df.select(U.lower("p", "s").alias("lo"), U.upper("p", "s").alias("up"),
                  U.lower("p", "s", clip_at_zero=True).alias("lo0")).first()
    assert r["lo"] <= pred <= r["up"] and r["lo0"] >= 0.0
