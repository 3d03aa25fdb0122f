"""Exact (window) and approximate (grouped sketch) modes agree with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvio.operators import robust


def _rows(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for st, n in ((1, 9), (2, 400)):  # station 2 is the hot one
        for i, v in enumerate(rng.normal(100, 20, n)):
            out.append((st, i, float(v)))
    return out


def _mad(x):
    x = np.asarray(x)
    return 1.4826 * np.median(np.abs(x - np.median(x)))


@pytest.mark.parametrize("approx", [False, True])
def test_mad_sigma_and_fence(spark, approx):
    rows = _rows()
    df = spark.createDataFrame(rows, "station_id long, i long, r double").repartition(4)
    got = {r.station_id: r.s for r in robust.with_mad_sigma(df, "r", name="s", approx=approx)
           .select("station_id", "s").distinct().collect()}
    fence = {r.station_id: r.upper_fence for r in robust.with_upper_fence(df, "r", approx=approx)
             .select("station_id", "upper_fence").distinct().collect()}
    by = robust.mad_sigma_by_station(df, {"x": F.col("r")}, approx=approx).collect()
    for st in (1, 2):
        x = [r[2] for r in rows if r[0] == st]
        q1, q3 = np.percentile(x, [25, 75])
        tol = 1e-9 if not approx else 0.05 * _mad(x)
        assert got[st] == pytest.approx(_mad(x), abs=tol)
        assert [b.sigma_x for b in by if b.station_id == st][0] == pytest.approx(_mad(x), abs=tol)
        assert fence[st] == pytest.approx(q3 + 1.5 * (q3 - q1), abs=1e-9 if not approx else 0.1 * (q3 - q1))


def test_band_in_approx_mode_is_close_to_exact(spark, sf_small):
    from fluvio.operators import features as feat
    from fluvio.plans import evaluate as ev
    from fluvio.sources import panel as P
    scored = ev.stand_in_predictions(feat.model_frame(P.station_month(spark, sf_small)))
    ex = {r.station_id: r.sigma_A for r in ev.with_band(scored).select("station_id", "sigma_A").distinct().collect()}
    ap = {r.station_id: r.sigma_A for r in ev.with_band(scored, approx=True).select("station_id", "sigma_A")
          .distinct().collect()}
    assert set(ex) == set(ap)
    for k in ex:
        if ex[k] is not None:
            assert ap[k] == pytest.approx(ex[k], rel=0.35)
