"""D1-D13 against NumPy formulas on hand-made rows, incl. zero-variance and zero-mean cases."""

import math

import numpy as np
import pytest

from fluvio.operators import metrics as M

O = [10.0, 12.0, 9.0, 15.0, 20.0, 11.0, 13.0, 30.0]
P = [11.0, 11.5, 10.0, 14.0, 18.0, 12.0, 13.0, 25.0]


def _agg(spark, o, p, uf=None):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(o, p)], "o double, p double")
    fence = None if uf is None else __import__("pyspark.sql.functions", fromlist=["lit"]).lit(float(uf))
    return df.agg(*M.skill_exprs("o", "p", upper_fence=fence)).collect()[0]


def _np_metrics(o, p):
    o, p = np.array(o), np.array(p)
    ss_res = np.sum((o - p) ** 2)
    ss_tot = np.sum((o - o.mean()) ** 2)
    r = np.corrcoef(o, p)[0, 1]
    beta = p.mean() / o.mean()
    gamma = (np.std(p, ddof=1) / p.mean()) / (np.std(o, ddof=1) / o.mean())
    return {
        "rmse": math.sqrt(np.mean((o - p) ** 2)), "mae": np.mean(np.abs(o - p)),
        "nse": 1 - ss_res / ss_tot, "r2": 1 - ss_res / ss_tot, "pearson": r,
        "kge": 1 - math.sqrt((r - 1) ** 2 + (beta - 1) ** 2 + (gamma - 1) ** 2),
        "pbias": 100 * np.sum(o - p) / np.sum(o),
    }


def test_skill_bundle_matches_numpy(spark):
    got = _agg(spark, O, P)
    for k, v in _np_metrics(O, P).items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_perfect_fit_properties(spark):
    got = _agg(spark, O, O)
    assert got["nse"] == pytest.approx(1.0) and got["pbias"] == pytest.approx(0.0)
    assert got["rmse"] == 0.0 and got["kge"] == pytest.approx(1.0)


def test_constant_observations_give_null_not_error(spark):
    got = _agg(spark, [5.0] * 4, [4.0, 5.0, 6.0, 5.5])
    assert got["nse"] is None and got["pearson"] is None and got["kge"] is None
    assert got["r2"] == 0.0  # SStot = 0 and imperfect fit
    assert _agg(spark, [5.0] * 3, [5.0] * 3)["r2"] == 1.0


def test_zero_mean_observations(spark):
    got = _agg(spark, [-1.0, 1.0, -2.0, 2.0], [-1.0, 0.5, -2.5, 2.0])
    assert got["pbias"] is None and got["kge"] is None
    assert got["nse"] is not None


def test_peak_nse(spark):
    uf = 14.0
    got = _agg(spark, O, P, uf)
    o, p = np.array(O), np.array(P)
    m = o > uf
    exp = 1 - np.sum((o[m] - p[m]) ** 2) / np.sum((o[m] - o[m].mean()) ** 2)
    assert got["nse_peaks"] == pytest.approx(exp)
    assert _agg(spark, O, P, 1000.0)["nse_peaks"] is None


def test_interval_metrics_inclusive_edges(spark):
    rows = [(10.0, 9.0, 10.0, 1.0), (10.0, 10.0, 11.0, 2.0), (10.0, 10.5, 11.0, 0.5), (12.0, 9.0, 11.0, 1e-6)]
    df = spark.createDataFrame(rows, "o double, lo double, up double, w double")
    got = df.agg(*M.interval_exprs("o", "lo", "up", "w")).collect()[0]
    assert got["coverage"] == pytest.approx(0.5)  # both exact edges covered
    o = np.array([r[0] for r in rows])
    width = np.array([r[2] - r[1] for r in rows])
    assert got["rel_width"] == pytest.approx(width.mean() / (np.std(o) + 1e-6))
    assert got["width_ratio"] == pytest.approx(np.mean(width / np.array([r[3] for r in rows])))


def test_risk_class(spark):
    df = spark.createDataFrame([(0.85, 3.0), (0.85, -7.0), (0.75, 1.0), (0.5, 0.0), (0.9, None)],
                               "coverage double, pbias double")
    got = [r[0] for r in df.select(M.risk_class()).collect()]
    assert got == ["low", "medium", "medium", "high", "medium"]
