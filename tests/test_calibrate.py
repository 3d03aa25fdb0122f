"""The candidate-point grid search equals brute force over all 2,501 grid points."""

import math
import random

import numpy as np
import pytest

from fluvio import config as C
from fluvio.operators.calibrate import scale_search


def _brute(rows):
    o = np.array([r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    sb = np.array([r[3] for r in rows])
    w = np.array([r[4] for r in rows])
    err = np.abs(o - p)
    k_i = np.array([math.ceil(e * 1000 / s) if s > 0 else (0 if e == 0 else 10**9) for e, s in zip(err, sb)])
    a = np.mean(sb * 2) / (np.std(o) + 1e-6)
    b = np.mean(sb * 2 / w)
    best = None
    for k in range(500, 3001):
        s = k / 1000
        pc = np.mean(k_i <= k)
        fit = (-abs(pc - C.TARGET_COVERAGE) - C.REL_WIDTH_WEIGHT * abs(s * a - C.TARGET_REL_WIDTH)
               - C.WIDTH_RATIO_PENALTY * max(0.0, s * b - C.WIDTH_RATIO_CAP))
        if best is None or fit > best[1] + 1e-12:
            best = (k, fit, pc)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grid_search_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for st in range(4):
        for i in range(rnd.randint(3, 25)):
            o = rnd.uniform(50, 150)
            p = o + rnd.gauss(0, 20)
            sb = rnd.choice([0.0, rnd.uniform(5, 30), rnd.uniform(5, 30), rnd.uniform(5, 30)])
            if sb == 0.0 and rnd.random() < 0.5:
                p = o
            w = rnd.choice([1e-6, rnd.uniform(10, 60), rnd.uniform(10, 60)])
            rows.append((st, o, p, sb, w))
    df = spark.createDataFrame(rows, "station_id long, obs double, pred double, sigma_base double, obs_width double")
    got = {r["station_id"]: r for r in scale_search(df).collect()}
    for st in range(4):
        sub = [r for r in rows if r[0] == st]
        k, fit, pc = _brute(sub)
        assert got[st]["s_opt"] == pytest.approx(k / 1000), st
        assert got[st]["fitness"] == pytest.approx(fit, abs=1e-9)
        assert got[st]["coverage"] == pytest.approx(pc)


def test_coverage_monotone_in_scale(spark):
    rows = [(0, 10.0, 10.0 + d, 2.0, 5.0) for d in (0.5, 1.0, 2.0, 3.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "station_id long, obs double, pred double, sigma_base double, obs_width double")
    r = scale_search(df).collect()[0]
    assert 0.5 <= r["s_opt"] <= 3.0


def test_coverage_is_monotone_in_the_scale(spark):
    from pyspark.sql import functions as F

    from fluvio.operators.metrics import interval_exprs
    rnd = random.Random(5)
    rows = [(rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.uniform(1, 20)) for _ in range(200)]
    df = spark.createDataFrame(rows, "o double, p double, sb double")
    prev = -1.0
    for s in (0.5, 0.8, 1.0, 1.3, 2.0, 3.0):
        lo, up = F.col("p") - F.col("sb") * s, F.col("p") + F.col("sb") * s
        cov = df.agg(*interval_exprs("o", lo, up, F.lit(1.0))).collect()[0]["coverage"]
        assert cov >= prev
        prev = cov
