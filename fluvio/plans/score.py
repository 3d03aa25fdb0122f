"""Batch and request scoring with a trained ensemble (I5, I6, I10 wiring, H11, H14, B18, H25).

Everything is a DataFrame transformation, so the same ``score_requests``
serves a batch of requests and a streaming DataFrame alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.functions import season
from fluvio.functions import uncertainty as U
from fluvio.operators import calibrate
from fluvio.plans import evaluate as ev


def scored_band(frame: DataFrame, ens: Predictor, scale: float | None = None,
                calibration_split: str = "test") -> DataFrame:
    """Learner predictions -> MAD sigmas -> band, with a fixed or searched scale.

    With ``scale=None`` the scale is searched per station on the calibration
    split (I10) and joined back on ``station_id`` (one row per station; AQE
    broadcasts it when its measured size is under the threshold).
    """
    pred = ens.transform(frame)
    if scale is not None:
        return ev.with_band(pred, scale, calibration_split).withColumn("s_opt", F.lit(float(scale)))
    base = ev.with_band(pred, 1.0, calibration_split)
    best = calibrate.scale_search(base.where(F.col("split") == calibration_split))
    out = base.join(best.select("station_id", "s_opt"), "station_id", "left")
    s = F.coalesce(F.col("s_opt"), F.lit(C.SCALE_SERVING_DEFAULT))
    return (out.withColumn("sigma", F.col("sigma_base") * s)
            .withColumn("lower_bound", U.lower("pred", "sigma"))
            .withColumn("upper_bound", U.upper("pred", "sigma")))


def run_report(band: DataFrame, eval_split: str = "test") -> DataFrame:
    """Per-station evaluation of a scored band, in one aggregate: D14 bundles, D11-D13, H18, s_opt,
    and per-learner RMSE / R^2 on target A (net, tree, their average)."""
    from fluvio.operators.metrics import skill_expr_map
    te = F.col("split") == eval_split
    y = F.when(te, F.col(C.TARGET_A))
    extra = [F.max("s_opt").alias("s_opt")]
    for name, col in (("net", "net_A"), ("tree", "tree_A"), ("ensemble", "pred_A")):
        if col in band.columns:
            m = skill_expr_map(y, F.when(te, F.col(col)))
            extra += [m["rmse"].alias(f"{name}_rmse"), m["r2"].alias(f"{name}_r2")]
    return ev.station_report(band, eval_split, extra=extra)


@dataclass
class StandIn:
    """The plain predictor of ``plans.evaluate.stand_in_predictions`` for requests.

    ``offsets`` has a row for a station: mean of target B less mean of target A
    over the train years. It serves wherever a trained ensemble does.
    """

    offsets: DataFrame

    @classmethod
    def fitted(cls, frame: DataFrame) -> "StandIn":
        train = F.col("split") == "train"
        mean = lambda c: F.avg(F.when(train, F.col(c)))
        return cls(frame.groupBy("station_id").agg((mean(C.TARGET_B) - mean(C.TARGET_A)).alias("_offset")))

    def transform(self, df: DataFrame) -> DataFrame:
        a = F.lit(0.5) * F.col("y_lag1") + F.lit(0.5) * F.col("y_rm3")
        return (df.join(self.offsets, "station_id", "left").withColumn("pred_A", a)
                .withColumn("pred_B", F.col("pred_A") + F.col("_offset")).drop("_offset"))


@dataclass
class Scored:
    """Predictions made before: ``transform`` returns them."""

    rows: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        return self.rows


class Predictor(Protocol):
    """Anything that adds ``pred_A`` and ``pred_B``."""

    def transform(self, df: DataFrame) -> DataFrame: ...


def with_request_features(requests: DataFrame) -> DataFrame:
    """Cyclic month from the request's month (the request carries the 23 others)."""
    return requests.withColumn("month_sin", season.month_sin()).withColumn("month_cos", season.month_cos())


#: How a served forecast's sigma comes about: from the run's MAD sigmas (H11), or the fixed base of the older service.
SIGMA_MODES = ("run", "base")


def score_requests(requests: DataFrame, ens: Predictor, runs: DataFrame | None = None,
                   gate_mode: str = "true_month", clip_at_zero: bool = True, sigma_mode: str = "run") -> DataFrame:
    """Validated requests -> forecast with band and response projection.

    ``runs`` supplies sigma_A, sigma_B and s_opt per station (the latest run);
    without it the serving defaults (15, 15, 1.2) apply. ``gate_mode``:
    'true_month' (default) or 'legacy_sin' (the lossy month recovery, H19).
    In both modes sigma and the reported gate use the true month, as the
    original's serving path does; only the prediction mix follows the mode.
    ``sigma_mode``: 'run' (H11, reports gate, sigma_mix and s_opt) or 'base'
    (H12: 15 wet / 10 dry; reports pred_A, pred_B and gate).

    Values are rounded half-even in decimal; the original rounds the binary
    value, so exact decimal ties (2.675) can differ in the last digit.
    """
    if sigma_mode not in SIGMA_MODES:
        raise ValueError(f"sigma_mode must be one of {SIGMA_MODES}")
    x = ens.transform(with_request_features(requests))
    if runs is not None:
        x = x.join(runs.select("station_id", "sigma_A", "sigma_B", "s_opt"), "station_id", "left")
    else:
        x = x.select("*", *[F.lit(None).cast("double").alias(c) for c in ("sigma_A", "sigma_B", "s_opt")])
    gate_month: Column = season.month_from_sin("month_sin") if gate_mode == "legacy_sin" else F.col("month")
    g = season.gate(gate_month)
    s = F.coalesce(F.col("s_opt"), F.lit(C.SCALE_SERVING_DEFAULT))
    sigma = U.serving_sigma("sigma_A", "sigma_B", "s_opt") if sigma_mode == "run" else U.legacy_sigma(s)
    x = x.select(
        "*",
        U.gated_mix("pred_A", "pred_B", g).alias("predicted_flow_raw"),
        U.serving_sigma_mix("sigma_A", "sigma_B").alias("sigma_mix_raw"),
        sigma.alias("uncertainty_raw"),
        season.gate().alias("gate_raw"), s.alias("s_raw"),
    )
    p, u = F.col("predicted_flow_raw"), F.col("uncertainty_raw")
    parts = ({"gate": "gate_raw", "sigma_mix": "sigma_mix_raw", "s_opt": "s_raw"} if sigma_mode == "run"
             else {"pred_A": "pred_A", "pred_B": "pred_B", "gate": "gate_raw"})
    return x.select(
        "request_id", "station_id", "year", "month",
        F.bround(p, 2).alias("predicted_flow"),
        F.bround(U.lower(p, u, clip_at_zero=clip_at_zero), 2).alias("lower_bound"),
        F.bround(U.upper(p, u), 2).alias("upper_bound"),
        F.bround(u, 2).alias("uncertainty"),
        U.nominal_confidence().alias("confidence_level"),
        F.struct(*[F.bround(c, 2).alias(n) for n, c in parts.items()]).alias("model_components"),
    )


def clipped_series(scored: DataFrame, scale=None) -> DataFrame:
    """The test series as the older service shows it: base sigma (H12) and a lower bound not below 0."""
    out = scored.withColumn("sigma", U.legacy_sigma(scale))
    return (out.withColumn("lower_bound", U.lower("pred", "sigma", clip_at_zero=True))
            .withColumn("upper_bound", U.upper("pred", "sigma")))


METRICS = ("rmse", "mae", "r2", "nse", "kge", "pbias", "pearson", "nse_peaks")


def metric_struct(rep: DataFrame, prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{n}").alias(n) for n in METRICS])
