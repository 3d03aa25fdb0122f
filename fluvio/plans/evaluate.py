"""Skill and band evaluation per station (the flagship slice).

panel -> features (H1, H2, E1-E5) -> complete cases (B11) -> split (B10)
-> predictions (any predictor; stand-ins by default) -> gate and mix (H4, H8)
-> MAD sigmas (D10) -> mixed sigma (H10) -> band (H13) -> metric bundles
(D14, D11-D13) -> risk class (H18).

Physical shape: one exchange on ``station_id`` (the lag window); the
station statistics are unbounded windows on that same clustering, and the
final per-station aggregate reuses it too. No join, no broadcast, nothing
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.config import Splits
from fluvio.functions import season
from fluvio.functions import uncertainty as U
from fluvio.operators import features as feat
from fluvio.operators import metrics as M
from fluvio.operators import robust


def stand_in_predictions(frame: DataFrame) -> DataFrame:
    """pred_A = 0.5 y_lag1 + 0.5 y_rm3; pred_B = pred_A + (train mean of B - train mean of A).

    A plain-SQL predictor so that the whole slice has an SQL oracle; learners
    replace it without touching anything downstream (see ``plans.learn``).
    """
    ws = Window.partitionBy("station_id")
    is_train = F.col("split") == "train"
    offset = F.avg(F.when(is_train, F.col(C.TARGET_B))).over(ws) - F.avg(F.when(is_train, F.col(C.TARGET_A))).over(ws)
    pred_a = F.lit(0.5) * F.col("y_lag1") + F.lit(0.5) * F.col("y_rm3")
    return frame.withColumn("pred_A", pred_a).withColumn("pred_B", F.col("pred_A") + offset)


def with_band(scored: DataFrame, scale: float | Column = C.SCALE_SERVING_DEFAULT,
              calibration_split: str = "test", peak_split: str = "train", approx: bool = False) -> DataFrame:
    """Adds per-row mix, sigma and band columns given ``pred_A`` / ``pred_B``.

    * sigma_A, sigma_B: MAD sigma of the residuals on ``calibration_split``
      ('test' = the original's in-sample choice, 'val' = out-of-sample).
    * upper_fence: from ``peak_split`` rows of target A.
    * g, pred, obs: gated mix of predictions and of observations.
    * sigma_base: H10 sigma before the band scale; sigma = sigma_base * s.

    ``approx=True`` switches the quantiles to grouped sketches (skew-proof for
    groups that are not bounded by the calendar).
    """
    cal = F.col("split") == calibration_split
    out = robust.with_mad_sigma(scored, F.col(C.TARGET_A) - F.col("pred_A"), where=cal, name="sigma_A",
                                approx=approx)
    out = robust.with_mad_sigma(out, F.col(C.TARGET_B) - F.col("pred_B"), where=cal, name="sigma_B", approx=approx)
    out = robust.with_upper_fence(out, C.TARGET_A, where=F.col("split") == peak_split, approx=approx)
    g = season.gate()
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    out = out.select(
        "*",
        g.alias("g"),
        U.gated_mix("pred_A", "pred_B", g).alias("pred"),
        U.gated_mix(C.TARGET_A, C.TARGET_B, g).alias("obs"),
        U.mixed_sigma("sigma_A", "sigma_B", "pred_A", "pred_B").alias("sigma_base"),
        U.observed_width(C.TARGET_MIN, C.TARGET_B).alias("obs_width"),
    )
    out = out.withColumn("sigma", F.col("sigma_base") * s)
    return out.withColumn("lower_bound", U.lower("pred", "sigma")).withColumn("upper_bound", U.upper("pred", "sigma"))


def station_report(band: DataFrame, eval_split: str = "test", train_split: str = "train", extra=()) -> DataFrame:
    """D14 (train bundle on target A, test bundle on the mixed target), D11-D13, H18.

    One grouped aggregate; masks select the rows of each bundle. ``extra``
    aggregates join it.
    """
    te = F.col("split") == eval_split
    tr = F.col("split") == train_split
    o_te, p_te = F.when(te, F.col("obs")), F.when(te, F.col("pred"))
    o_tr, p_tr = F.when(tr, F.col(C.TARGET_A)), F.when(tr, F.col("pred_A"))
    aggs = [
        F.count(o_te).alias("n_test"),
        F.count(o_tr).alias("n_train"),
        F.max(F.when(te, F.col("sigma_A"))).alias("sigma_A"),
        F.max(F.when(te, F.col("sigma_B"))).alias("sigma_B"),
        F.max("upper_fence").alias("upper_fence"),
    ]
    aggs += M.skill_exprs(o_te, p_te, upper_fence=F.col("upper_fence"))
    aggs += M.skill_exprs(o_tr, p_tr, upper_fence=F.col("upper_fence"), prefix="train_")
    aggs += M.interval_exprs(o_te, F.when(te, F.col("lower_bound")), F.when(te, F.col("upper_bound")),
                             F.when(te, F.col("obs_width")))
    rep = band.groupBy("station_id").agg(*aggs, *extra)
    return rep.withColumn("risk", M.risk_class("coverage", "pbias"))


def evaluate(panel: DataFrame, splits: Splits = Splits(), scale: float = C.SCALE_SERVING_DEFAULT,
             calibration_split: str = "test") -> DataFrame:
    frame = feat.model_frame(panel, splits)
    band = with_band(stand_in_predictions(frame), scale, calibration_split)
    return station_report(band)
