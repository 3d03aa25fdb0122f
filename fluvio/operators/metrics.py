"""Skill, interval and summary metrics.

Every metric is a built-in aggregate expression, so a whole bundle is one
``groupBy(keys).agg(...)`` with map-side partial aggregation. Zero
denominators give NULL (the original gives NaN) and never raise under ANSI
mode: each division is guarded by ``try_divide`` or an explicit zero test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvio import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.when(b != 0, F.try_divide(a, b))


def skill_exprs(obs="o", pred="p", upper_fence=None, prefix: str = "") -> list[Column]:
    """D1-D8 as a list of aliased aggregate expressions (see ``skill_expr_map``)."""
    return [e.alias(f"{prefix}{k}") for k, e in skill_expr_map(obs, pred, upper_fence).items()]


def skill_expr_map(obs="o", pred="p", upper_fence=None) -> dict[str, Column]:
    """D1-D8 as aggregate expressions over one group, by metric name.

    * rmse, mae: sqrt(mean d^2), mean |d| with d = o - p.
    * nse: 1 - SSres/SStot, NULL when SStot = 0.
    * r2: same formula; NULL below two rows; for SStot = 0 it is 1.0 on a
      perfect fit, else 0.0 (the usual regression-score convention).
    * pearson: covar_pop / (sd_pop(o) sd_pop(p)), NULL on a constant side.
    * kge: 1 - sqrt((r-1)^2 + (beta-1)^2 + (gamma-1)^2), beta = mean p / mean o,
      gamma = CV(p) / CV(o) with sample sd; NULL on zero means.
    * pbias: 100 * sum(o - p) / sum(o) (positive = under-prediction).
    * nse_peaks: NSE over rows with o > upper_fence, own mean; NULL if none.
    """
    o, p = _c(obs), _c(pred)
    d = o - p
    n = F.count(o)
    ss_res = F.sum(d * d)
    ss_tot = F.var_pop(o) * n
    nse = F.when(ss_tot != 0, F.lit(1.0) - F.try_divide(ss_res, ss_tot))
    r2 = F.when(n >= 2, F.when(ss_tot != 0, F.lit(1.0) - F.try_divide(ss_res, ss_tot))
                .otherwise(F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    r = _div(F.covar_pop(o, p), F.stddev_pop(o) * F.stddev_pop(p))
    kge = _kling_gupta(r, F.avg(p), F.avg(o), F.stddev_samp(p), F.stddev_samp(o))
    pbias = F.lit(100.0) * _div(F.sum(d), F.sum(o))
    out = {
        "rmse": F.sqrt(F.avg(d * d)),
        "mae": F.avg(F.abs(d)),
        "r2": r2,
        "nse": nse,
        "kge": kge,
        "pbias": pbias,
        "pearson": r,
    }
    if upper_fence is not None:
        peak = o > _c(upper_fence)
        po = F.when(peak, o)
        pd_ = F.when(peak, d)
        pn = F.count(po)
        p_ss_tot = F.var_pop(po) * pn
        p_ss_res = F.sum(pd_ * pd_)
        out["nse_peaks"] = F.when((pn > 0) & (p_ss_tot != 0), F.lit(1.0) - F.try_divide(p_ss_res, p_ss_tot))
    return out


def _kling_gupta(corr: Column, mean_p: Column, mean_o: Column, sd_p: Column, sd_o: Column) -> Column:
    """1 minus the distance of (correlation, bias ratio, variability ratio) from (1, 1, 1).

    The variability ratio is CV(p) / CV(o) = sd_p * mean_o / (sd_o * mean_p).
    """
    bias_ratio = _div(mean_p, mean_o)
    variability_ratio = _div(sd_p * mean_o, sd_o * mean_p)
    distance = sum((F.pow(x - 1.0, F.lit(2)) for x in (bias_ratio, variability_ratio)), F.pow(corr - 1.0, F.lit(2)))
    return F.lit(1.0) - F.sqrt(distance)


def interval_exprs(obs="o", lo="lower_bound", up="upper_bound", obs_width="obs_width",
                   prefix: str = "") -> list[Column]:
    """D11 coverage (inclusive), D12 relative width (population sd), D13 width ratio."""
    o, l_, u = _c(obs), _c(lo), _c(up)
    width = u - l_
    return [
        F.avg(((o >= l_) & (o <= u)).cast("double")).alias(f"{prefix}coverage"),
        F.try_divide(F.avg(width), F.stddev_pop(o) + F.lit(C.REL_WIDTH_EPS)).alias(f"{prefix}rel_width"),
        F.avg(F.try_divide(width, _c(obs_width))).alias(f"{prefix}width_ratio"),
    ]


def risk_class(coverage="coverage", pbias="pbias") -> Column:
    """Low if p >= 0.8 and |PBIAS| <= 5; medium if p >= 0.7; else high; NULL without a coverage."""
    p, b = _c(coverage), _c(pbias)
    low, medium, high = C.RISK_LABELS
    return (
        F.when((p >= C.RISK_LOW_COVERAGE) & (F.abs(b) <= C.RISK_LOW_ABS_PBIAS), F.lit(low))
        .when(p >= C.RISK_MEDIUM_COVERAGE, F.lit(medium))
        .when(p.isNotNull(), F.lit(high))
    )


def split_summary(frame: DataFrame, keys=("station_id",)) -> DataFrame:
    """Rows and year range per split (train / val / test)."""
    return (
        frame.where(F.col("split").isNotNull())
        .groupBy(*keys, "split")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    )
